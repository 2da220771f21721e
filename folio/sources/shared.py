"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a single-JVM session without the setting gets one of its own, deleted at the end."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="checkpoints-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """Written once and read back: what is read twice is computed once, and survives lost executors."""
    path = new_folder(df.sparkSession, kind)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """Adds the place of each row (int, from 0) in the whole table's order, without one task that sees all rows.

    Rows are sorted in ranges and numbered within them; the driver holds one count a range."""
    at = F.monotonically_increasing_id()  # range number in the upper bits, place in the lower 33
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "numbered")
    counts = ranged.groupBy(F.shiftright("_at", 33).alias("range")).count().collect()
    offsets, total = {}, 0
    for r in sorted(counts):
        offsets[r["range"]] = total - (r["range"] << 33)
        total += r["count"]
    if not offsets:
        return ranged.withColumn(name, F.lit(0)).drop("_at")
    shift = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    return ranged.withColumn(name, (F.col("_at") + F.element_at(shift, F.shiftright("_at", 33))).cast("int")).drop("_at")
