"""Where operators keep intermediate tables and files.

On a cluster that is the shared folder named by ``spark.checkpoint.dir``; executors may be
lost and replaced, so nothing an operator reads later may live in one machine's own folder.
Only a single-JVM session without that setting (tests) gets a folder under /tmp.
"""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder; sets one only in a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{_LOCAL_ROOT}/{uuid.uuid4().hex}"
    spark.conf.set("spark.checkpoint.dir", own)
    atexit.register(shutil.rmtree, own.removeprefix("file://"), True)
    return own


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh sub-folder's URI (not created)."""
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete a folder that ``materialise`` or ``new_folder`` made, once nothing reads it any more."""
    if isinstance(df_or_path, DataFrame):
        spark = df_or_path.sparkSession
        paths = {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    else:
        paths = {df_or_path}
    root = shared_root(spark)
    for path in paths:
        tail = root.split("://", 1)[-1].lstrip("/")
        if tail not in path:
            raise ValueError(f"{path} is not under {root}")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def task_count(spark: SparkSession, default: int = 200) -> int:
    """The session's shuffle partition count, which operators use for their own exchanges."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", str(default))))


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """These names, lengthened where a column of the table is called so (in any case of letters)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
