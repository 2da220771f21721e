"""Runs the stream reducer to completion over stored pages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame

from folio.sources.shared import new_folder
from folio.schemas import PAGES
from folio.streaming.reducer import full_stream, state_stream

_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_states(pages: DataFrame) -> DataFrame:
    """pages as a file stream in one pass; the states come back as a table."""
    spark = pages.sparkSession
    base = new_folder(spark, "stream")
    pages.select("book_id", "page_index", "page_type", "toc_entries").write.parquet(f"{base}/pages")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/pages").schema).parquet(f"{base}/pages")
    query = state_stream(stream).writeStream.format("parquet").option("path", f"{base}/states").option("checkpointLocation", f"{base}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/states")


def stream_in_parts(parts: Iterable[DataFrame], arrival: Column | None = None) -> DataFrame:
    """Page records that come in parts: after each part the stream is started anew from its checkpoint, takes what came
    since, and stops. All rows that it wrote come back as a table."""
    base, progress = None, None
    for part in parts:
        spark = part.sparkSession
        if base is None:
            base, progress = new_folder(spark, "stream"), new_folder(spark, "progress")
            before = spark.conf.get(_STORE[0], None)
        part.write.mode("append").parquet(f"{base}/pages")
        spark.conf.set(*_STORE)
        try:
            given = spark.readStream.schema(part.schema if arrival is not None else PAGES).parquet(f"{base}/pages")
            query = full_stream(given, arrival).writeStream.format("parquet").option("path", f"{base}/states").option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            spark.conf.set(_STORE[0], before) if before else spark.conf.unset(_STORE[0])
    if base is None:
        raise ValueError("no parts")
    return spark.read.parquet(f"{base}/states")
