"""Incremental comparison: new sections arrive as files and are compared with the standing articles, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.compare import lexical_join


def compare_new(spark: SparkSession, folder: str, articles: DataFrame, out: str, checkpoint: str, compare: Callable[[DataFrame, DataFrame], DataFrame] = lexical_join) -> StreamingQuery:
    """Compare the section files (chunk_id, doc_id, texto; Parquet) that have come since the last call.

    The checkpoint knows which files are done. Each batch writes the folder of its own number, so that a batch that is
    run again after a failure replaces what it had written.
    """
    sections = spark.readStream.schema("chunk_id long, doc_id long, texto string").parquet(folder)

    def batch(rows: DataFrame, number: int) -> None:
        compare(rows, articles).withColumn("lote", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return sections.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def citations_by_window(sections: DataFrame, at: str = "at", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sections by event-time window; rows later than `late` are dropped when `sections` is a stream."""
    return sections.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count("*").alias("secciones"))
