"""Resumable work over files that keep arriving: finished keys are never done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from tamarack.sources.files import readable


def resumed(wanted: DataFrame, sink: str, schema: str, key: str) -> DataFrame:
    """The rows of ``wanted`` whose key the sink does not hold yet."""
    done = readable(wanted.sparkSession, sink, schema)
    return wanted if done is None else wanted.join(done.select(key), key, "left_anti")


def work_through(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, sink_schema: str, key: str, checkpoint: str) -> StreamingQuery:
    """Run ``work`` on each batch of newly arrived Parquet files and append what the sink lacks.

    The batch number and the anti join make a repeated batch harmless. Ends when all files that are there
    have been worked through; started again, it goes on from there.
    """

    def batch(rows: DataFrame, _number: int) -> None:
        left = resumed(rows.dropDuplicates([key]), sink, sink_schema, key)
        work(left).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
