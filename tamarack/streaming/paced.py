"""Requests to an outside service as a stream that keeps a pace, backs off when it is told to, and forgets nothing.

Requests arrive as rows of a lane (one for each service or client). A lane's state is what is pending and the time
from which it may ask again; a timer wakes it then. So the pace holds over batches and restarts, however many requests arrive
at once, and what was pending when a run stopped is asked for by the next one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tamarack.sources.services import Busy

REQUESTS = "lane string, chunk long, query string"
ANSWERS = "lane string, chunk long, pos long, id string, label string"
#: Spark keeps timers in this store only.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: Seconds that a lane goes on asking in one batch. What a batch has asked for is asked for again if it is broken off.
TURN = 2.0

_FREE = StructType([StructField("at", LongType())])


class Lane(StatefulProcessor):
    """One lane: asks for what is pending, the oldest first, each time that it is woken: until it has to pause, or its turn is over."""

    def __init__(self, make: Callable, pause: float, wait: float):
        self.make, self.pause, self.wait, self.client = make, pause, wait, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", StructType([StructField("chunk", LongType())]), StructType([StructField("query", StringType())]))
        self.free = handle.getValueState("free", _FREE)
        self.client = self.make()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for chunk, query in zip(part["chunk"].tolist(), part["query"].tolist(), strict=True):
                self.pending.updateValue((chunk,), (query,))
        yield from self.ask(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.ask(key, timerValues)

    def ask(self, key, timerValues) -> Iterator[pd.DataFrame]:
        began = time.monotonic()
        now = lambda: int(1000 * time.time())  # noqa: E731 - the batch's own clock was read when it began
        free = self.free.get()[0] if self.free.exists() else 0
        left = sorted(k[0] for k in self.pending.keys()) if free <= now() else []  # read once, not for each request
        while left and free <= now() and time.monotonic() - began < TURN:  # pauses are the timer's
            first = left[0]
            try:
                got = self.client.bindings(self.pending.getValue((first,))[0])
            except Busy:
                free = now() + int(1000 * self.wait)
                break
            self.pending.removeKey((first,))
            left.pop(0)
            free = now() + int(1000 * self.pause)
            # a row without an id says that the request was answered
            yield pd.DataFrame({"lane": [key[0]] * (len(got) + 1), "chunk": [first] * (len(got) + 1), "pos": range(-1, len(got)), "id": [None, *(i for i, _ in got)], "label": [None, *(x for _, x in got)]})
        self.free.update((free,))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if next(iter(self.pending.keys()), None) is not None:
            self.handle.registerTimer(max(int(timerValues.getCurrentProcessingTimeInMs()) + 1, free))

    def close(self) -> None:
        pass


def start(spark: SparkSession, source: str, make: Callable, sink: str, checkpoint: str, pause: float = 3.0, wait: float = 5.0, every: str = "0 seconds") -> StreamingQuery:
    """Ask for each request (REQUESTS, Parquet files that keep arriving in ``source``) and append ANSWERS to ``sink``.

    Goes on until it is stopped; started again, it continues with what was pending. An answer whose batch was broken off is
    asked for again and written once, with that batch.
    """
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    lanes = spark.readStream.schema(REQUESTS).parquet(source).groupBy("lane")
    answers = lanes.transformWithStateInPandas(Lane(make, pause, wait), ANSWERS, "Append", "ProcessingTime")
    query = answers.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    for k, v in before.items():  # the stream has its own copy of the session's settings
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return query


def answered(spark: SparkSession, sink: str) -> DataFrame:
    """(lane, chunk, pos, id, label) so far, and a row with pos -1 for each request that is answered."""
    return spark.read.schema(ANSWERS).parquet(sink)


def work_through(spark: SparkSession, source: str, make: Callable, sink: str, checkpoint: str, requests: int, pause: float = 3.0, wait: float = 5.0, most: float = 600.0) -> DataFrame:
    """Run until ``requests`` have been answered and return ``answered``; an error after ``most`` seconds, with what is answered kept."""
    query, began = start(spark, source, make, sink, checkpoint, pause, wait), time.monotonic()
    try:
        while time.monotonic() - began < most:
            if query.exception() is not None:
                raise query.exception()
            try:
                if answered(spark, sink).where("pos = -1").count() >= requests:
                    break
            except Exception as e:  # nothing is written yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise
            time.sleep(0.2)
        else:
            raise TimeoutError(f"fewer than {requests} requests were answered in {most} seconds")
    finally:
        query.stop()
    return answered(spark, sink)
