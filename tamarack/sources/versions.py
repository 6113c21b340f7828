"""JSON maps and arrays that grow by generations.

An append writes its rows beside what is there and then a manifest that lists all parts, the newest last. Nothing
is ever overwritten or moved: readers take the newest whole manifest, so a writer that stops at any step leaves what was
there before, and of two writers that append at once the later one fails instead of losing the other's rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.sources import entries

#: A manifest's last line: one that lacks it was never finished.
END = "end"


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions_of(path: str) -> str:
    return path.rstrip("/") + ".versions"


def _manifests(spark: SparkSession, path: str) -> list[str]:
    fs, at = _store(spark, versions_of(path))
    if not fs.exists(at):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().startswith("manifest-"))


def current(spark: SparkSession, path: str) -> list[str]:
    """The parts of a map or array in order, none where nothing is written yet."""
    for name in reversed(_manifests(spark, path)):
        lines = [r[0] for r in spark.read.text(name).collect()]  # a line for each append since the last compaction
        if lines and lines[-1] == END:
            return lines[:-1]
    fs, at = _store(spark, path)
    return [path] if fs.exists(at) else []


def commit(spark: SparkSession, path: str, parts: list[str], after: int) -> None:
    """Make ``parts`` the newest generation, the one that follows ``after`` manifests."""
    fs, at = _store(spark, f"{versions_of(path)}/manifest-{after + 1:08d}")
    out = fs.create(at, False)  # fails where another writer has been faster
    out.write(bytearray("\n".join([*parts, END]).encode()))
    out.close()


def _bracketed(opens: str, closes: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            out = []
            for text in batch.column("value").to_pylist():
                out.append((opens if first else ",") + text)
                first = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array([closes])], ["value"])

    return run


def write_parts(rows: DataFrame, key: str, value: Column, folder: str, mode: str = "errorifexists") -> None:
    """A JSON object from each task, an entry a line, keys in order over all of them: for maps of any size."""
    named = rows.select(F.col(key).cast("string").alias("_key"), value.alias("_value"))
    dealt = named.repartitionByRange("_key").sortWithinPartitions("_key")
    entry = F.to_json(F.create_map("_key", "_value"), {"ignoreNullFields": "false"})
    lines = dealt.select(entry.alias("e")).select(F.expr("substr(e, 2, length(e) - 2)").alias("value"))
    lines.mapInArrow(_bracketed("{", "}"), "value string").write.mode(mode).text(folder)


def write_list_parts(rows: DataFrame, order: str, folder: str) -> None:
    """A JSON array from each task, an item a line, in the order of one column, which is none of the items' own."""
    dealt = rows.repartitionByRange(order).sortWithinPartitions(order)
    item = F.to_json(F.struct(*[c for c in rows.columns if c != order]))
    dealt.select(item.alias("value")).mapInArrow(_bracketed("[", "]"), "value string").write.text(folder)


def _appended(spark: SparkSession, path: str, write) -> None:
    known, parts = len(_manifests(spark, path)), current(spark, path)
    folder = f"{versions_of(path)}/part-{uuid.uuid4().hex}"
    write(folder)
    commit(spark, path, [*parts, folder], known)


def append_map(rows: DataFrame, path: str) -> None:
    """Add (key, value) to a JSON map, which is made where there is none; new values stand for old ones. Only the new rows are written."""
    _appended(rows.sparkSession, path, lambda folder: write_parts(rows, "key", F.col("value"), folder))


def append_list(rows: DataFrame, order: str, path: str) -> None:
    """Add items to the end of a JSON array."""
    _appended(rows.sparkSession, path, lambda folder: write_list_parts(rows, order, folder))


def _ordered(rows: DataFrame, k: int) -> DataFrame:
    """A part's rows with what their order follows: the part, the task that wrote the file, the place in it."""
    number = F.coalesce(F.regexp_extract("file", r"part-(\d+)-", 1).try_cast("long"), F.lit(0))
    return rows.withColumn("order", F.struct(F.lit(k).alias("part"), number.alias("number"), F.col("file").alias("file"), F.col("pos").alias("pos"))).drop("file", "pos")


def read_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(order, key, value) of the newest generation; of a key's values the last one. ``order`` sorts entries as they were written."""
    parts = current(spark, path)
    if not parts:
        raise FileNotFoundError(path)
    every = [_ordered(entries.map_entries(spark, p, value), k) for k, p in enumerate(parts)]
    rows = every[0]
    for more in every[1:]:
        rows = rows.unionByName(more)
    last = rows.groupBy("key").agg(F.max_by(F.struct("order", "value"), "order").alias("x"))
    return last.select("x.order", "key", "x.value")


def read_list(spark: SparkSession, path: str, item: str) -> DataFrame:
    """(order, item's fields) of a JSON array of objects; ``item`` is their schema."""
    parts = current(spark, path)
    if not parts:
        raise FileNotFoundError(path)
    every = [_ordered(entries.entries(spark, p, "["), k) for k, p in enumerate(parts)]
    rows = every[0]
    for more in every[1:]:
        rows = rows.unionByName(more)
    return rows.select("order", F.from_json("entry", item).alias("x")).select("order", "x.*")


def replaced(spark: SparkSession, path: str, parts: list[str]) -> None:
    """A generation that stands in place of all before it."""
    commit(spark, path, parts, len(_manifests(spark, path)))


def compact(spark: SparkSession, path: str, value: str) -> None:
    """One part in place of all appends so far; the old ones stay for whoever still reads them."""
    known = len(_manifests(spark, path))
    folder = f"{versions_of(path)}/part-{uuid.uuid4().hex}"
    write_parts(read_map(spark, path, value), "key", F.col("value"), folder)
    commit(spark, path, [folder], known)
