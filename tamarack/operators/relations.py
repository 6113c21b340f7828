"""Joins, set operations, ranks and assertions that the tasks are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.sources.scratch import stored


class MissingKeys(ValueError):
    """A relation lacks keys that another one has."""


def assert_covers(keys: DataFrame, of: DataFrame, key: str) -> None:
    """Every key of ``keys`` must be in ``of``; up to five that aren't are named."""
    missing = [r[0] for r in keys.select(key).distinct().join(of.select(key), key, "left_anti").limit(5).collect()]
    if missing:
        raise MissingKeys(f"no row for {key} {', '.join(map(str, missing))}")


def assert_disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    both = [r[0] for r in left.select(key).join(right.select(key), key, "left_semi").limit(5).collect()]
    if both:
        raise ValueError(f"{key} on both sides: {', '.join(map(str, both))}")


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has."""
    a, b = (x.select(key).distinct() for x in (left, right))
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def updated(rows: DataFrame, changes: DataFrame, key: str, change) -> DataFrame:
    """Left outer update: ``change(row columns, change columns)`` where a change exists; unmatched rows pass."""
    return change(rows.join(changes, key, "left"))


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys still to be worked on."""
    return wanted.select(key).distinct().join(done.select(key), key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Union in which a key's row from ``new`` replaces that of ``old``; no window, just what isn't replaced and the new."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def first_of_key(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c != key]
    least = rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("first"))
    return least.select(key, *[F.col("first")[c].alias(c) for c in rest])


def ranked(rows: DataFrame, order: Column | list[Column], name: str = "rank", total: str | None = None) -> DataFrame:
    """``rows`` with their place (from 1) in an order, and their number as ``total`` if it is named.

    Spark deals the rows by ranges of the order itself, which its own sample finds, whatever the keys look like; equal keys are
    dealt by the task that read them, so that even one key of very many rows is spread. Each range is sorted and written
    once, numbered from its own beginning. What is added to a row's number is the count of the ranges before: one row
    for each task. Ties have an arbitrary order, but one for all that is read from the result.
    """
    order = order if isinstance(order, list) else [order]
    keys = [f"_key{k}" for k in range(len(order))]
    keyed = rows.withColumns({**dict(zip(keys, order, strict=True)), "_task": F.spark_partition_id()})
    dealt = keyed.repartitionByRange(*keys, "_task").sortWithinPartitions(*keys, "_task").drop(*keys, "_task")
    numbered = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    here, every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    before = counts.select("_part", F.coalesce(F.sum("_n").over(here), F.lit(0)).alias("_before"), *([F.sum("_n").over(every).alias(total)] if total else []))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = numbered.withColumn("_part", part).join(F.broadcast(before), "_part")  # as many rows as tasks wrote
    return joined.withColumn(name, inside + F.col("_before") + 1).drop("_at", "_part", "_before")


def chunked(rows: DataFrame, order: Column | list[Column], size: int) -> DataFrame:
    """``rows`` with a chunk number: ``size`` rows each in the given order, the last may have fewer."""
    if size < 1:
        raise ValueError("a chunk holds one row at least")
    return ranked(rows, order, "_rank").withColumn("chunk", F.floor((F.col("_rank") - 1) / size).cast("long")).drop("_rank")


def drawn(key: Column, seed: int) -> Column:
    """A hash of a key and a seed that any engine finds the same."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))


def sampled(rows: DataFrame, key: Column, most: int, seed: int = 0) -> DataFrame:
    """``most`` rows in the order of a hash of their key: random, but the same in every run."""
    return rows.orderBy(drawn(key, seed), key).limit(most)


def shuffled(rows: DataFrame, key: Column, seed: int = 0) -> DataFrame:
    return rows.orderBy(drawn(key, seed), key)


def sharded(rows: DataFrame, key: Column, shards: int, shuffle: bool = True, seed: int = 0) -> DataFrame:
    """``rows`` with the shard (from 0) that reads each: dealt by hash, or by turns in the order of a whole-number key."""
    if shards < 1:
        raise ValueError("there is one shard at least")
    turn = F.conv(F.substring(drawn(key, seed), 1, 8), 16, 10).cast("long") if shuffle else key
    return rows.withColumn("shard", F.pmod(turn, F.lit(shards)).cast("int"))


def zipped(left: DataFrame, right: DataFrame, on: str = "idx") -> DataFrame:
    """Positional join of two numbered relations; both must have the same numbers."""
    joined = left.join(right.withColumn("_there", F.lit(True)), on, "full_outer").withColumn("_here", F.col(left.columns[-1]).isNotNull())
    fine = F.col("_there").isNotNull() & F.col("_here")
    return joined.withColumn(on, F.when(fine, F.col(on)).otherwise(F.raise_error(F.lit("the sides differ in length")).cast("long"))).drop("_there", "_here")
