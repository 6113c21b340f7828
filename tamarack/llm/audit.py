"""Audit of five filters' interactions by replaying every order in which they could run.

Each document's failures are one small number, a bit for each filter. It is crossed with the 120 orders
(a fixed table, broadcast), the step of its first failure in each order is found, the five steps are
exploded, and conditional counts are combined before the shuffle: what leaves a task is one row for each
part, order and step, however many documents it read.
"""

from __future__ import annotations

import itertools
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm import kernels
from tamarack.llm.rules import STARTS_CHAR, _sums, word_equality
from tamarack.llm.shared import column, spread_join, stored, unclashed

FILTERS = "ABCDE"
LEAST_WORDS = 200
IS_SIGN = np.zeros(256, np.int64)
IS_SIGN[[ord(c) for c in "#$%&*|"]] = 1
IS_CAPITAL = np.zeros(256, np.int64)
IS_CAPITAL[ord("A") : ord("Z") + 1] = 1


def own_failures(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bits of the four filters that a text alone decides: A 1, B 2, C 4, D 8."""
    n = len(offsets) - 1
    starts, ends, rows = kernels.words(raw, offsets)
    words = np.bincount(rows, minlength=n)
    _, again = kernels.seen(rows, kernels.span_hashes(raw, starts, ends), word_equality(raw, starts, ends), lambda i: raw[starts[i] : ends[i]].tobytes())
    distinct = words - np.bincount(rows[again], minlength=n)
    chars, capitals, signs = (_sums(kind[raw], offsets[:-1], offsets[1:]) for kind in (STARTS_CHAR, IS_CAPITAL, IS_SIGN))
    return (words < LEAST_WORDS) + 2 * (100 * distinct < 50 * words) + 4 * (100 * capitals > 2 * chars) + 8 * (signs > 0)


def _flag(batches):
    for batch in batches:
        raw, offsets = kernels.buffers(batch.column("text"))
        found = [own_failures(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in kernels.slices(offsets)]
        marks = [sha256(raw[a:b].data).digest() for a, b in itertools.pairwise(offsets.tolist())]
        fails = pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), fails, pa.array(marks, pa.binary())], ["doc_id", "part", "fails", "mark"])


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, fails) for each row, ``fails`` with the bits of A to E.

    Texts are the same where their SHA-256 is. Of equal texts those fail E whose doc_id is above the least; a
    null doc_id is neither above nor below another and never fails E. A mark that very many rows share is met
    by a broadcast of at most a thousand of its kind, so copies do not gather in one task.
    """
    docs = unclashed(docs, id_col, text_col, part_col)
    plain = docs.select(column(docs, id_col, "long").alias("doc_id"), F.coalesce(column(docs, part_col, "string"), F.lit("")).alias("part"), column(docs, text_col, "string").alias("text"))
    own = stored(plain.mapInArrow(_flag, "doc_id long, part string, fails int, mark binary"), "audit-own")
    copies = stored(own.groupBy("mark").agg(F.min("doc_id").alias("least"), F.count("*").alias("fan")).where("fan > 1"), "audit-copies")
    joined = spread_join(own, copies, ["mark"], "fan")
    return joined.select("doc_id", "part", (F.col("fails") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)).alias("fails"))


def orders_table(spark) -> DataFrame:
    """(order_no, filter_order, b1 to b5): every order, and the bit of the filter at each step."""
    rows = ", ".join(f"({k}, '{''.join(order)}', {', '.join(str(1 << FILTERS.index(x)) for x in order)})" for k, order in enumerate(itertools.permutations(FILTERS)))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(order_no, filter_order, b1, b2, b3, b4, b5)")


def replay(failed: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of (part, fails, good, toxic)."""
    orders = orders_table(failed.sparkSession)
    first = F.expr(f"CASE {' '.join(f'WHEN (fails & b{k}) > 0 THEN {k}' for k in range(1, 6))} ELSE 6 END")
    crossed = failed.crossJoin(F.broadcast(orders.drop("filter_order"))).withColumn("first", first)
    steps = crossed.select("part", "order_no", "fails", "good", "toxic", "first", F.posexplode(F.array(*[f"b{k}" for k in range(1, 6)])).alias("at", "bit")).withColumn("step", F.col("at") + 1)
    count = lambda condition, name: F.count(F.when(F.expr(condition), 1)).alias(name)
    counted = steps.groupBy("part", "order_no", "step").agg(
        F.min("bit").alias("bit"), count("first > step", "kept"), count("first = step", "removed"), count("(fails & bit) > 0 AND first < step", "redundant"),
        count("fails = bit", "unique_fails"), count("first = step AND good", "good_lost"), count("first = step AND toxic", "toxic_lost"),
    )
    everywhere = F.sum("removed").over(Window.partitionBy("part", "bit"))
    named = counted.withColumn("shapley", everywhere).join(F.broadcast(orders.select("order_no", "filter_order")), "order_no")
    return named.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """600 rows for each part: what each step of each order of the five filters keeps, removes and loses.

    Null texts are empty, null parts the empty string; a table without the part column is one part. Repeated rows
    count each; rows of one doc_id with one text are no copies of each other. A document is good or toxic where any
    row of ``labels`` with its doc_id says 1; rows without a doc_id have no label. Texts of any length are read whole.
    An empty table has no parts and gives no rows. Other columns play no part, whatever their names.
    """
    failed = failures(docs, id_col, text_col, part_col)
    labels = unclashed(labels, "doc_id", "quality", "toxic")
    says = lambda c: F.coalesce(F.max(column(labels, c, "int") == 1), F.lit(False))
    known = labels.select(column(labels, "doc_id", "long").alias("doc_id"), *(column(labels, c, "int").alias(c) for c in ("quality", "toxic"))).groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    no = F.lit(False)
    told = failed.join(known, "doc_id", "left").select("part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return replay(told)
