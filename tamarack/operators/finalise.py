"""Finished parallel text and its partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions import text
from tamarack.operators.relations import ranked


def finished(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"q": text.question_finished(F.col("q")), "a": text.answer_finished(F.col("a"))})


def partitioned(pairs: DataFrame, split: str, fraction: float) -> DataFrame:
    """(part, idx, nl, ql): of a train split, the first floor(n * fraction) pairs are to validate; a test split stays whole.

    The order is that of the uid as text (or of ``pos``, where a file gave one); idx counts from 0 in each part.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("a fraction is between 0 and 1")
    order = F.col("pos") if "pos" in pairs.columns else F.col("uid").cast("string")
    placed = ranked(pairs, order, "_place", "_total")
    if split == "test":
        return placed.select(F.lit("test").alias("part"), (F.col("_place") - 1).alias("idx"), F.col("q").alias("nl"), F.col("a").alias("ql"))
    cut = placed.withColumn("_most", F.floor(F.col("_total") * F.lit(fraction)).cast("long"))
    part = F.when(F.col("_place") <= F.col("_most"), "validate").otherwise("train")
    idx = F.col("_place") - 1 - F.when(F.col("_place") > F.col("_most"), F.col("_most")).otherwise(0)
    return cut.select(part.alias("part"), idx.alias("idx"), F.col("q").alias("nl"), F.col("a").alias("ql"))
