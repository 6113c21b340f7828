"""Comparison of proposed translations and maskings with a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions import text


def _percentage():
    return F.when(F.col("total") == 0, 0.0).otherwise(100 * F.col("differences") / F.col("total")).alias("percentage")


def validate_translation(proposal: DataFrame, reference: DataFrame) -> DataFrame:
    """(differences, total, percentage). Reference rows that nothing was proposed for do not count; the reverse is an error."""
    there = reference.select("uid", F.col("question").alias("_reference"), F.lit(True).alias("_there"))
    joined = proposal.join(there, "uid", "left")
    missing = F.raise_error(F.concat(F.lit("no reference for uid "), F.col("uid").cast("string"))).cast("boolean")
    differs = F.coalesce(F.when(F.col("_there"), ~F.col("question").eqNullSafe(F.col("_reference"))), missing)
    return joined.agg(F.coalesce(F.sum(differs.cast("long")), F.lit(0)).alias("differences"), F.count("*").alias("total")).select("differences", "total", _percentage())


def validate_masking(proposal: DataFrame, reference: DataFrame, strict: bool = False) -> DataFrame:
    """(part, differences, total, percentage) for questions and answers, up to the numbers of masks; key sets must be equal."""
    theirs = reference.select("uid", F.col("q").alias("_q"), F.col("a").alias("_a"), F.lit(True).alias("_theirs"))
    joined = proposal.withColumn("_ours", F.lit(True)).join(theirs, "uid", "full_outer")
    alone = F.raise_error(F.concat(F.lit("uid on one side only: "), F.col("uid").cast("string"))).cast("boolean")
    both = F.col("_ours") & F.col("_theirs")
    flags = [F.coalesce(F.when(both, ~text.alpha_equivalent(F.col(p), F.col(f"_{p}"), strict)), alone).alias("differs") for p in ("q", "a")]
    parts = joined.select(F.explode(F.array(*[F.struct(F.lit(n).alias("part"), f) for n, f in zip(("question", "answer"), flags, strict=True)])).alias("x")).select("x.*")
    return parts.groupBy("part").agg(F.sum(F.col("differs").cast("long")).alias("differences"), F.count("*").alias("total")).select("part", "differences", "total", _percentage())


def verdict(report: DataFrame) -> bool:
    return report.where("differences > 0").isEmpty()
