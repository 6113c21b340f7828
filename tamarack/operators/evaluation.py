"""Scores of predicted queries and of training."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import text
from tamarack.operators.beams import sentences
from tamarack.sources.scratch import stored


def evaluation_pairs(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """(idx, pred, refs) of predicted (idx, sentence) and true (idx, ql) queries."""
    joined = predictions.join(truths, "idx")
    return joined.select("idx", text.words_of(text.prediction_joined(F.col("sentence"))).alias("pred"), F.array(text.words_of(F.col("ql"))).alias("refs"))


def clipped(pred: list[str], refs: list[list[str] | None], n: int) -> int:
    """How many of a sentence's n-grams its references hold, each no more often than the reference that holds it most often."""
    of = lambda words: Counter(zip(*(words[k:] for k in range(n)), strict=False))
    theirs = [of(r) for r in refs if r is not None]
    return sum(min(c, max((t[g] for t in theirs), default=0)) for g, c in of(pred).items())


def _summed(names: list[str], orders: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row of sums for each batch: of its rows, of the columns that are named, and of clipped n-grams by order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [0] * orders
            differ = pa.Table.from_batches([batch.select(["p", "r"])])
            for pair in differ.filter(pc.is_valid(differ["p"])).to_pylist():
                for n in range(orders):
                    found[n] += clipped(pair["p"], pair["r"] or [], n + 1)
            sums = [pc.sum(batch.column(k)).as_py() or 0 for k in names]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (batch.num_rows, *sums, *found)], ["pairs", *names, *(f"hit{n}" for n in range(1, orders + 1))])

    return run


def scores(pairs: DataFrame, orders: int = 4) -> DataFrame:
    """(n, bleu): the number of pairs (idx, pred, refs) and their corpus BLEU times 100, uniform weights, unsmoothed.

    One pass without an exchange of pairs: each row has all that its sums need. Those of lengths are Spark's own; the n-grams of a pair are counted
    and clipped where it is read, and what leaves a task is a row of sums for each batch. A sentence that is one of its
    references has all of its n-grams there, so they need not be looked at. The closest reference length counts, the shorter of two.
    """
    hyp = F.size("pred")
    nearest = F.array_sort(F.transform("refs", lambda r: F.struct(F.abs(F.size(r) - hyp).alias("d"), F.size(r).alias("l"))))[0]["l"]
    # as the library counts: a sentence shorter than n still has one n-gram in the total
    same = F.coalesce(F.exists("refs", lambda r: r == F.col("pred")), F.lit(False))
    plain = {f"plain{n}": F.when(same, F.greatest(F.lit(0), hyp - n + 1)).otherwise(0) for n in range(1, orders + 1)}
    sums = {"ours": hyp, "theirs": nearest, **{f"total{n}": F.greatest(F.lit(1), hyp - n + 1) for n in range(1, orders + 1)}, **plain}
    hits = [f"hit{n}" for n in range(1, orders + 1)]
    # a pair's texts go to the helper only where it differs from its references
    told = pairs.select(*[v.cast("long").alias(k) for k, v in sums.items()], F.when(~same, F.col("pred")).alias("p"), F.when(~same, F.col("refs")).alias("r"))
    kinds = ", ".join(f"{k} long" for k in ("pairs", *sums, *hits))
    met = told.mapInArrow(_summed(list(sums), orders), kinds)
    row = met.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("pairs", *sums, *hits)])
    row = row.withColumns({f"hit{n}": F.col(f"hit{n}") + F.col(f"plain{n}") for n in range(1, orders + 1)})
    logs = [F.log(F.when(F.col(f"hit{n}") > 0, F.col(f"hit{n}") / F.col(f"total{n}")).otherwise(F.lit(2.2250738585072014e-308))) for n in range(1, orders + 1)]
    brevity = F.when(F.col("ours") > F.col("theirs"), 1.0).when(F.col("ours") == 0, 0.0).otherwise(F.exp(1 - F.col("theirs") / F.nullif(F.col("ours"), F.lit(0))))
    some = (F.col("hit1") > 0) & (F.col("ours") > 0)
    return row.select(F.col("pairs").alias("n"), F.when(some, 100 * brevity * F.exp(sum(logs[1:], logs[0]) / orders)).otherwise(0.0).alias("bleu"))


def corpus_bleu(pairs: DataFrame, orders: int = 4) -> DataFrame:
    """(bleu) of (idx, pred, refs)."""
    return scores(pairs, orders).select("bleu")


def running_loss(losses: DataFrame, digits: int = 4) -> DataFrame:
    """(epoch, step, loss) with the epoch's sum and rounded mean so far."""
    so_far = Window.partitionBy("epoch").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return losses.withColumn("loss_sum", F.sum("loss").over(so_far)).withColumn("loss_mean", F.round(F.avg("loss").over(so_far), digits))


def improvements(scores: DataFrame) -> DataFrame:
    """(epoch, bleu) with the best before and whether this one is strictly better. A training's epochs are few: one window holds them."""
    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return scores.withColumn("best_before", F.max("bleu").over(before)).withColumn("improved", F.col("best_before").isNull() | (F.col("bleu") > F.col("best_before")))


def epoch(best: DataFrame, words: DataFrame, truths: DataFrame, save: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """(n, bleu) of an evaluation epoch: beams (seq, rank, tokens) become sentences, meet the true queries (idx, ql), are
    handed to ``save`` where it is given, and are scored."""
    predictions = sentences(best, words).withColumnRenamed("seq", "idx")
    pairs = evaluation_pairs(predictions, truths)
    if save is not None:
        pairs = stored(pairs, "evaluated")
        save(pairs)
    return scores(pairs)
