"""Epochs of a training: each is scored, the state of the best so far is kept, and a run that stops goes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import evaluation
from tamarack.sources.files import exists, readable

SCORES = "epoch long, n long, bleu double"


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """(epoch, n, bleu) of the epochs that are done."""
    known = readable(spark, f"{folder}/scores", SCORES)
    return spark.createDataFrame([], SCORES) if known is None else known


def run(spark: SparkSession, folder: str, epochs: int, state: Callable[[int], DataFrame], pairs: Callable[[int, DataFrame], DataFrame]) -> DataFrame:
    """Run what is left of ``epochs`` and return (epoch, n, bleu, best_before, improved).

    ``state(e)`` gives an epoch's state as a table, ``pairs(e, state)`` its (idx, pred, refs). A state is saved exactly where its
    score is strictly above all before, in a folder of its own, before the score is: the score is what tells that an
    epoch is done. A run that stops between the two does that epoch again and writes its state anew.
    """
    done = {r.epoch: r.bleu for r in scored(spark, folder).collect()}  # a row for each epoch
    for e in range(epochs):
        if e in done:
            continue
        now = state(e)
        score = evaluation.scores(pairs(e, now)).first()
        if all(score.bleu > b for k, b in done.items() if k < e):
            now.write.mode("overwrite").parquet(snapshot(folder, e))
        spark.createDataFrame([(e, score.n, score.bleu)], SCORES).coalesce(1).write.mode("append").parquet(f"{folder}/scores")
        done[e] = score.bleu
    return evaluation.improvements(scored(spark, folder))


def snapshot(folder: str, epoch: int) -> str:
    return f"{folder}/state-{epoch:06d}"


def best_state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The saved state of the best epoch, the first of equals; None where none has been scored."""
    best = scored(spark, folder).orderBy(F.desc("bleu"), "epoch").first()
    if best is None or not exists(spark, snapshot(folder, best.epoch)):
        return None
    return spark.read.parquet(snapshot(folder, best.epoch))
