"""Token ids and attention masks of parallel text, and its batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions import arrays, text
from tamarack.operators.relations import drawn, ranked, sampled

#: Ids before the vocabulary's.
PAD, CLS, SEP, UNKNOWN, FIRST = 0, 1, 2, 3, 4


def vocabulary(texts: DataFrame, column: str, most: int | None = 30_000) -> DataFrame:
    """(token, id): the commonest words, ids by falling count, then by token; None keeps all of them. Whole words: ``subwords`` learns parts."""
    counts = texts.select(F.explode(text.words_of(F.lower(column))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(most) if most is not None else counts
    placed = ranked(top, [-F.col("n"), F.col("token")], "_rank")
    return placed.select("token", (F.col("_rank") + FIRST - 1).cast("int").alias("id"))


def encoded(points: DataFrame, column: str, words: DataFrame, length: int, ids: str, mask: str, constant: str | None = None) -> DataFrame:
    """``points`` (idx, ...) as (idx, ids, mask): start, at most length - 2 words, end, padding. ``constant`` replaces the text."""
    source = F.lit(constant) if constant is not None else F.col(column)
    tokens = F.slice(text.words_of(F.lower(source)), 1, length - 2)
    flat = points.select("idx", F.posexplode_outer(tokens).alias("pos", "token")).join(words, "token", "left")
    one = F.when(F.col("token").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(UNKNOWN)).alias("id")))
    lists = flat.groupBy("idx").agg(F.array_sort(F.collect_list(one)).alias("l"))
    whole = F.concat(F.array(F.lit(CLS)), F.transform("l", lambda x: x["id"]), F.array(F.lit(SEP)))
    return lists.select("idx", arrays.padded(whole, length, PAD).alias(ids), arrays.attention(whole, length).alias(mask))


def data_points(points: DataFrame, inputs: DataFrame, outputs: DataFrame, in_length: int, out_length: int, stage: str) -> DataFrame:
    """Both halves of each point (idx, nl, ql). Outside of training the output half is that of the word 'None'."""
    left = encoded(points, "nl", inputs, in_length, "inp_ids", "inp_att_mask")
    right = encoded(points, "ql", outputs, out_length, "out_ids", "out_att_mask", None if stage == "train" else "None")
    return left.join(right, "idx")


def tensors(encoded_points: DataFrame, stage: str) -> DataFrame:
    """Columns that a stage reads."""
    return encoded_points if stage == "train" else encoded_points.select("idx", "inp_ids", "inp_att_mask")


def batched(points: DataFrame, size: int, order: Column | list[Column] | None = None) -> DataFrame:
    """``points`` with a batch number in the order of idx."""
    order = order if order is not None else F.col("idx")
    return ranked(points, order, "_rank").withColumn("batch", F.floor((F.col("_rank") - 1) / size).cast("long")).drop("_rank")


def raw_points(points: DataFrame, sample: bool = False, most: int = 1000, seed: int = 0) -> DataFrame:
    """All points of a stage, or at most ``most`` sampled ones for the evaluations during training."""
    return sampled(points, F.col("idx"), most, seed) if sample else points


def first_points(points: DataFrame, n: int = 5) -> DataFrame:
    return points.orderBy("idx").limit(n)


def loaded(points: DataFrame, inputs: DataFrame, outputs: DataFrame, in_length: int, out_length: int, stage: str, size: int, seed: int = 0) -> DataFrame:
    """The loader of a stage: encoded points, the columns it reads, and a batch for each; in training they are shuffled first."""
    ready = tensors(data_points(points, inputs, outputs, in_length, out_length, stage), stage)
    if stage != "train":
        return batched(ready, size)
    turn = F.conv(F.substring(drawn(F.col("idx"), seed), 1, 13), 16, 10).cast("long")
    return batched(ready, size, [turn, F.col("idx")])
