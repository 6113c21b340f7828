"""Subword ids: the longest piece that fits, from each word's front on.

Nothing is learnt here but which words are common: a piece is a common word or one character, and each may
begin a word or go on in one. Words of any length and texts of any number are split as relations: distinct words meet the
pieces at each of their places, and only what is longest there is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions import arrays, text
from tamarack.operators.encoding import CLS, FIRST, PAD, SEP
from tamarack.operators.relations import ranked


def words_of(texts: DataFrame, column: str) -> DataFrame:
    return texts.select(F.explode(text.words_of(F.lower(column))).alias("word"))


def pieces(texts: DataFrame, column: str, most: int = 30_000, longest: int = 32) -> DataFrame:
    """(piece, begins, id): the ``most`` commonest words of two to ``longest`` characters and every character there is, each as a beginning and as a
    continuation; ids by kind, count and piece. The table is small: ``most`` words and an alphabet, twice."""
    counts = words_of(texts, column).groupBy("word").agg(F.count("*").alias("n"))
    whole = counts.where(F.length("word").between(2, longest)).orderBy(F.desc("n"), "word").limit(most).select(F.lit(0).alias("kind"), (-F.col("n")).alias("order"), F.col("word").alias("piece"))
    letters = counts.select(F.explode(F.split("word", "")).alias("piece")).where("piece <> ''").distinct().select(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("order"), "piece")
    twice = whole.unionByName(letters).withColumn("begins", F.explode(F.array(F.lit(True), F.lit(False))))
    placed = ranked(twice, [F.col("kind"), F.col("order"), F.col("piece"), ~F.col("begins")], "place")
    return placed.select("piece", "begins", (F.col("place") + FIRST - 1).cast("int").alias("id"))


def segmented(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, ids) of distinct words: from the front the longest piece that fits, then the longest that goes on, to the end.

    ``known``: (piece, begins, id). A word with a character that is no piece, or an empty one, has no row.
    """
    known = known.select("piece", "begins", F.col("id").cast("int").alias("id"))
    longest = known.agg(F.max(F.length("piece"))).first()[0] or 0
    sized = words.select("word").distinct().withColumn("size", F.length("word"))
    places = sized.select("word", "size", F.posexplode(F.split("word", "")).alias("at", "c")).where("c <> ''").select("word", "size", "at")
    # a row for each place and length, so at most ``longest`` for a character
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.col("size") - F.col("at")))
    here = F.expr("substring(word, at + 1, length)")
    parts = places.withColumn("length", F.explode(lengths)).select("word", "size", "at", "length", here.alias("piece"), (F.col("at") == 0).alias("begins"))
    fits = parts.join(F.broadcast(known), ["piece", "begins"])
    best = fits.groupBy("word", "size", "at").agg(F.max(F.struct("length", "id")).alias("best"))
    steps = best.groupBy("word", "size").agg(F.array_sort(F.collect_list(F.struct("at", "best.length", "best.id"))).alias("steps"))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("ids"))
    walked = F.aggregate("steps", start, lambda s, x: F.when(x["at"] == s["next"], F.struct((s["next"] + x["length"]).alias("next"), F.concat(s["ids"], F.array(x["id"])).alias("ids"))).otherwise(s))
    return steps.withColumn("w", walked).where(F.col("w.next") == F.col("size")).select("word", F.col("w.ids").alias("ids"))


def encoded(points: DataFrame, column: str, known: DataFrame, length: int, ids: str = "ids", mask: str = "mask") -> DataFrame:
    """``points`` (idx, ...) as (idx, ids, mask): start, at most length - 2 pieces, end, padding.

    Each distinct word is split once, wherever it stands; no more words of a text are looked up than it may have pieces.
    """
    front = points.select("idx", F.slice(text.words_of(F.lower(column)), 1, length - 2).alias("words"))
    flat = front.select("idx", F.posexplode_outer("words").alias("pos", "word"))
    split = segmented(flat.where("word IS NOT NULL"), known)
    each = flat.join(split.withColumnRenamed("ids", "own"), "word", "left")
    lists = each.groupBy("idx").agg(F.array_sort(F.collect_list(F.when(F.col("own").isNotNull(), F.struct("pos", "own")))).alias("l"))
    tokens = F.slice(F.flatten(F.transform("l", lambda x: x["own"])), 1, length - 2)
    whole = F.concat(F.array(F.lit(CLS)), tokens, F.array(F.lit(SEP)))
    return lists.select("idx", arrays.padded(whole, length, PAD).alias(ids), arrays.attention(whole, length).alias(mask))
