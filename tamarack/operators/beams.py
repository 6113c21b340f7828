"""Beam search over given log probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions import arrays
from tamarack.sources.scratch import stored

#: The score of anything after an end token: a fixed value.
IMPROBABLE = -1e20
#: How much two log probabilities may differ and still give one score when a long sequence's is added.
NEAR = 1e-6


def top_beams(scores: DataFrame, k: int) -> DataFrame:
    """One step for many sequences: of (seq, step, beam, parent_score, logprobs), the k best successors.

    Returns (seq, step, rank, dep_beam, token, score). Ties go to the smaller place in beams times vocabulary.
    """
    flat = scores.select("seq", "step", "beam", "parent_score", F.posexplode("logprobs").alias("token", "lp")).withColumn("score", F.col("parent_score") + F.col("lp"))
    rank = F.row_number().over(Window.partitionBy("seq", "step").orderBy(F.desc("score"), "beam", "token"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= k).select("seq", "step", (F.col("rank") - 1).alias("rank"), F.col("beam").alias("dep_beam"), "token", "score")


def candidates(logprobs: DataFrame, k: int) -> DataFrame:
    """(seq, n, rows): the steps of each sequence, counted from 1, with what each of the beams 0 to k - 1 may go on with.

    A beam's successors among the k best of all beams are among its own k best, or as good as those once scores are
    added and rounded, or the first k tokens where nothing tells them apart any more.
    """
    best = F.array_sort(F.transform("logprobs", lambda x: -x))
    edge = -F.get(best, F.least(F.lit(k), F.size("logprobs")) - 1) - NEAR
    some = F.filter(F.transform("logprobs", lambda x, i: F.struct(i.cast("int").alias("token"), x.alias("lp"))), lambda c: (c["lp"] >= F.col("edge")) | (c["token"] < k))
    each = logprobs.withColumn("edge", edge).select("seq", "step", "beam", some.alias("options"))
    few = each.where(F.col("beam").between(0, k - 1))
    none = F.array().cast("array<struct<token:int,lp:double>>")
    # a beam's options stand at its number, so that one without any leaves the others where they are
    own = lambda found, b: F.coalesce(F.get(F.filter(found, lambda x: x["beam"] == b), F.lit(0))["options"], none)
    steps = few.groupBy("seq", "step").agg(F.collect_list(F.struct("beam", "options")).alias("found"))  # k at most
    steps = steps.select("seq", "step", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda b: own(F.col("found"), b)).alias("rows"))
    return steps.withColumn("n", F.row_number().over(Window.partitionBy("seq").orderBy("step"))).select("seq", "n", "rows")


#: Every row holds one sequence's beams, best first; the next step's come from them and the options that follow each.
SEARCH = """WITH RECURSIVE search(seq, n, beams, finished, best_ended) MAX RECURSION LEVEL {{level}} AS (
  SELECT seq, 0, array(named_struct('score', CAST(0 AS DOUBLE), 'token', {start}, 'dep', 0)), 0, false FROM (SELECT seq FROM {{steps}} WHERE n = 1)
  UNION ALL
  SELECT seq, n, beams, finished + size(filter(beams, b -> b.token = {end})), best_ended OR coalesce(get(beams, 0).token = {end}, false) FROM (
    SELECT s.seq, t.n, s.finished, s.best_ended, transform(slice(array_sort(flatten(transform(slice(t.rows, 1, size(s.beams)), (options, i) ->
      transform(options, c -> named_struct('loss', -(CASE WHEN s.n > 0 AND s.beams[i].token = {end} THEN {improbable} ELSE s.beams[i].score + c.lp END), 'dep', i, 'token', c.token))))), 1, {k}),
      x -> named_struct('score', -x.loss, 'token', x.token, 'dep', x.dep)) AS beams
    FROM search s JOIN {{steps}} t ON t.seq = s.seq AND t.n = s.n + 1 WHERE NOT (s.best_ended AND s.finished >= {k})))
  SELECT seq, n, beams FROM search WHERE n > 0"""

#: From final beams back to the first step, one token a round.
TRACE = """WITH RECURSIVE path(seq, rank, score, n, at, tokens) MAX RECURSION LEVEL {{level}} AS (
  SELECT seq, rank, score, n, at, CAST(array() AS array<int>) FROM {{final}}
  UNION ALL
  SELECT p.seq, p.rank, p.score, p.n - 1, c.dep, concat(array(c.token), p.tokens) FROM path p JOIN {{chosen}} c ON c.seq = p.seq AND c.n = p.n AND c.at = p.at)
  SELECT seq, rank, score, CASE WHEN array_contains(tokens, {end}) THEN slice(tokens, 1, CAST(array_position(tokens, {end}) AS INT) - 1) ELSE tokens END AS tokens FROM path WHERE n = 0"""


def _recursive(spark: SparkSession, query: str, level: int, **frames: DataFrame) -> DataFrame:
    # Spark's bound on rows is meant for recursions that never end; these end with the steps that they join
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(query, level=level, **frames)


def searched(logprobs: DataFrame, k: int, start: int, end: int) -> tuple[DataFrame, int]:
    """(seq, n, at, score, token, dep): the beams chosen at each step with the ones they follow, and the number of steps.

    A sequence is done when its best beam has ended at some step and k beams have ended in all.
    """
    spark = logprobs.sparkSession
    steps = stored(candidates(logprobs, k), "steps")
    most = steps.agg(F.max("n")).first()[0] or 0
    query = SEARCH.format(start=start, end=end, k=k, improbable=f"CAST({IMPROBABLE} AS DOUBLE)")
    beams = stored(_recursive(spark, query, most + 2, steps=steps), "beams")
    return beams.select("seq", "n", F.posexplode("beams").alias("at", "b")).select("seq", "n", "at", "b.*"), most


def final(chosen: DataFrame, k: int, end: int) -> DataFrame:
    """(seq, rank, score, n, at): the ended beams by score, filled up with the best of the last step's others; with none ended, its first beam comes first besides."""
    ended = F.col("token") == end
    whole = chosen.withColumns({"last": F.max("n").over(Window.partitionBy("seq")), "some": F.max(ended.cast("int")).over(Window.partitionBy("seq"))})
    last = F.col("n") == F.col("last")
    roles = F.array_compact(F.array(F.when(ended | (last & (F.col("at") == 0) & (F.col("some") == 0)), F.lit(0)), F.when(last & ~ended, F.lit(1))))
    each = whole.select("seq", "n", "at", "score", F.explode(roles).alias("role"))
    rank = F.row_number().over(Window.partitionBy("seq").orderBy("role", F.desc("score"), "n", "at")) - 1
    return each.withColumn("rank", rank).where(F.col("rank") < k).select("seq", "rank", "score", "n", "at")


def decode(logprobs: DataFrame, k: int, start: int, end: int) -> DataFrame:
    """(seq, rank, score, tokens) of the k final beams of each sequence, given (seq, step, beam, logprobs) for every step.

    Both directions are recursive queries: forward, each round joins the beams so far with the next step's options of all
    sequences; backward, each final beam follows its pointers. Rounds are as many as the longest sequence has steps.
    """
    chosen, most = searched(logprobs, k, start, end)
    query = TRACE.format(end=end)
    return _recursive(logprobs.sparkSession, query, most + 2, final=final(chosen, k, end), chosen=chosen)


def padded(beams: DataFrame, length: int, pad: int = 0) -> DataFrame:
    """``beams`` with tokens of one length: cut, or filled with the padding id."""
    return beams.withColumn("tokens", arrays.padded(F.col("tokens"), length, pad))


#: Words that are looked up by a broadcast of them alone: the commonest ones.
COMMON = 20_000


def sentences(beams: DataFrame, words: DataFrame, pad: int = 0) -> DataFrame:
    """(seq, sentence): the best beam cut at the padding id, its ids as words.

    Most places hold one of few words. Those are joined where their sequence's row lies, and only rare words' ids travel to the
    vocabulary, each with its sequence and place.
    """
    best = stored(beams.where("rank = 0").select("seq", arrays.before(F.col("tokens"), pad).alias("t")), "best")
    counts = best.select(F.explode("t").alias("id")).groupBy("id").count()
    top = counts.orderBy(F.desc("count"), "id").limit(COMMON)
    common = F.broadcast(top.join(words.select("id", "token"), "id", "left").select("id", "token", F.lit(True).alias("common")))
    flat = best.repartition("seq").select("seq", F.posexplode_outer("t").alias("pos", "id")).join(common, "id", "left")
    rare = best.select("seq", F.posexplode("t").alias("pos", "id")).join(common.select("id"), "id", "left_anti")
    found = rare.join(words.select("id", "token"), "id").select("seq", F.struct("pos", "token").alias("x")).groupBy("seq").agg(F.collect_list("x").alias("rare"))
    near = flat.groupBy("seq").agg(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", "token"))).alias("l"))
    both = near.join(found, "seq", "left").select("seq", F.array_sort(F.concat("l", F.coalesce("rare", F.array().cast("array<struct<pos:int,token:string>>")))).alias("l"))
    return both.select("seq", F.array_join(F.transform("l", lambda x: x["token"]), " ").alias("sentence"))
