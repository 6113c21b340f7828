"""Masking of entities and properties on both sides of a question-answer pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import text
from tamarack.operators.relations import assert_covers


def label_match(question: Column, label: Column, mode: str = "literal") -> Column:
    """struct(label, start, end) of the label's first place in the question, counted from 1; start null if it has none.

    'literal' looks for the label's characters. 'regex' reads a label as a pattern in which only brackets are
    literal; a label that is no valid pattern then fails the job. ``masked_pairs`` replaces the label as a pattern throughout, brackets
    too, as the format does: a label in brackets is found as it stands, and then each of its characters is replaced.
    """
    if mode == "literal":
        start, size = F.position(label, question), F.length(label)
    else:
        pattern = F.regexp_replace(label, r"([\[\]])", r"\\$1")
        start, size = F.regexp_instr(question, pattern), F.length(F.regexp_substr(question, pattern))
    start = F.when((label != "") & (start > 0), start)
    return F.struct(label.alias("label"), start.alias("start"), (start + size - 1).alias("end"))


def best_match(question: Column, labels: Column, mode: str = "literal") -> Column:
    """The first listed label that the question holds, not the longest; null if none does."""
    return F.try_element_at(F.filter(F.transform(labels, lambda x: label_match(question, x, mode)), lambda m: m["start"].isNotNull()), F.lit(1))


def collides(matches: Column) -> Column:
    """Do two matches, sorted by place, overlap."""
    placed = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
    return (F.size(placed) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(placed) - 1, F.lit(1))), lambda i: F.get(placed, i - 1)["end"] >= F.get(placed, i)["start"])


def collisions_by_window(matches: DataFrame) -> DataFrame:
    """uids with overlapping matches, over (uid, start, end) rows."""
    following = F.lead("start").over(Window.partitionBy("uid").orderBy("start", "end"))
    return matches.withColumn("_next", following).where(F.col("end") >= F.col("_next")).select("uid").distinct()


def numbered(matches: Column) -> Column:
    """Matches (sorted by id) with a mask each: the letter of their id and a count of its kind."""
    def mask(m: Column, i: Column) -> Column:
        kind = F.substring(m["id"], 1, 1)
        upto = F.size(F.filter(F.slice(matches, F.lit(1), i + 1), lambda x: F.substring(x["id"], 1, 1) == kind))
        return F.struct(m["id"].alias("id"), m["label"].alias("label"), F.concat(kind, upto.cast("string")).alias("mask"))

    return F.transform(matches, mask)


def masked_pairs(pairs: DataFrame, ids: DataFrame, labels: DataFrame, mode: str = "literal", safe_ids: bool = False) -> DataFrame:
    """(uid, q, a) of the pairs whose ids all have a label in the question and whose labels do not overlap there.

    ``pairs``: (uid, q, a), a null question being empty; ``ids``: (uid, ids); ``labels``: (id, labels), any order
    of rows. Replacements go in id order, each over the whole text, and see what earlier ones wrote. A pair without
    ids stays as it is. ``safe_ids`` keeps an id from matching inside a longer one.
    """
    pairs = pairs.select("uid", F.coalesce("q", F.lit("")).alias("q"), "a")
    # ids meet their labels first, and only these small lists meet the texts, once
    flat = ids.select("uid", F.explode_outer("ids").alias("id")).join(labels, "id", "left")
    lists = flat.groupBy("uid").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))))).alias("ls"))
    each = pairs.join(lists, "uid").select("uid", "q", "a", F.explode_outer("ls").alias("l"))
    m = best_match(F.col("q"), F.col("l.labels"), mode)
    match = F.when(F.col("l").isNotNull(), F.struct(F.col("l.id").alias("id"), F.col("m.label").alias("label"), F.col("m.start").alias("start"), F.col("m.end").alias("end")))
    # the rows of a pair are where the join left them
    grouped = each.withColumn("m", m).groupBy("uid").agg(F.first("q").alias("q"), F.first("a").alias("a"), F.array_sort(F.collect_list(match)).alias("ms"))
    kept = grouped.where(F.forall("ms", lambda m: m["start"].isNotNull())).where(~collides(F.col("ms")))
    steps = kept.withColumn("ms", numbered(F.col("ms")))
    if mode == "literal":
        question = text.folded(F.col("q"), F.col("ms"), "label", "mask")
    else:
        question = F.aggregate("ms", F.col("q"), lambda acc, m: F.regexp_replace(acc, m["label"], m["mask"]))
    if safe_ids:
        answer = F.aggregate("ms", F.col("a"), lambda acc, m: F.regexp_replace(acc, F.concat(m["id"], F.lit("(?![0-9])")), m["mask"]))
    else:
        answer = text.folded(F.col("a"), F.col("ms"), "id", "mask")
    return steps.select("uid", question.alias("q"), answer.alias("a"))


def mask_task(source: DataFrame, translations: DataFrame, ids: DataFrame, labels: DataFrame, mode: str = "literal") -> DataFrame:
    """The whole task: a missing translation is an empty question, a missing row of the id map an error."""
    assert_covers(source, ids, "uid")
    pairs = source.select("uid", F.col("sparql_wikidata").alias("a")).join(translations.select("uid", F.col("question").alias("q")), "uid", "left").select("uid", "q", "a")
    return masked_pairs(pairs, ids, labels, mode)

