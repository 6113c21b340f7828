"""What only odd or larger tables show."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tamarack.functions import lcs
from tamarack.operators import beams, evaluation, substrings
from tamarack.plans import queries as core
from tamarack.sources import files
from tamarack.streaming import paced


@pytest.mark.parametrize("name", ["beam_two_steps", "beam_search", "beam_search_greedy_ends"])
def test_beams_with_gaps(spark, sf, tmp_path, name):
    """Sequences without a step or a beam of it, and a last one that breaks off."""
    path = str(tmp_path / "embeddings.parquet")
    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 123 AND vec_id % 13 <> 5").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    columns = ["seq", "rank", "score", "tokens"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({core.oracle_sql()[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in core.queries()[name](spark, str(tmp_path)).collect()]
    key = lambda rows: sorted((s, r, round(x, 5), t) for s, r, x, t in rows)
    assert key(got) == key(want)


class Echo:
    def bindings(self, query):
        return [(query, f"label of {query}")]


def test_a_lane_asks_more_than_once_in_a_batch(spark, tmp_path):
    """Without a pause, requests are not worth a batch each."""
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([("one", k, f"Q{k}") for k in range(60)], paced.REQUESTS).write.parquet(source)
    found = paced.work_through(spark, source, Echo, sink, checkpoint, 60, pause=0.0, most=300)
    assert sorted(r.chunk for r in found.where("pos = 0").collect()) == list(range(60))
    assert len([x for x in (tmp_path / "state" / "commits").iterdir() if x.name.isdigit()]) < 20


def test_more_pairs_than_one_object_holds(spark, tmp_path, monkeypatch):
    """A map too large for one task's file is written in parts, replaces what was there and is read back in the same order."""
    path, rows = str(tmp_path / "pairs.json"), spark.range(300).select(F.col("id").alias("uid"), F.concat(F.lit("q"), "id").alias("q"), F.concat(F.lit("a"), "id").alias("a"))
    read = lambda: [(r.uid, r.q, r.a) for r in files.read_pairs(spark, path).orderBy("pos").collect()]
    want = [(k, f"q{k}", f"a{k}") for k in sorted(range(300), key=str)]
    files.write_pairs(rows.limit(3), path)
    monkeypatch.setattr(files, "MOST_ENTRIES", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_pairs(rows.repartition(4), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert read() == want and len(list((tmp_path / "pairs.json").glob("part-*"))) > 1
    monkeypatch.setattr(files, "MOST_ENTRIES", 1000)
    files.write_pairs(rows, path)
    assert read() == want


def test_scores_exchange_no_pairs(spark):
    """Pairs are scored where they lie, repeated ids each on their own."""
    rows = [(0, ["a", "b", "c", "d", "e"], [["a", "b", "c", "x"], ["d", "e", "a", "b"]]), (0, ["a", "a", "a"], [["a", "a"]]), (1, ["b"], [["b"]])]
    pairs = spark.createDataFrame(rows, "idx long, pred array<string>, refs array<array<string>>")
    scored = evaluation.scores(pairs)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Generate" not in plan
    got = scored.first()
    hits, totals = (5 + 2 + 1, 3 + 1, 1, 0), (5 + 3 + 1, 4 + 2 + 1, 3 + 1 + 1, 2 + 1 + 1)
    assert got.n == 3 and [sum(evaluation.clipped(p, r, n) for _, p, r in rows) for n in range(1, 5)] == list(hits)
    assert got.bleu < 1e-60 and evaluation.scores(pairs, 2).first().bleu == pytest.approx(100 * (hits[0] / totals[0] * hits[1] / totals[1]) ** 0.5)


def test_sentences_of_common_and_rare_words(spark, monkeypatch):
    """Words beyond the common ones, ids without a word and empty beams."""
    monkeypatch.setattr(beams, "COMMON", 2)
    words = spark.createDataFrame([(k, f"w{k}") for k in range(1, 9)], "id long, token string")
    found = [(0, 0, [1, 5, 2, 6, 1]), (1, 0, [2, 1, 99, 7]), (2, 0, []), (3, 0, [8, 0, 1]), (4, 0, [99]), (0, 1, [3])]
    frame = spark.createDataFrame(found, "seq long, rank int, tokens array<long>")
    got = {r.seq: r.sentence for r in beams.sentences(frame, words).collect()}
    assert got == {0: "w1 w5 w2 w6 w1", 1: "w2 w1 w7", 2: "", 3: "w8", 4: ""}


def test_common_substrings_of_cut_texts(spark, monkeypatch):
    """Texts longer than a cut, in more than one group on either side; no place is a row of its own."""
    monkeypatch.setattr(substrings, "CUT", 50)
    monkeypatch.setattr(substrings, "GROUP", 400)
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abc\n\ue000") for _ in range(n))
    left, right = [(k, make(rng.randint(1, 400))) for k in range(12)], [(k, make(rng.randint(1, 120))) for k in range(10)]
    frames = [spark.createDataFrame(x, "id long, text string") for x in (left, right)]
    found = substrings.longest_with_any(*frames)
    assert "posexplode" not in found._jdf.queryExecution().toString()
    want = {i: min((y for _, b in right if (y := lcs.longest(a, b))), key=lambda y: (-len(y), y)) for i, a in left}
    assert {r.id: (r.length, r.common) for r in found.collect()} == {i: (len(y), y) for i, y in want.items()}


def test_short_texts_are_quick():
    """A pair of names takes some tens of microseconds; arrays took a good many times that."""
    pairs = [(f"large ring {k}", f"economy ring Brand#{k}") for k in range(2000)]
    began = time.process_time()
    found = [lcs.longest(a, b) for a, b in pairs]
    assert time.process_time() - began < 0.4
    assert found == [lcs.longest(a + " " + "0" * 400, b + "1" * 400) for a, b in pairs[:1]] + found[1:]
