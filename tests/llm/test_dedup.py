import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import LONG, empty, groups, odd_documents, shingles

from tamarack.llm import graph, minhash, vectors


def family(n, edits, seed=1, size=200):
    """A base text and n copies with a few words changed each: linked with the base more often than with each other."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = [base]
    for _ in range(n):
        copy = list(base)
        for k in rng.sample(range(size), edits):
            copy[k] = f"n{rng.randrange(10**6)}"
        out.append(copy)
    rng.shuffle(out)
    return [" ".join(x) for x in out]


def collected(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


@pytest.mark.parametrize(("size", "percent", "bands"), [(3, 85, 24), (5, 80, 32)])
def test_near_duplicates_against_all_pairs(spark, size, percent, bands, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 16)  # families are compared in several blocks
    texts = family(40, 3) + family(30, 6, 2) + family(5, 1, 3) + ["a b c d e f"] * 3 + ["short one", "Short ONE", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: shingles(t, size) for i, t in enumerate(texts)}
    wanted = groups(sets, percent)
    got = collected(minhash.near_duplicates(docs, size=size, percent=percent, bands=bands))
    assert got == {i: (len(sets[i]), wanted[i], wanted[i] == i) for i in sets}


def test_few_texts_are_shuffled(spark):
    """A filter keeps all chosen rows and hardly any other; of the texts, only those that share a bucket are read again."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") * 7 - 50_000).alias("sum"), F.lit("t").alias("text"))
    chosen = rows.where("doc_id % 100 = 3").drop("text")
    kept = {r.doc_id for r in minhash._perhaps(rows, chosen, ["doc_id", "sum"]).collect()}
    assert set(range(3, 20_000, 100)) <= kept and len(kept) < 220
    assert minhash._perhaps(rows, chosen.where("false"), ["doc_id", "sum"]).count() == 0
    assert minhash._perhaps(rows, rows.drop("text"), ["doc_id", "sum"]).count() == 20_000


def test_odd_documents(spark):
    got = minhash.near_duplicates(odd_documents(spark))
    rows = [(r.doc_id, r.component_id, r.kept) for r in got.collect()]
    assert len(rows) == 13
    assert sorted(x for x in rows if x[0] is not None) == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 6, False), (8, 8, True), (9, 8, False), (10, 10, True)]
    assert [x[1:] for x in rows if x[0] is None] == [(None, True)] * 2
    assert minhash.near_duplicates(empty(odd_documents(spark))).collect() == []


def one_id_many_texts():
    """Doc 5 comes with texts of equal size; 30 is near the first, 90 near the second, 91 near none; 7 holds a copy and a text of its own."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    return [(5, a), (5, b), (30, a + " x"), (90, b + " y"), (91, c), (7, a + " z"), (7, c[::-1]), (8, b), (8, b)]


def test_texts_of_one_id_keep_their_links(spark):
    rows = one_id_many_texts()
    wanted = {5: 5, 30: 5, 90: 5, 91: 91, 7: 5, 8: 5}
    for order in (rows, rows[::-1]):
        got = minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(5)).collect()
        assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == wanted


def test_repeated_ids_against_all_pairs(spark):
    rng = random.Random(5)
    texts = family(12, 4, 7, 60) + family(12, 6, 8, 60) + family(3, 1, 9, 60)
    rows = [(rng.randrange(14), t) for t in texts]
    sets = {k: shingles(t, 3) for k, (_, t) in enumerate(rows)}
    root = groups(sets, 85)
    wanted = {i: i for i, _ in rows}
    for _ in rows:  # ids join what they share, texts what they match
        for k, (i, _) in enumerate(rows):
            for j, (h, _) in enumerate(rows):
                if root[k] == root[j] or i == h:
                    wanted[i] = wanted[h] = min(wanted[i], wanted[h])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == wanted


def test_no_differing_text_is_dropped(spark):
    rows = one_id_many_texts() + [(None, "no id here at all"), (None, "no id here at all"), (4, ""), (4, ""), (3, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, sum int")
    kept = minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    a, b, c = rows[0][1], rows[1][1], rows[4][1]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, [(5, a), (5, b), (91, c), (7, c[::-1]), *rows[-5:]]))


def test_blocks_are_dealt_by_block(spark):
    """Neither the leader's members nor its copies meet in one task."""
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    texts = minhash._read(docs, "doc_id", "text")
    _, classes = minhash._classes(texts, 3, 24, 5)
    plan = minhash._links(texts, classes, 3, 85)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert re.search(r"FlatMapGroupsInArrow.*?\n.*?(Sort.*?\n.*?)?Exchange hashpartitioning\(lead#\d+L, i#\d+, j#\d+, v#\d+", physical, re.S)


def test_words_that_a_polynomial_hash_confuses(spark):
    from tests.llm.test_documents import thue_morse

    a, b = thue_morse()
    got = collected(minhash.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")))
    assert {i: r[1] for i, r in got.items()} == {1: 1, 2: 2, 3: 1}


def test_one_id_of_several_texts_joins_them(spark):
    a, b = "a b c d e f g h", "z y x w v u t s"
    docs = spark.createDataFrame([(5, a), (5, b), (3, a), (9, b)], "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(docs).collect()} == {3}


def test_signature_is_circular():
    """Coordinate k is the minimum over the places shifted by k under one and the same ranking, round its end."""
    rng = np.random.default_rng(0)
    last = np.arange(minhash.POSITIONS - 40, minhash.POSITIONS, dtype=np.uint64) << np.uint64(44)  # shifts carry these round
    order = minhash.ranks(60)[:, 0]
    for hashes in (rng.integers(0, 2**63, 50, dtype=np.uint64) * np.uint64(2), last, last[-1:]):
        places = (hashes >> np.uint64(44)).astype(int)
        wanted = [min(order[(p + k) % minhash.POSITIONS] for p in places) for k in range(60)]
        assert minhash.signature(hashes, 60).tolist() == wanted


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    random.Random(0).shuffle(path)
    edges = spark.createDataFrame(path + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100, 102: 100}


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    x = [base[i % 30] + rng.standard_normal(16) * (0.02, 0.12)[i % 2] for i in range(150)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200 + i, x[0].tolist()) for i in range(20)] + [(300, (2.0 * x[1]).tolist())]
    odd = [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [None] + [1.0] * 15), (404, [float("inf")] * 16), (405, []), (406, [1.0]), (None, x[0].tolist())]
    frame = spark.createDataFrame([(i, v, 1, "k") for i, v in rows + odd], "vec_id long, embedding array<double>, label int, keys string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame).collect()}
    ids = [i for i, _ in rows] + [None]
    m = np.array([v for _, v in rows] + [x[0]])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    sets = {i: {i} for i in range(len(ids))}
    for _ in range(len(ids)):
        now = {i: set.union(s, *(sets[j] for j in np.flatnonzero(near[i]))) for i, s in sets.items()}
        if now == sets:
            break
        sets = now
    for k, i in enumerate(ids):
        least = min(ids[j] for j in sets[k] if ids[j] is not None)
        assert got[i] == (int(near[k].sum()), least if i is not None else None, i is None or least == i)
    for i in (400, 401, 402, 403, 404, 405, 406):
        assert got[i] == (0, i, True)
    assert vectors.near_vectors(frame.where("1 = 0")).collect() == []


def test_long_text_is_read_to_its_end(spark):
    assert len(shingles(LONG, 3)) > 1000
    docs = spark.createDataFrame([(1, LONG), (2, LONG + " " + re.sub("w", "v", LONG))], "doc_id long, text string")
    got = collected(minhash.near_duplicates(docs))
    assert got[2][0] > got[1][0] and got[2][2]
