"""Beam search, common substrings, subwords and epochs against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tamarack.functions import lcs
from tamarack.operators import beams, epochs, substrings, subwords


def plain_search(steps, k, end):
    """(score, tokens) of the final beams, step by step; ``steps``: for each the log probabilities that follow each beam."""
    scores, tokens, chosen, ended, stop = [0.0], [None], [], [], False
    for rows in steps:
        if stop and len(ended) >= k:
            break
        rows = rows[: len(scores)]
        options = []
        for beam, row in enumerate(rows):
            for token, lp in enumerate(row):
                score = -1e20 if tokens[beam] == end else scores[beam] + lp
                options.append((-score, beam, token))
        best = sorted(options)[:k]
        scores, tokens = [-s for s, _, _ in best], [t for _, _, t in best]
        chosen.append([(b, t) for _, b, t in best])
        ended += [(s, len(chosen), i) for i, (s, t) in enumerate(zip(scores, tokens, strict=True)) if t == end]
        stop |= tokens[0] == end
    out = sorted(ended or [(scores[0], len(chosen), 0)], key=lambda b: -b[0])
    rest = sorted(((s, len(chosen), i) for i, (s, t) in enumerate(zip(scores, tokens, strict=True)) if t != end), key=lambda b: -b[0])
    final = (out + rest[: max(0, k - len(out))])[:k]
    result = []
    for score, n, at in final:
        path = []
        for step in range(n, 0, -1):
            at, token = chosen[step - 1][at]
            path.append(token)
        path.reverse()
        result.append((round(score, 6), path[: path.index(end)] if end in path else path))
    return result


@pytest.mark.parametrize(("k", "vocabulary", "likely"), [(1, 4, 0.0), (2, 3, 2.0), (3, 5, 1.0), (4, 3, 3.0)])
def test_beam_search(spark, k, vocabulary, likely):
    """Searches that end early, late and never; ties; fewer candidates than beams; steps with gaps in their numbers."""
    rng = random.Random(10 * k + vocabulary)
    every, rows = {}, []
    for seq in range(40):
        n = rng.randint(1, 7)
        every[seq] = [[[rng.choice([-0.5, -1.0, -2.25, -3.0]) + (likely if t == 1 and rng.random() < 0.4 else 0) for t in range(vocabulary)] for _ in range(k)] for _ in range(n)]
        rows += [(seq, 3 * s + 1, b, lp) for s, beam_rows in enumerate(every[seq]) for b, lp in enumerate(beam_rows)]
    frame = spark.createDataFrame(rows, "seq long, step int, beam int, logprobs array<double>")
    got = {}
    for r in beams.decode(frame, k, 9, 1).orderBy("seq", "rank").collect():
        got.setdefault(r.seq, []).append((round(r.score, 6), r.tokens))
    assert got == {seq: plain_search(steps, k, 1) for seq, steps in every.items()}
    assert beams.decode(frame.where("seq < 0"), k, 9, 1).collect() == []


def test_scores_that_rounding_makes_equal(spark):
    """One log probability is above the other by less than a sum of scores can tell: the smaller token wins."""
    near = -1.0 - 1e-15
    steps = [[[-1e5, -1e6, -1e6]], [[near, -1.0, -9.0]]]
    frame = spark.createDataFrame([(0, s, 0, lp) for s, rows in enumerate(steps) for lp in rows], "seq long, step int, beam int, logprobs array<double>")
    assert beams.decode(frame, 1, 9, 2).collect()[0].tokens == plain_search(steps, 1, 2)[0][1] == [0, 0]


def test_common_substrings(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("ab é😀") for _ in range(n))
    shared = make(57)
    left = [(k, make(rng.randint(0, 60)) + (shared[: rng.randint(0, 57)] if k % 3 == 0 else "") + make(5)) for k in range(40)] + [(90, None), (91, ""), (92, "zzz"), (93, "a" * 200)]
    right = [(k, make(rng.randint(0, 40)) + (shared if k == 3 else "")) for k in range(12)] + [(50, None), (51, "a" * 150)]
    frames = [spark.createDataFrame(x, "id long, text string") for x in (left, right)]
    got = {r.id: (r.length, r.common) for r in substrings.longest_with_any(*frames).collect()}
    want = {}
    for i, a in left:
        found = [x for x in (lcs.longest(a, b) for _, b in right) if x]
        if found:
            most = max(map(len, found))
            every = {a[s : s + most] for s in range(len(a) - most + 1) if any(b and a[s : s + most] in b for _, b in right)}
            want[i] = (most, min(every, key=lambda x: x.encode()))
    assert got == want and 92 not in got and got[93] == (150, "a" * 150)
    assert substrings.longest_with_any(frames[0], frames[1].where("id < 0")).collect() == []


def plain_pieces(word, known, most):
    out, at = [], 0
    while at < len(word):
        for size in range(min(most, len(word) - at), 0, -1):
            if (word[at : at + size], at == 0) in known:
                out.append(known[word[at : at + size], at == 0])
                at += size
                break
        else:
            return None
    return out


def test_subwords(spark):
    rng = random.Random(6)
    stems = ["walk", "talk", "ing", "ed", "un", "é"]
    texts = [" ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["walk talk walk talk ing", "", None, "W" + "x" * 300]
    points = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    known_rows = subwords.pieces(points, "text", 12).collect()
    known = {(r.piece, r.begins): r.id for r in known_rows}
    assert sorted(known.values()) == list(range(4, 4 + len(known))) and {p for p, b in known if len(p) == 1 and b} == {c for t in texts if t for c in t.lower() if c != " "}
    frame = spark.createDataFrame(known_rows)
    longest = max(len(p) for p, _ in known)
    words = points.selectExpr("explode(split(lower(text), ' ')) AS word")
    got = {r.word: r.ids for r in subwords.segmented(words, frame).collect()}
    assert got == {w: plain_pieces(w, known, longest) for t in texts if t is not None for w in t.lower().split(" ") if w}
    for length in (4, 12):
        for r in subwords.encoded(points, "text", frame, length).collect():
            t = texts[r.idx]
            want = [1, *[i for w in (t or "").lower().split() for i in plain_pieces(w, known, longest)][: length - 2], 2]
            assert r.ids == want + [0] * (length - len(want)) and r.mask == [1] * len(want) + [0] * (length - len(want))
    few = frame.where("piece <> 'x'")
    assert "w" + "x" * 300 not in {r.word for r in subwords.segmented(words, few).collect()}


class Stopped(Exception):
    pass


def test_epochs_go_on_where_they_stopped(spark, tmp_path):
    """Three epochs, one broken off after its state is saved and before its score is: the table and the best state are those of a run that never stopped."""
    truth = [(k, ["a", "b", "c", "d", str(k)]) for k in range(20)]
    refs = spark.createDataFrame([(k, [w]) for k, w in truth], "idx long, refs array<array<string>>")
    wrong, asked = (8, 2, 5), []

    def state(e, stop=None):
        asked.append(e)
        return spark.createDataFrame([(k, w if k >= wrong[e] else ["x"] * 5) for k, w in truth], "idx long, pred array<string>")

    def pairs(e, now):
        return now.join(refs, "idx")

    whole = epochs.run(spark, str(tmp_path / "whole"), 3, state, pairs).orderBy("epoch").collect()
    assert [r.improved for r in whole] == [True, True, False]
    folder = str(tmp_path / "stopped")
    epochs.run(spark, folder, 1, state, pairs)
    real = spark.createDataFrame

    def stop(*a, **b):
        if len(a) > 1 and a[1] == epochs.SCORES:
            raise Stopped
        return real(*a, **b)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda self, *a, **b: stop(*a, **b))
        with pytest.raises(Stopped):
            epochs.run(spark, folder, 3, state, pairs)
    asked.clear()
    assert epochs.run(spark, folder, 3, state, pairs).orderBy("epoch").collect() == whole and asked == [1, 2]
    best = epochs.best_state(spark, folder)
    assert best.where(F.array_contains("pred", "x")).count() == 2
    assert epochs.best_state(spark, str(tmp_path / "none")) is None
