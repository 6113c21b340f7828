"""Longest common substrings of many texts with many others.

Both sides are dealt in pieces of bounded size, and each piece of the left meets each of the right in one group. There every place
gets a name for the stretch of 1, 2, 4, ... characters that begins there, mixed from the names of its two halves; a table of the right's names
tells which stretches it may hold. A text's longest size is found by doubling and bisection, and what is found is compared letter by
letter, so that names which meet by chance count for nothing. Long texts are cut with as much overlap as the other side's longest text has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a piece's own part of a text, and of all texts in a group, about.
CUT, GROUP = 1 << 20, 4 << 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _ODD[0] + (b ^ (b >> np.uint64(29))) * _ODD[1]
    x = (x ^ (x >> np.uint64(32))) * _ODD[2]
    return x ^ (x >> np.uint64(29))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


class Names:
    """Names of a text's stretches of any size."""

    def __init__(self, points: np.ndarray):
        self.powers = [_mixed(points, points)]

    def of(self, size: int) -> np.ndarray:
        """A stretch is named after its first and last parts of the greatest power of two, which cover it."""
        k = size.bit_length() - 1
        while len(self.powers) <= k:
            self.powers.append(self._over(self.powers[-1], 1 << (len(self.powers) - 1)))
        return self.powers[k] if size == 1 << k else self._over(self.powers[k], size - (1 << k))

    @staticmethod
    def _over(names: np.ndarray, step: int) -> np.ndarray:
        return _mixed(names[: max(0, len(names) - step)], names[step:])


class Held:
    """Whether any text of one side's piece has a stretch."""

    def __init__(self, texts: list[str]):
        self.texts, self.most = texts, max(map(len, texts), default=0)
        # beyond any character, a sign after each text: no stretch of a text of the other side holds one
        self.names = Names(np.concatenate([np.append(_points(t), np.uint64(0x110000)) for t in texts]))
        self.all, self.sized = "\ue000".join(texts), {}

    def at(self, names: np.ndarray, size: int) -> np.ndarray:
        """The places whose names are held."""
        if size not in self.sized:
            own = np.unique(self.names.of(size))
            bits = max(10, int(16 * len(own)).bit_length())
            table = np.zeros(1 << bits, bool)
            shift = np.uint64(64 - bits)
            table[(own >> shift).astype(np.int64)] = True
            self.sized[size] = own, table, shift
        own, table, shift = self.sized[size]
        near = np.flatnonzero(table[(names >> shift).astype(np.int64)])
        found = np.searchsorted(own, names[near])
        return near[own[np.minimum(found, len(own) - 1)] == names[near]] if len(own) else near[:0]

    def longest(self, text: str) -> str | None:
        """The longest stretch of a text that is held, the smallest of equals."""
        names, most = Names(_points(text)), min(len(text), self.most)
        has = lambda size: len(self.at(names.of(size), size)) > 0
        size = 8
        while size <= most and has(size):
            size *= 2
        low, high = (size // 2 if size > 8 else 0), min(size - 1, most)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if has(middle) else (low, middle - 1)
        for length in range(low, 0, -1):  # the first, but for names that meet by chance
            some = sorted({text[i : i + length] for i in self.at(names.of(length), length).tolist()})
            for x in some:
                if x in self.all and ("\ue000" not in x or any(x in t for t in self.texts)):
                    return x
        return None


def _matched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if left.empty or right.empty:
        return pd.DataFrame({"id": pd.Series([], dtype="int64"), "length": pd.Series([], dtype="int64"), "common": pd.Series([], dtype=object)})
    held = Held(right["text"].tolist())
    found = [(i, held.longest(t)) for i, t in zip(left["id"].tolist(), left["text"].tolist(), strict=True)]
    found = [(i, x) for i, x in found if x]
    return pd.DataFrame({"id": pd.Series([i for i, _ in found], dtype="int64"), "length": pd.Series([len(x) for _, x in found], dtype="int64"), "common": pd.Series([x for _, x in found], dtype=object)})


def _pieces(texts: DataFrame, overlap: int) -> DataFrame:
    """Texts in cuts of CUT characters, each with ``overlap`` more."""
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / CUT).cast("int"))
    cut = texts.select("id", "text", F.explode(starts).alias("k"))
    return cut.select("id", F.when(F.length("text") <= CUT, F.col("text")).otherwise(F.substring("text", F.col("k") * CUT + 1, F.lit(CUT + overlap))).alias("text"), "k")


def longest_with_any(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, length, common): of each text (id, text) of ``left`` the longest substring that any text of ``right`` (id, text) holds.

    Of equally long ones the smallest; texts that share nothing, nulls and empty texts have no row. Ids are long and
    unique on each side. A group holds a piece of either side, GROUP characters or a cut more; the left is
    sent once for each piece of the right, which should be the smaller side.
    """
    sides = [x.select("id", "text").where("text <> ''") for x in (left, right)]
    sums = [s.agg(F.sum(F.length("text")), F.max(F.length("text"))).first() for s in sides]
    if not all(s[0] for s in sums):
        return sides[0].select("id", F.length("text").cast("long").alias("length"), F.col("text").alias("common")).where("1 = 0")
    overlap = min(s[1] for s in sums) - 1  # no common stretch is longer
    groups = [max(least, s[0] // GROUP + 1) for s, least in zip(sums, (left.sparkSession.sparkContext.defaultParallelism, 1), strict=True)]
    deal = lambda k: F.pmod(F.xxhash64("id", "k"), F.lit(groups[k])).alias("ab"[k])
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups[k] - 1).cast("long"))).alias("ab"[k])
    ours = _pieces(sides[0], overlap).select("id", "text", deal(0), "k").select("id", "text", "a", every(1))
    theirs = _pieces(sides[1], overlap).select("id", "text", deal(1), "k").select("id", "text", "b", every(0))
    met = ours.groupBy("a", "b").cogroup(theirs.groupBy("a", "b")).applyInPandas(_matched, "id long, length long, common string")
    best = met.groupBy("id").agg(F.min(F.struct((-F.col("length")).alias("n"), "common")).alias("x"))
    return best.select("id", (-F.col("x.n")).alias("length"), "x.common")
