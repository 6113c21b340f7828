"""Quality by regularised quadratic discriminant analysis of document statistics.

The class moments are sums over all labelled rows, formed in the tasks and added up, so fitting gathers
one small matrix per task. Each class covariance is shrunk towards the pooled one and its diagonal;
its Cholesky factor is kept, and a score is the logistic of the difference of the two log densities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import kernels, rules
from tamarack.llm.shared import column, stored, unclashed

STATISTICS = ("words", "word_length", "symbols", "lines", "dup_lines", "repeats", "upper", "digits", "stops", "bangs", "distinct", "short", "bars", "other")
#: Shares of the pooled covariance and of the diagonal in a class covariance.
POOLED, DIAGONAL = 0.1, 0.1


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


UPPER, DIGIT, STOP, BANG, BAR, BREAK = (_table(x) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?", "!", "|", "\n"))
OTHER = ((np.arange(256) >= 0x80) & (rules.STARTS_CHAR == 1)).astype(np.int64)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, len(STATISTICS)): logarithms of counts and of smoothed ratios, which are nearer to normal than the ratios."""
    n = len(offsets) - 1
    counts = rules.count_slice(raw, offsets).astype(float)
    words, chars, symbols, dup_lines, repeats = counts.T
    of = lambda t: rules._sums(t[raw], offsets[:-1], offsets[1:]).astype(float)
    starts, ends, rows = kernels.words(raw, offsets)
    distinct = np.zeros(n)
    if len(starts):
        low = kernels.LOWER[raw]
        _, later = kernels.seen(rows, kernels.span_hashes(low, starts, ends), rules.word_equality(low, starts, ends), lambda i: low[starts[i] : ends[i]].tobytes())
        distinct = np.bincount(rows[~later], minlength=n).astype(float)
    short = np.bincount(rows, ends - starts <= 2, n) if len(starts) else np.zeros(n)
    ratio = lambda a, b: np.log((a + 0.5) / (b + 1))
    return np.column_stack([
        np.log1p(words), np.log((chars + 1) / (words + 1)), ratio(symbols, chars), ratio(of(BREAK), words), ratio(dup_lines, words), ratio(repeats, words),
        ratio(of(UPPER), chars), ratio(of(DIGIT), chars), ratio(of(STOP), chars), ratio(of(BANG), chars), ratio(distinct, words), ratio(short, words), ratio(of(BAR), words), ratio(of(OTHER), chars),
    ])


def _describe(text: str):
    def run(batches):
        for batch in batches:
            raw, offsets = kernels.buffers(batch.column(text))
            parts = [statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in kernels.slices(offsets)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    return run


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each text; a null text is empty."""
    plain = docs.select(column(docs, id_col, "long").alias("doc_id"), column(docs, text_col, "string").alias("text"))
    return plain.mapInArrow(_describe("text"), "doc_id long, x array<double>")


def _matrix(batch, name: str = "x") -> np.ndarray:
    return np.array(batch.column(name).flatten()).reshape(len(batch), len(STATISTICS))


def _moments(batches):
    d = len(STATISTICS)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x, y = _matrix(batch), np.array(batch.column("y"))
        for k in (0, 1):
            z = x[y == k]
            total[k] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
    if total[:, 0].any():
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(list(total))], ["y", "m"])


class Discriminant:
    """Means, Cholesky factors and log priors of the two classes."""

    def __init__(self, moments: np.ndarray):
        d = len(STATISTICS)
        n, means = moments[:, 0], moments[:, 1 : 1 + d] / np.maximum(1, moments[:, :1])
        self.known = bool((n >= 2).all())
        if not self.known:
            return
        spread = moments[:, 1 + d :].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = spread.sum(axis=0) / max(1, n.sum() - 2)
        self.means, self.factors, self.offsets = means, [], []
        for k in (0, 1):
            own = POOLED * pooled + (1 - POOLED) * spread[k] / max(1, n[k] - 1)
            own = (1 - DIAGONAL) * own + DIAGONAL * np.diag(np.diag(own)) + 1e-4 * np.eye(d)
            factor = np.linalg.cholesky(own)
            self.factors.append(np.linalg.inv(factor))
            self.offsets.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), 0.5)
        densities = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(densities[1] - densities[0], -30, 30)))


def fit(statistics_: DataFrame, labels: DataFrame, label_col: str = "quality") -> Discriminant:
    """Moments over every labelled row outside the held-out fold."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    marks = marks.where("doc_id is not null and y in (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    sums = statistics_.join(marks, "doc_id").select("x", "y").mapInArrow(_moments, "y long, m array<double>")
    width = 1 + len(STATISTICS) + len(STATISTICS) ** 2
    total = sums.groupBy("y").agg(*[F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(width)]).collect()
    moments = np.zeros((2, width))
    for row in total:
        moments[row[0]] = row[1:]
    return Discriminant(moments)


def _score(model: Discriminant):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)))], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Without two labelled rows of either class all scores are 0.5. An empty or null text has the
    statistics of an empty one; a long one is read whole. Repeated rows count as often as they come; a null doc_id is
    never held out; an empty table gives no rows. Other columns are not read.
    """
    docs, labels = unclashed(docs, "doc_id", "text"), unclashed(labels, "doc_id", "quality")
    x = stored(described(docs), "statistics")
    model = fit(x, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return x.mapInArrow(_score(model), "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
