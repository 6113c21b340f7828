"""Toxicity by compression distance under two zstandard dictionaries.

Training text comes in windows of whole words, lower-cased and without ASCII punctuation. The ordinary
dictionary is trained on windows of ordinary documents. The toxic one is trained on toxic documents
reduced to their telling words (met in many surroundings there and hardly ever in ordinary text):
trained on them unreduced it fills up with the words that both kinds share. A window is compressed with
the ordinary content alone and with the toxic content put before it; since the ordinary part stands at
the same distance in both, the lengths differ only where toxic content helped. A document's score is
a logistic function, calibrated on documents that the dictionaries have not seen, of how many windows
passed which difference.
"""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import kernels
from tamarack.llm.shared import column, ddl, neutral, quoted, stored, text_in_place, unclashed

WINDOW = 128
#: The training sample: labelled documents of each class at most, bytes of a document's windows (spread over all of it) and windows of ordinary text at most.
SAMPLE_DOCS, SAMPLE_BYTES, WINDOWS = 4000, 1 << 16, 60_000
ORDINARY_BYTES, TOXIC_BYTES, TOXIC_ROUNDS = 2048, 8192, 3
#: A telling word's surroundings at least (fewer where hardly any word has them), and its rate over that in ordinary text.
SURROUNDINGS, RATE = 6, 50

PLAIN = bytes(0x20 if 0x21 <= c < 0x7F and not chr(c).isalnum() else c for c in kernels.LOWER.tolist())


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Plain bytes, starts, ends and rows of the windows: the words that begin in the same WINDOW bytes of a text."""
    raw = np.frombuffer(PLAIN, np.uint8)[raw]
    starts, ends, rows = kernels.words(raw, offsets)
    cell = (starts - offsets[rows]) // WINDOW
    first = np.ones(len(starts), bool)
    first[1:] = (cell[1:] != cell[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(first)
    return raw.tobytes(), starts[at], ends[np.append(at[1:], len(starts)) - 1] if len(at) else at, rows[at]


def _content(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A dictionary trained on ``samples``, to be used as raw content (its tables then are a few bytes that match nothing);
    where they are too few to train on, of the distinct samples themselves what fits."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d, steps=1, level=1).as_bytes()
    except zstandard.ZstdError:
        some = list(dict.fromkeys(samples))
        step = max(1, -(-sum(map(len, some)) // size))  # at even steps where not all fit
        return b" ".join(some[::step])


def telling_words(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Of plain texts; each is split when it is read, so that no list of all words is held."""
    in_toxic, in_ordinary = Counter(), Counter()
    for text in toxic:
        in_toxic.update(set(text.split()))
    for text in ordinary:
        in_ordinary.update(w for w in set(text.split()) if w in in_toxic)
    scale = max(1, len(toxic)) / max(1, len(ordinary))
    rare = {w for w, n in in_toxic.items() if n >= RATE * scale * (in_ordinary[w] + 0.5)}
    around = defaultdict(set)
    for text in toxic:
        words = text.split()
        for before, w in zip([b"", *words], words, strict=False):
            if w in rare:
                around[w].add(before)
    for least in range(SURROUNDINGS, 1, -1):
        found = {w for w, x in around.items() if len(x) >= least}
        if len(found) >= 8:
            break
    return found


class Model:
    """Two dictionary contents and the weights of the document score."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, None

    def compressors(self):
        settings = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_BTOPT, min_match=4, search_log=5, window_log=15, hash_log=14, chain_log=14, target_length=24, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        both = (self.ordinary, self.toxic + self.ordinary)
        made = [zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if x else None for x in both]
        return [zstandard.ZstdCompressor(compression_params=settings, dict_data=d) for d in made]

    def features(self, raw: np.ndarray, offsets: np.ndarray, compressors=None) -> np.ndarray:
        """(rows, 6): a constant, counts of windows by difference, the largest difference, the number of windows."""
        n = len(offsets) - 1
        data, starts, ends, rows = windows(raw, offsets)
        one, two = (c.compress for c in compressors or self.compressors())
        gain = np.zeros(len(starts), np.int64)
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            x = data[a:b]
            gain[i] = len(one(x)) - len(two(x))
        out = np.ones((n, 6))
        total = np.bincount(rows, minlength=n)
        for k in (1, 2):
            out[:, k] = np.log1p(np.bincount(rows, gain >= k, n))
        out[:, 3] = np.bincount(rows, gain >= 1, n) / np.maximum(1, total)
        most = np.zeros(n, np.int64)
        np.maximum.at(most, rows, gain)
        out[:, 4] = np.minimum(most, 8) / 4
        out[:, 5] = np.log1p(total) / 4
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))


def _packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def spread_windows(texts: list[bytes], most: int = WINDOWS) -> list[bytes]:
    """The windows of ``texts`` in order, or ``most`` of them at even steps where there are more."""
    total = sum(len(windows(*_packed(texts[a : a + 64]))[1]) for a in range(0, len(texts), 64))
    out, at = [], 0
    for a in range(0, len(texts), 64):
        data, starts, ends, _ = windows(*_packed(texts[a : a + 64]))
        place = at + np.arange(len(starts))
        some = np.flatnonzero(place * most // total != (place - 1) * most // total) if total > most else np.arange(len(starts))
        out += [data[x:y] for x, y in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
        at += len(starts)
    return out


def dictionaries(plain: list[bytes], labels: np.ndarray) -> Model:
    """Train both dictionaries on plain texts; the ordinary one on WINDOWS windows at most, spread over all texts."""
    toxic = [t for t, y in zip(plain, labels, strict=True) if y]
    ordinary = [t for t, y in zip(plain, labels, strict=True) if not y]
    telling = telling_words(toxic, ordinary)
    samples = [b" " + w + b" " for t in toxic for w in t.split() if w in telling]
    content = b""
    for round_ in range(TOXIC_ROUNDS if samples else 0):  # a training run cuts some words that another leaves whole
        random.Random(round_).shuffle(samples)
        content += _content(samples, TOXIC_BYTES, 24, 6)
    # the trainer also stops early: telling words that no round left whole are put in front, the rarest first
    cut = [b" " + w + b" " for w, _ in Counter(w for t in toxic for w in set(t.split()) & telling).most_common() if b" " + w + b" " not in content]
    content = b"".join(reversed(cut))[-TOXIC_BYTES:] + content
    return Model(_content(spread_windows(ordinary), ORDINARY_BYTES, 32, 8), content)


def features_of(model: Model, texts: list[bytes]) -> np.ndarray:
    return np.concatenate([model.features(*_packed(texts[a : a + 64])) for a in range(0, len(texts), 64)])


def fit(texts: list[bytes], labels: np.ndarray, share: tuple[float, float] = (1, 1)) -> Model:
    """Train on all distinct texts; calibrate each half of them on dictionaries of the other half.

    ``share``: how many labelled documents one of the class stands for. Calibration rows weigh that much, so scores
    are probabilities at the labels' own rate of toxic documents, whatever the sample's.
    """
    seen = dict(zip(texts, labels.tolist(), strict=True))
    texts, labels = list(seen), np.array(list(seen.values()), int)
    plain = [t.translate(PLAIN) for t in texts]
    model = dictionaries(plain, labels)
    x, y = [], []
    for side in (0, 1):
        at = [i for i in range(len(texts)) if i % 2 == side]
        rest = [i for i in range(len(texts)) if i % 2 != side]
        if at and rest:
            x.append(features_of(dictionaries([plain[i] for i in rest], labels[rest]), [texts[i] for i in at]))
            y.append(labels[at])
    if y and 0 < (y := np.concatenate(y).astype(float)).sum() < len(y):
        x = np.concatenate(x)
        weight = np.where(y == 1, share[1], share[0])
        weight = weight * (len(y) / weight.sum())
        w = np.zeros(x.shape[1])
        for _ in range(30):  # Newton steps of a logistic regression with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (weight * (y - p)) - 0.1 * w)
        model.weights = w
    return model


def _thinned(batches):
    """Of a text above SAMPLE_BYTES as many of its windows as fit, at even steps from its beginning to its end."""
    for batch in batches:
        raw, offsets = kernels.buffers(batch.column("text"))
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            text = raw[a:b]
            if len(text) > SAMPLE_BYTES:
                _, starts, ends, _ = windows(text, np.array([0, len(text)]))
                at = np.unique(np.linspace(0, len(starts) - 1, SAMPLE_BYTES // (WINDOW + 16)).astype(int)) if len(starts) else starts
                text = b" ".join(text[x:y].tobytes()[:SAMPLE_BYTES] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True))
            else:
                text = text.tobytes()
            out.append(text.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(out, pa.string())], ["id", "y", "text"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled documents outside the held-out fold: the first SAMPLE_DOCS of each class in the order of a hash of their ids, weighted by the class's count over all."""
    docs, labels = unclashed(docs, id_col, text_col), unclashed(labels, id_col, label_col)
    marks = labels.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(label_col)).cast("int").alias("y"))
    marks = marks.where("id is not null and y in (0, 1)").where(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2)
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    texts = texts.where("text <> ''")
    # ids are chosen first, so no shuffle carries texts but those of the sample
    there = stored(texts.select("id").join(marks, "id").distinct(), "labelled")
    count = {r.y: r["count"] for r in there.groupBy("y").count().collect()}
    share = tuple(count.get(y, 0) / max(1, min(count.get(y, 0), SAMPLE_DOCS)) or 1 for y in (0, 1))
    some = [there.where(f"y = {y}").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS) for y in (0, 1)]
    chosen = some[0].unionByName(some[1])  # 2 * SAMPLE_DOCS rows at most: small enough to broadcast at any size
    thin = texts.join(F.broadcast(chosen), "id").select("id", "y", "text").mapInArrow(_thinned, "id long, y int, text string")
    rows = thin.groupBy("id", "y").agg(F.min("text").alias("text")).orderBy("id", "y").select("text", "y").toArrow()
    return fit([t.encode() for t in rows["text"].to_pylist()], rows["y"].to_numpy(), share)


def _score(model: Model, text: str, name: str, drop: bool):
    def run(batches):
        compressors = model.compressors()
        for batch in batches:
            raw, offsets = kernels.buffers(batch.column(text))
            parts = [model.score(model.features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], compressors)) for a, b in kernels.slices(offsets)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            keep = [i for i, n in enumerate(batch.schema.names) if not (drop and n == text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(scores)], [*(batch.schema.names[i] for i in keep), name])

    return run


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a last column ``name``: the toxicity of the whole text, 0 to 1.

    A null text is scored as an empty one; long ones are scored whole, repeated rows alike. Other columns come as they
    were, whatever their names; one that is called ``name`` keeps its place before the new one. An empty table stays empty.
    """
    names, docs = docs.columns, neutral(docs, text_col)
    given, inner, added = text_in_place(docs, text_col, "scored")
    return given.mapInArrow(_score(model, inner, "__score", added), f"{ddl(docs)}`__score` double").toDF(*names, name)


def below(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, with their columns as they came."""
    names = docs.columns
    told = scored(neutral(docs, text_col), model, text_col, "__score")
    return told.where(F.col("__score") < threshold).drop("__score").toDF(*names)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Without labels of both classes all scores are 0. Repeated rows and ties of labels are used as they
    come; a null doc_id is never held out; a null text is an empty one; texts of any length are scored whole; an empty
    table gives no rows. Other columns of the tables are not read.
    """
    docs, labels = unclashed(docs, "doc_id", "text"), unclashed(labels, "doc_id", "toxic")
    model = train(docs, labels)
    plain = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored(plain, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
