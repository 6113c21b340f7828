"""Texts that would stall a careless scan, and tables whose extra columns have odd names."""

import time

import public_tokenizers
import pytest
from tests.llm.helpers import empty

from tamarack.llm import audit, chat, html, minhash, packing, pieces, pii, quality, rules, tokenfile, toxicity, trie, vectors
from tamarack.llm.shared import scratch

SPM, BPE, BYTES = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = {"TEXT": "'other'", "meta.x": "1", "so`urce": "'s'", "toxic_score": "0.5D", "__score": "2", "Doc_ID": "7", "N_CHARS": "3"}


def with_odd_columns(frame):
    """``frame`` with ODD's columns before its own."""
    return frame.selectExpr(*[f"{v} AS `{k.replace('`', '``')}`" for k, v in ODD.items()], "*") if frame.columns else frame


@pytest.fixture(scope="module")
def texts():
    marks = "!" * 1_000_000 + "a"
    spans = "(312) 555-0199 a1@b.com " * 42_000
    return marks, spans


def test_a_million_marks(texts):
    codec = pieces.Codec(SPM)
    began = time.perf_counter()
    ids = codec.encode(texts[0].encode())
    assert time.perf_counter() - began < 10
    import sentencepiece

    short = texts[0][-3000:]
    want = sentencepiece.SentencePieceProcessor(model_file=SPM).encode(short)
    assert memoryview(codec.encode(short.encode())).cast("I").tolist() == want and len(ids) > 0


def test_a_megabyte_of_spans(texts):
    """Only the joining of spans is timed: labels as the network would give them, one span in each phone number."""
    import numpy as np

    text = texts[1]
    labels = np.zeros(len(text), np.uint8)
    step = len("(312) 555-0199 a1@b.com ")
    phone = 2 * pii.KINDS.index("phone") + 1
    labels[0::step] = phone
    for k in range(1, 14):
        labels[k::step] = phone + 1
    base = pii.base_spans(text[:step])
    taken = [(s[0] + k, s[1] + k) for k in range(0, len(text) - step + 1, step) for kind in pii.KINDS for s in base[kind]]
    began = time.perf_counter()
    got = pii.added_spans(text, labels, taken)
    assert time.perf_counter() - began < 10
    assert len(got) == 42_000 and got[0] == ("phone", 0, 14)
    word = "a" * 200_000
    labels = np.full(len(word), 1, np.uint8)  # a span that begins at each letter of one word
    began = time.perf_counter()
    assert pii.added_spans(word, labels, []) == [] and time.perf_counter() - began < 10


def test_operators_take_odd_columns(spark, sf):
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    docs, labels, few = read("documents"), read("labels"), read("documents").where("doc_id < 40")
    same = lambda f, *frames: f(*map(with_odd_columns, frames)).count() == f(*frames).count() > 0
    assert same(minhash.near_duplicates, few) and same(rules.quality_rules, docs) and same(quality.quality, docs, labels) and same(toxicity.toxicity, docs, labels)
    assert same(pii.personal_data, few) and same(lambda d: pieces.round_trips(d, SPM), few) and same(lambda d: packing.pack(d, BPE), few)
    assert same(audit.filter_audit, docs, labels) and same(trie.prefix_trie, read("conversations").where("conv_id < 5"))
    assert same(lambda c: chat.read_back(chat.format_chats(c)), read("conversations").where("conv_id < 20"))
    assert same(html.extract, read("pages").where("page_id < 30")) and same(vectors.near_vectors, read("embeddings").where("vec_id < 100"))
    folder = scratch(spark, "odd")
    tokenfile.write_ids(with_odd_columns(few), folder, BYTES)
    assert tokenfile.read_ids(spark, folder).count() == few.count()


def test_stages_take_odd_columns(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = with_odd_columns(docs)
    for name, stage in pipeline.STAGES:
        got, plain = stage(spark, odd, sf), stage(spark, docs, sf)
        if name == "packing":
            assert sorted(got.select("doc_id", "start").collect()) == sorted(plain.select("doc_id", "start").collect())
            continue
        assert got.columns == odd.columns
        keep = [len(ODD) + k for k in range(len(docs.columns))]
        assert sorted(repr([r[k] for k in keep]) for r in got.collect()) == sorted(repr(list(r)) for r in plain.collect())
        assert stage(spark, empty(odd), sf).collect() == []


def test_toxicity_from_plain_compressions(spark):
    """Scores recomputed text by text: windows by a regular expression, lengths from zstandard itself, the logistic by hand."""
    import math
    import random
    import re

    import zstandard

    rng = random.Random(9)
    bad = ["idiot", "worthless", "disgusting", "pathetic"]
    rows = []
    for i in range(240):
        w = ["".join(rng.choice(["th", "er", "on", "an", "re", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(90)]
        for _ in range(6 * (i % 5 == 0)):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (902, "Odd\tTEXT, é — " * 40), (903, "x" * 700)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    contents = [zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in (model.ordinary, model.toxic + model.ordinary)]
    settings = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTOPT, min_match=4, search_log=5, window_log=15, hash_log=14, chain_log=14, target_length=24, write_content_size=False, write_checksum=False, write_dict_id=False)
    size = lambda which, x: len(zstandard.ZstdCompressor(compression_params=settings, dict_data=contents[which]).compress(x))

    def plain_score(text):
        data = bytes(32 if 33 <= c < 127 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        cells = {}
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", data):
            a, _ = cells.get(m.start() // 128, (m.start(), 0))
            cells[m.start() // 128] = (a, m.end())
        gains = [size(0, data[a:b]) - size(1, data[a:b]) for a, b in cells.values()]
        some = [sum(g >= k for g in gains) for k in (1, 2)]
        features = [1, *(math.log1p(n) for n in some), some[0] / max(1, len(gains)), min(max([0, *gains]), 8) / 4, math.log1p(len(gains)) / 4]
        return 1 / (1 + math.exp(-sum(x * w for x, w in zip(features, model.weights, strict=True))))

    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys() and all(abs(got[i] - plain_score(t)) < 1e-9 for i, t in texts.items())
    names = docs.columns
    assert toxicity.below(docs, model, 0.5).columns == names and {r.doc_id for r in toxicity.below(docs, model, 0.5).collect()} == {i for i, s in got.items() if s < 0.5}
