"""Token files, the filters' replay and the trie of conversations against plain versions, and odd cases."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tests.llm.helpers import LONG, empty, odd_documents, words

from tamarack.llm import audit, tokenfile, trie
from tamarack.llm.shared import scratch

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def encoded(texts):
    from tokenizers import Tokenizer

    return [np.array([*e.ids, 2], "<u4") for e in Tokenizer.from_file(BYTES).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_of_the_byte_encoder_are_the_librarys():
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "B", "'s", "'", "12", ",", "!", "é", " ", " ", "　", "中", "<|endoftext|>", "\x1c", "\x85", "\r\n", "_", "😀", "the", " '", "'ll", "\x00", "\x01", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["a " * 1_500_000, "z" * 300_000]
    import pyarrow as pa

    from tamarack.llm import kernels

    raw, offsets = kernels.buffers(pa.array(texts))
    encoder = tokenfile.ByteEncoder(BYTES)
    got = [x for a, b in kernels.slices(offsets) for x in encoder.texts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
    assert got == [x[:-1].tobytes() for x in encoded(texts)]


def test_a_word_of_a_slice_is_looked_up_once():
    encoder, asked = tokenfile.ByteEncoder(BYTES), []
    plain = encoder.ids
    encoder.ids = lambda words: asked.append(len(words)) or plain(words)
    texts = ["one two, one " * 500, "", "two\u00a0 two\u3000 \u00e9 \x01 three\x1f four", " ", "two one"]
    raw, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    assert [list(np.frombuffer(x, "<u4")) for x in encoder.texts(raw, offsets)] == [list(np.frombuffer(encoder.call([t])[0], "<u4")) for t in texts]
    assert sum(asked) < 30


@pytest.mark.parametrize("planes", [4, 32])
def test_planes_round_trip(planes):
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        assert np.array_equal(tokenfile.from_planes(tokenfile.to_planes(ids, planes), n), ids)
    parts = [rng.bytes(int(n)) for n in (0, 5, 1000, 70_000)]
    assert tokenfile.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_a_record_never_holds_the_mark():
    tries = []

    def make(level):
        tries.append(level)
        return b"x" + tokenfile.SYNC.encode() if level < 5 else b"fine"

    assert tokenfile.sealed(make, 3) == b"fine" and tries == [3, 4, 5]
    with pytest.raises(ValueError, match="every level"):
        tokenfile.sealed(lambda k: tokenfile.SYNC.encode(), 3)


@pytest.mark.parametrize(("planes", "block"), [(4, 1 << 16), (4, 64), (32, 100)])
def test_token_files(spark, planes, block):
    """Blocks smaller than documents, documents of several blocks, nulls and repeats, read back whole and seen through the index."""
    docs = odd_documents(spark, [(k, f"text {k} " * (k % 40)) for k in range(100, 400)])
    folder = scratch(spark, "ids")
    tokenfile.write_ids(docs.repartition(5), folder, BYTES, planes=planes, block_ids=block)
    got = tokenfile.read_ids(spark, folder, with_ids=True).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = defaultdict(list)
    for (i, _), ids in zip(rows, encoded([t for _, t in rows]), strict=True):
        want[i].append(ids.tobytes())
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((i is not None, i or 0, x) for i, l in want.items() for x in l)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    index = tokenfile.chunk_index(spark, folder).collect()
    assert sum(r.ids for r in index) == at and all(r.ids <= block for r in index)
    files = {}
    for name in spark.read.format("binaryFile").load(folder).collect():
        _, _, table = tokenfile.read_index(bytes(name.content).split(tokenfile.SYNC.encode())[-2]) if name.length else (0, 0, [])
        files[name.path] = (bytes(name.content), table)
    for data, table in files.values():
        for offset, length, first, n in table:
            head, ids, *_ = tokenfile.read_block(data[offset : offset + length])
            assert head["first"] == first and len(ids) == n


def test_damage_is_seen(spark):
    writer = tokenfile.BlockWriter(0, 4, 16, 3)
    record = next(iter(writer.add(5, np.arange(16, dtype="<u4").tobytes())))
    assert tokenfile.read_block(record)[1].tolist() == list(range(16))
    with pytest.raises(ValueError, match="damaged"):
        tokenfile.read_block(record[:-4] + b"\0\0\0\0")
    with pytest.raises(ValueError, match="planes"):
        tokenfile.write_ids(empty(odd_documents(spark)), scratch(spark, "ids"), BYTES, planes=8)


def test_an_empty_table_has_no_ids(spark):
    folder = scratch(spark, "ids")
    tokenfile.write_ids(empty(odd_documents(spark)), folder, BYTES)
    assert tokenfile.read_ids(spark, folder).collect() == [] and tokenfile.chunk_index(spark, folder).collect() == []


def replayed(rows, labels):
    """The audit by going through each order document by document."""
    known = defaultdict(lambda: [False, False])
    for i, q, t in labels:
        known[i][0] |= q == 1
        known[i][1] |= t == 1
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    fails = []
    for i, t, part in rows:
        w = words(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        fails.append((part, bad, known[i] if i is not None else [False, False]))
    out = {}
    for part in {p for p, _, _ in fails}:
        own = [(bad, mark) for p, bad, mark in fails if p == part]
        total = defaultdict(int)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone, kept = [d for d in left if d[0][x]], [d for d in left if not d[0][x]]
                total[x] += len(gone)
                out[part, order, step] = [len(kept), len(gone), sum(d[0][x] for d in own) - len(gone), sum(d[0][x] and sum(d[0].values()) == 1 for d in own), sum(d[1][0] for d in gone), sum(d[1][1] for d in gone), x]
                left = kept
        for k, v in out.items():
            if k[0] == part:
                v[6] = total[v[6]] if isinstance(v[6], str) else v[6]
    return out


def test_every_order_is_replayed(spark):
    rng = random.Random(2)
    texts = ["plain words go here " * 60, " ".join(f"w{k}" for k in range(250)), " ".join(f"w{k}" for k in range(250)) + " |", "SHOUTED " * 10, LONG]
    docs = odd_documents(spark, [(100 + k, rng.choice(texts)) for k in range(60)])
    labels = [(100 + k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 60, 2)] + [(100, 1, 1), (None, 1, 1), (1, 1, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("doc_id", "quality", "toxic", "1 AS fails", "'z' AS `PART`")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit.filter_audit(docs, frame).collect()}
    assert got == replayed([(r.doc_id, r.text or "", r.source or "") for r in docs.collect()], labels)
    assert audit.filter_audit(empty(docs), frame).collect() == []


def test_copies_are_spread(spark):
    """Most rows share a text: their mark goes by broadcast, and all but the first fail."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN concat('own ', id) ELSE 'the same' END AS text", "'s' AS source")
    failed = audit.failures(docs)
    assert failed.where("fails & 16 > 0").count() == 1999
    plan = failed._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def trie_of(rows):
    """The trie by walking every conversation."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, w in whole.items():
        for d in range(len(w) + 1):
            members[w[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], ends(p)) for p, m in members.items())


def built(frame):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie.prefix_trie(frame).collect())


TURNS = "conv_id long, turn long, role string, text string, name string, `meta.x` int, TEXT string"


def test_tries(spark):
    """Random conversations around shared beginnings, odd rows, and one far longer than the rest, dealt over many tasks."""
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice("abc") * rng.randint(0, 2)) for c in [*range(-110, 20), *range(195, 240)] for t in range(rng.randint(1, 7))]
    rows += [(300, t, "user", f"turn {t}") for t in range(700)] + [(301, t, "user", f"turn {t}") for t in range(650)]
    rows += [(5, None, None, None), (5, None, "user", "first"), (5, 3, "user", "tie"), (5, 3, "user", "tie"), (None, 1, "user", "x"), (400, 0, "user", "é😀" * 5000), (401, 0, "", ""), (499, 9, None, "only")]
    rows += [(c, t, "system", "hot") for c in range(1000, 1040) for t in range(3)]
    frame = spark.createDataFrame([(*r, "n", 1, "t") for r in rows], TURNS)
    want = trie_of(rows)
    assert built(frame) == want
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert built(frame.repartition(9)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert built(empty(frame)) == []


def test_digests_compose():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**31 - 60, (4, 40)).astype(np.uint64)
    fresh = np.zeros(40, bool)
    fresh[[0, 17]] = True
    after, before = trie.chained(x, fresh, np.zeros(4, np.uint64))
    cut, carry = [], np.zeros(4, np.uint64)
    for a, b in ((0, 5), (5, 20), (20, 40)):
        part, _ = trie.chained(x[:, a:b], fresh[a:b], carry)
        cut.append(part)
        carry = part[:, -1]
    assert np.array_equal(np.concatenate(cut, axis=1), after)
    assert np.array_equal(before[:, 1:17], after[:, :16]) and not before[:, 17].any()


def test_ids_of_a_node_are_hashed_in_pieces(spark):
    ends = spark.range(60_000).selectExpr("CASE WHEN id % 5 = 0 THEN X'02' ELSE X'01' END AS name", "id - 30000 AS conv_id")
    got = {bytes(r.name): r.ends_sha256 for r in trie.id_hashes(ends).collect()}
    for name, keep in ((b"\x02", lambda i: i % 5 == 0), (b"\x01", lambda i: i % 5)):
        assert got[name] == hashlib.sha256(",".join(str(i - 30000) for i in range(60_000) if keep(i)).encode()).hexdigest()
