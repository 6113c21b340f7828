"""Token ids in files of shuffled planes.

Documents are dealt by ranges of doc_id, sorted and encoded; each task writes one file of blocks. A block holds
a fixed number of ids (the last of a file fewer), transposed into planes: byte k of all ids, or bit k of all
ids, together. Each plane is compressed with zstandard on its own, which is where the gain lies: the high planes of small ids
are nearly constant. With the planes travel the documents that begin in the block. The last record of a file is
its chunk index: where each block stands, how many ids it has and which is the first.

Spark's own text writer and reader carry the records as raw bytes, with a synchronisation mark of sixteen bytes after
each, so that files are committed as Spark commits them on any file system, and many tasks read one large file.
No record holds the mark within (``sealed``).
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm import kernels
from tamarack.llm.shared import column, unclashed

#: Fixed values of the format: the mark after each record, and what blocks and indexes begin with.
SYNC, BLOCK, INDEX = "\x1eTOKEN-PLANES/1\x1e", b"TPB1", b"TPI1"
#: Ids in a block, and bytes of a text that are cut into words at once.
BLOCK_IDS, CHUNK_BYTES = 1 << 16, 1 << 20
#: Words whose ids a worker keeps, and the longest of them in bytes.
CACHE_WORDS, CACHED_BYTES = 600_000, 64
HEAD = struct.Struct("<4sBBHIIIIQ")  # magic, planes, does the last document go on, level, part, block, ids, documents, first id in the file


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """The byte planes (4) or bit planes (32) of 32-bit ids, lowest first."""
    if planes == 4:
        return [x.tobytes() for x in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(x, bitorder="little").tobytes() for x in np.ascontiguousarray(bits.T)]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(x, np.uint8) for x in parts], axis=1)).view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little") for x in parts], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def _packed(parts: list[bytes], level: int) -> bytes:
    pack = zstandard.ZstdCompressor(level=level).compress
    done = [pack(x) for x in parts]
    return struct.pack(f"<{len(done)}I", *map(len, done)) + b"".join(done)


def _unpacked(data: bytes, at: int, n: int) -> tuple[list[bytes], int]:
    sizes, at, out, unpack = struct.unpack_from(f"<{n}I", data, at), at + 4 * n, [], zstandard.ZstdDecompressor().decompress
    for size in sizes:
        out.append(unpack(data[at : at + size]))
        at += size
    return out, at


def sealed(make, level: int) -> bytes:
    """``make(level)``'s record at the first level from ``level`` on at which it does not hold the mark: its bytes differ from level to level."""
    for k in (*range(level, 20), *range(level - 1, 0, -1)):
        record = make(k)
        if SYNC.encode() not in record:
            return record
    raise ValueError("a record holds the synchronisation mark at every level")


class BlockWriter:
    """Cuts a stream of documents into blocks and tells the file's index at its end."""

    def __init__(self, part: int, planes: int, block_ids: int, level: int):
        self.part, self.planes, self.size, self.level = part, planes, block_ids, level
        self.ids, self.n = [], 0  # of the block to come
        self.docs: list[tuple[int, int, bool]] = []  # (place in the block, doc_id, is it null)
        self.done, self.at, self.index = 0, 0, []

    def add(self, doc: int | None, ids: bytes) -> Iterator[bytes]:
        self.docs.append((self.n, doc or 0, doc is None))
        start, total = 0, len(ids) // 4
        while total - start >= self.size - self.n:
            cut = self.size - self.n
            self.ids.append(ids[4 * start : 4 * (start + cut)])
            self.n, start = self.size, start + cut
            yield self.block(start < total)
        if start < total:
            self.ids.append(ids[4 * start :])
            self.n += total - start

    def block(self, goes_on: bool) -> bytes:
        ids = np.frombuffer(b"".join(self.ids), "<u4")
        table = [np.array(x, kind).tobytes() for x, kind in zip(zip(*self.docs, strict=True), ("<u4", "<i8", "u1"), strict=True)] if self.docs else [b"", b"", b""]
        planes = to_planes(ids, self.planes)
        head = lambda k: HEAD.pack(BLOCK, self.planes, goes_on, k, self.part, len(self.index), len(ids), len(self.docs), self.done)
        record = sealed(lambda k: head(k) + _packed([*planes, *table], k) + struct.pack("<I", zlib.crc32(ids.tobytes())), self.level)
        self.index.append((self.at, len(record), self.done, len(ids)))
        self.at += len(record) + len(SYNC)
        self.done += len(ids)
        self.ids, self.n, self.docs = [], 0, []
        return record

    def end(self) -> Iterator[bytes]:
        if self.n:
            yield self.block(False)
        if self.index:
            table = [np.array(x, "<u8").tobytes() for x in zip(*self.index, strict=True)]
            yield sealed(lambda k: struct.pack("<4sIIQ", INDEX, self.part, len(self.index), self.done) + _packed(table, k) + struct.pack("<Q", self.at), self.level)


def read_index(record: bytes) -> tuple[int, int, np.ndarray]:
    """(part, ids of the file, rows of (offset, length, first id, ids)) of an index record."""
    magic, part, n, total = struct.unpack_from("<4sIIQ", record)
    if magic != INDEX:
        raise ValueError("no index")
    parts, _ = _unpacked(record, struct.calcsize("<4sIIQ"), 4)
    return part, total, np.stack([np.frombuffer(x, "<u8") for x in parts], axis=1).astype(np.int64)


def read_block(record: bytes) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's head, its ids, and of the documents that begin in it the place, doc_id and whether that is null."""
    magic, planes, goes_on, _, part, block, n, docs, first = HEAD.unpack_from(record)
    if magic != BLOCK:
        raise ValueError("no block of token planes")
    parts, at = _unpacked(record, HEAD.size, planes + 3)
    ids = from_planes(parts[:planes], n)
    if zlib.crc32(ids.tobytes()) != struct.unpack_from("<I", record, at)[0]:
        raise ValueError(f"block {block} of part {part} is damaged")
    return {"part": part, "block": block, "goes_on": bool(goes_on), "first": first}, ids, *(np.frombuffer(x, k) for x, k in zip(parts[planes:], ("<u4", "<i8", "u1"), strict=True))


#: What parts words in one call of the library, where it is a pre-token of its own, and how many words it parts.
PART, PART_WORDS = " \x01", 256
#: First bytes of characters among which there is white space, or that are none.
DOUBTFUL = np.zeros(256, bool)
DOUBTFUL[[*range(0x21), 0xC2, 0xE1, 0xE2, 0xE3, *range(0x80, 0xC0)]] = True

#: ASCII letters and digits, and signs that end a pre-token of them; an apostrophe may begin one of letters.
ALNUM, SIGN = np.zeros(256, bool), np.zeros(256, bool)
ALNUM[[c for c in range(0x80) if chr(c).isalnum()]] = True
SIGN[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True

#: ASCII characters that are no white space.
SURE = bytes(c for c in range(0x80) if not chr(c).isspace())

_encoders: dict[str, ByteEncoder] = {}


class ByteEncoder(dict):
    """The ids of texts under a byte-level tokenizer, word by word, as little-endian 32-bit numbers.

    Its pre-tokens begin anew at a space that a character other than white space follows, and at a line break that an
    ASCII character other than white space precedes, and at a sign after a letter or digit, so the ids of a text are those of the pieces between, in order. Each distinct
    piece is encoded once by the library while a worker remembers it. A text with the special token's string goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        tokenizer = Tokenizer.from_file(path)
        batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.call = lambda texts: [np.array(e.ids, "<u4").tobytes() for e in batch(texts, add_special_tokens=False)]
        self.part = np.frombuffer(self.call([PART])[0], "<u4")
        self.special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]

    @classmethod
    def of(cls, path: str) -> ByteEncoder:
        """One for each worker process, which tasks take over from each other."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new words, many to a call: the library's cost of a call is above that of a word.

        A word goes with others if it begins with white space and does not end with any, so that it meets PART as it would meet a word.
        """
        alone = [w for w in words if w[0] not in b" \n" or not (w[-1] in SURE or not w.decode()[-1].isspace()) or b"\x01" in w or len(w) > CACHED_BYTES]
        out = dict(zip(alone, self.call([w.decode() for w in alone]), strict=True))
        together, mark, width, part = [w for w in words if w not in out] if alone else words, self.part[-1], len(self.part), PART.encode()
        groups = [together[a : a + PART_WORDS] for a in range(0, len(together), PART_WORDS)]
        for group, data in zip(groups, self.call([part.join(g).decode() for g in groups]), strict=True):
            ends = np.flatnonzero(np.frombuffer(data, "<u4") == mark)
            starts, stops = [0, *(4 * ends + 4).tolist()], [*(4 * (ends - (width - 1))).tolist(), len(data)]
            out.update(zip(group, map(data.__getitem__, map(slice, starts, stops)), strict=True))
        return out

    def ids(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = {words[i] for i in missing}
            got = self.learn(list(new))
            for i in missing:
                found[i] = got[words[i]]
            if len(self) > CACHE_WORDS:
                self.clear()
            self.update(got)
            for w in new:
                if len(w) > CACHED_BYTES:
                    del self[w]
        return found

    def encoded(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids of the words between bounds, one after the other, and where each word's begin and the last one's end."""
        words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        _, at, data = words.dictionary.buffers()
        data, at = data.to_pybytes() if data else b"", np.frombuffer(at, np.int64, len(words.dictionary) + 1).tolist()
        out = pa.array(self.ids(list(map(data.__getitem__, map(slice, at, at[1:])))), pa.large_binary()).take(words.indices)
        _, at, data = out.buffers()
        return (data.to_pybytes() if data else b""), np.frombuffer(at, np.int64, len(out) + 1)

    def texts(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """The ids of each text of a slice."""
        if len(self.special) and any(s in (data := raw.tobytes()) for s in self.special):
            for a, b in itertools.pairwise(offsets.tolist()):
                held = any(s in data[a:b] for s in self.special)
                yield self.call([data[a:b].decode()])[0] if held else b"".join(self.stretches(raw[a:b]))
        elif len(raw) > 2 * CHUNK_BYTES:
            for a, b in itertools.pairwise(offsets.tolist()):
                yield b"".join(self.stretches(raw[a:b]))
        else:
            held = np.zeros(len(raw) + 1, bool)
            held[parted(raw)] = held[offsets] = True
            bounds = np.flatnonzero(held)
            data, at = self.encoded(raw, bounds)
            for a, b in itertools.pairwise(at[np.searchsorted(bounds, offsets)].tolist()):
                yield data[a:b]

    def stretches(self, raw: np.ndarray) -> Iterator[bytes]:
        """The ids of one text that may be long, a stretch of words at a time."""
        cut, a = parted(raw), 0
        while a < len(raw):
            k = int(np.searchsorted(cut, a + CHUNK_BYTES))
            b = int(cut[k]) if k < len(cut) else len(raw)
            within = cut[np.searchsorted(cut, a, "right") : k] - a
            yield self.encoded(raw[a:b], np.concatenate([[0], within, [b - a]]))[0]
            a = b


def parted(raw: np.ndarray) -> np.ndarray:
    """Places before which a pre-token ends for sure."""
    cut = np.zeros(len(raw), bool)
    if len(raw) > 1:
        before, here = raw[:-1], raw[1:]
        cut[:-1] = (before == 0x20) & ~DOUBTFUL[here]
        cut[1:] |= (here == 0x0A) & ~DOUBTFUL[before] & (before < 0x80)
        cut[1:] |= ALNUM[before] & SIGN[here]
    return np.flatnonzero(cut)


def _write(path: str, end_id: int, planes: int, block_ids: int, level: int):
    def run(batches):
        encoder, end = ByteEncoder.of(path), np.array([end_id], "<u4").tobytes()
        writer = BlockWriter(TaskContext.get().partitionId(), planes, block_ids, level)
        for batch in batches:
            raw, offsets = kernels.buffers(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for a, b in kernels.slices(offsets):
                for doc, got in zip(ids[a:b], encoder.texts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), strict=True):
                    for record in writer.add(doc, got + end):
                        yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], ["value"])
        for record in writer.end():
            yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], ["value"])

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, planes: int = 4, block_ids: int = BLOCK_IDS, level: int = 3) -> None:
    """Write the ids of all documents, each with ``end_id`` after it, to files in ``folder``, in ascending order of doc_id.

    ``planes``: 4 for byte planes, 32 for bit planes. Null texts are empty and give their end id alone; null doc_ids
    come first; rows of one doc_id are ordered by a hash of their text, and equal rows by where they were read, so that
    even they are dealt over many tasks. Texts of any length are encoded whole. An empty table gives a folder without records. The
    folder must not exist. Other columns play no part, whatever their names.
    """
    if planes not in (4, 32):
        raise ValueError("there are 4 byte planes or 32 bit planes")
    docs = unclashed(docs, id_col, text_col)
    plain = docs.select(column(docs, id_col, "long").alias("doc_id"), F.coalesce(column(docs, text_col, "string"), F.lit("")).alias("text"))
    keyed = plain.withColumns({"mark": F.xxhash64("text"), "task": F.spark_partition_id()})
    dealt = keyed.repartitionByRange("doc_id", "mark", "task").sortWithinPartitions("doc_id", "mark", "task").select("doc_id", "text")
    records = dealt.mapInArrow(_write(tokenizer_path, end_id, planes, block_ids, level), "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", SYNC).text(folder)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("lineSep", SYNC).text(folder).select(F.col("value").cast("binary").alias("value"))


def _indexes(batches):
    for batch in batches:
        rows = []
        for record in batch.column("value").to_pylist():
            part, _, table = read_index(record)
            rows += [(part, k, *map(int, r)) for k, r in enumerate(table)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 6)], ["part", "block", "offset", "length", "first", "ids"])


def chunk_index(spark: SparkSession, folder: str) -> DataFrame:
    """(part, block, offset, length, first, ids) of every block in the folder: its bytes in its part's file, its first id there, and how many it has."""
    only = _records(spark, folder).where(F.substring("value", 1, 4) == F.lit(INDEX))
    return only.mapInArrow(_indexes, "part long, block long, offset long, length long, first long, ids long")


def _pieces(with_ids: bool, whole: bool):
    """Of each block the documents that lie in it whole, or else the pieces of those that do not."""
    kinds = [("part", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("begins", pa.bool_())]
    kinds += [("ids", pa.binary())] if with_ids else []

    def run(batches):
        for batch in batches:
            for record in batch.column("value").to_pylist():
                head, ids, places, docs, nulls = read_block(record)
                data, n = memoryview(ids.tobytes()), len(ids)
                bounds = places.tolist()
                # what stands before the first document that begins here is another block's
                rest = not bounds or bounds[0] > 0
                starts = [0, *bounds] if rest else bounds
                stops = [*starts[1:], n]
                named = [None] * rest + [None if x else d for d, x in zip(docs.tolist(), nulls.tolist(), strict=True)]
                k = len(starts)
                begins, ends = [not rest] + [True] * (k - 1), [True] * (k - 1) + [not head["goes_on"]]
                found = [x for x in zip(starts, stops, named, begins, ends, strict=True) if (x[3] and x[4]) == whole]
                if not found:
                    continue
                starts, stops, named, begins, ends = zip(*found, strict=True)
                k = len(starts)
                values = [[head["part"]] * k, [head["first"] + a for a in starts], named, [b - a for a, b in zip(starts, stops, strict=True)], [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, stops, strict=True)], begins]
                if with_ids:
                    values.append([bytes(data[4 * a : 4 * b]) for a, b in zip(starts, stops, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(values, kinds, strict=True)], [name for name, _ in kinds])

    return run


def _shifted(crc: int, zeros: int) -> int:
    """The crc32 register after so many zero bytes: multiplication by x to the power of 8 * zeros, by squaring."""
    def times(a: int, b: int) -> int:
        out = 0
        for k in range(31, -1, -1):  # bit 31 is the coefficient of x ** 0
            if b >> k & 1:
                out ^= a
            a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
        return out

    step = 1 << 23  # x ** 8
    while zeros:
        if zeros & 1:
            crc = times(crc, step)
        step, zeros = times(step, step), zeros >> 1
    return crc


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """The crc32 of several strings one after the other, from (crc32, bytes) of each."""
    out = 0
    for crc, size in parts:
        out = _shifted(out, size) ^ crc
    return out


def _join_crcs(crcs, sizes):
    import pandas as pd

    return pd.Series([joined_crc(list(zip(map(int, c), (4 * int(n) for n in s), strict=True))) for c, s in zip(crcs, sizes, strict=True)], dtype="int64")


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the folder's files, and ``ids`` (little-endian 32-bit numbers) if asked for.

    ``start`` counts the ids of all documents before it, in all files. Blocks are read by many tasks, in any order; a document
    that spans blocks is put together from one small row for each. What is counted over files is one row for each file.
    """
    records = _records(spark, folder)
    totals = chunk_index(spark, folder).groupBy("part").agg(F.sum("ids").alias("total"))
    before = totals.select(F.col("part"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    schema = "part long, at long, doc_id long, n long, crc long, begins boolean" + ", ids binary" * with_ids
    blocks = records.where(F.substring("value", 1, 4) == F.lit(BLOCK))
    whole = blocks.mapInArrow(_pieces(with_ids, True), schema).drop("begins")
    # a document's pieces: the one that begins it is the last of its block, so those after it have the next blocks
    order = Window.partitionBy("part").orderBy("at")
    cut = blocks.mapInArrow(_pieces(with_ids, False), schema).withColumn("doc", F.sum(F.col("begins").cast("int")).over(order))
    grouped = cut.groupBy("part", "doc").agg(F.min("at").alias("at"), F.max("doc_id").alias("doc_id"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "n", "crc", *["ids"] * with_ids))).alias("all"))
    crc = F.pandas_udf(_join_crcs, "long")(F.col("all.crc"), F.col("all.n"))
    joined = grouped.select("part", "at", "doc_id", "n", crc.alias("crc"), *[F.aggregate("all.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids")] * with_ids)
    # one row for each file, and Spark keeps a list of those anyway
    every = whole.unionByName(joined).join(F.broadcast(before), "part")
    return every.select("doc_id", (F.col("before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), *["ids"] * with_ids)
