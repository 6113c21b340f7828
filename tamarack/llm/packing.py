"""Sum-of-squares packing of tokenised documents into fixed windows.

Each task packs the documents it reads, one at a time. Windows are counted by fill level, UNIT tokens to a level; a document goes
to the level with a window that it fits (or to a new window) for which the sum of the squares of these numbers ends up smallest,
and to the fuller one of equals. A window is done when fewer than UNIT tokens are missing, which the next document's
first tokens fill: nothing is padded. Whole windows of a long document are cut off first.

What a task has open at its end it does not close: those documents go, each whole, through one exchange into few tasks, where
they are many again, and are placed by the same rule. Only what is open at the end of that is joined end to end and cut
into full windows, and the last piece into windows of powers of two, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tamarack.llm import kernels
from tamarack.llm.shared import column, stored, unclashed

CAPACITY, END_ID = 4096, 2
#: Words kept with their ids by a worker, and bytes of a text encoded at once.
CACHE_WORDS, CHUNK_BYTES = 400_000, 1 << 20
#: Tokens to a fill level, and what may be missing in a window that is done.
UNIT = 32
#: Windows open at once in a task, which bounds its memory. Beyond it the fullest one's documents go on to the second pass;
#: there, where they have no other place to go, the two fullest are joined and cut.
OPEN_WINDOWS = 4096
#: Documents left open that make one task of the second pass.
SECOND = 50_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: A character that is one id of its own between white space, and how many words it parts in one call.
PART, PART_WORDS = "\x01", 256

_encoders: dict[str, WordEncoder] = {}


LETTER = np.zeros(256, bool)
LETTER[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True
MARK = np.zeros(256, bool)
MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")


def plain_form(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of the same ids but fewer distinct words: A-Z lower-cased, a space wherever a letter or digit meets a mark.

    The tokenizer lower-cases, and its pre-tokens part there too. Marks are ASCII without the apostrophe,
    which may begin a pre-token of letters; letters are ASCII and those of U+00C0 to U+00FF. A slice that
    holds a special token's string stays as it is.
    """
    low = kernels.LOWER[raw]
    if b"<|" in (data := low.tobytes()) and any(x in data for x in SPECIAL):
        return raw, offsets
    letter, mark = LETTER[low], MARK[low]
    letter[1:] |= (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] != 0x97) & (low[1:] != 0xB7)
    at = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & (letter[1:] | (low[1:] == 0xC3)) & ~_sign(low))) + 1
    return np.insert(low, at, 0x20), offsets + np.searchsorted(at, offsets)


def _sign(low: np.ndarray) -> np.ndarray:
    """Of each byte but the first: does it begin one of the two signs among U+00C0 to U+00FF."""
    after = np.zeros(len(low) - 1 if len(low) else 0, bool)
    after[:-1] = (low[1:-1] == 0xC3) & ((low[2:] == 0x97) | (low[2:] == 0xB7))
    return after


class WordEncoder(dict):
    """The ids of words, as little-endian 32-bit numbers.

    The tokenizer's pre-tokens never cross ASCII white space and it drops that white space, so the ids of a
    text are those of its words in order; a worker encodes each distinct word once while it remembers it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        tokenizer = Tokenizer.from_file(path)
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.call = lambda texts: [e.ids for e in encode(texts, add_special_tokens=False)]
        self.part = self.call([PART])[0]
        self.new: set[bytes] = set()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One for each worker process, which tasks take over from each other."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def __missing__(self, word: bytes) -> None:
        self.new.add(word)

    def learn(self) -> None:
        """Encode the words asked for in vain, many to a call: the library's cost of a call is above that of a word."""
        together, alone = [], []
        for w in self.new:
            (alone if PART.encode() in w or len(self.part) != 1 else together).append(w)
        self.new = set()
        texts = [w.decode("utf-8", "replace") for w in together]
        groups = [f" {PART} ".join(texts[a : a + PART_WORDS]) for a in range(0, len(texts), PART_WORDS)]
        for k, ids in enumerate(self.call(groups)):
            got = np.array(ids, "<u4")
            ends = np.flatnonzero(got == self.part[0]).tolist()
            data = got.tobytes()
            at = together[k * PART_WORDS : (k + 1) * PART_WORDS]
            self.update(zip(at, (data[4 * a + 4 : 4 * b] for a, b in zip([-1, *ends], [*ends, len(got)], strict=True)), strict=True))
        for w, ids in zip(alone, self.call([w.decode("utf-8", "replace") for w in alone]), strict=True):
            self[w] = np.array(ids, "<u4").tobytes()

    def ids(self, words: list[bytes]) -> list[bytes]:
        if len(self) > CACHE_WORDS:
            self.clear()
        found = list(map(self.__getitem__, words))
        if self.new:
            self.learn()
            found = [self[w] if x is None else x for x, w in zip(found, words, strict=True)]
        return found

    def encode_rows(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """The ids of each text of a slice, read in its plain form."""
        raw, offsets = plain_form(raw, offsets)
        yield from self.encode_all(raw.tobytes(), offsets.tolist())

    def encode_all(self, data: bytes, at: list[int]) -> Iterator[bytes]:
        """The ids of each text data[at[k] : at[k + 1]]. A long text is cut at white space, so memory doesn't follow its length."""
        if len(data) <= 2 * kernels.SLICE_BYTES:
            each = [data[a:b].split() for a, b in zip(at, at[1:], strict=False)]
            found = self.ids([w for words in each for w in words])
            a = 0
            for words in each:
                yield b"".join(found[a : a + len(words)])
                a += len(words)
            return
        for a, end in zip(at, at[1:], strict=False):
            out = []
            while a < end:
                b = min(end, a + CHUNK_BYTES)
                while b < end and data[b] not in b" \t\n\r\x0b\x0c":
                    b += 1
                out.append(b"".join(self.ids(data[a:b].split())))
                a = b
            yield b"".join(out)


class Packer:
    """Places documents and yields the pieces of each window when it is done."""

    def __init__(self, capacity: int, first_id: int, unit: int = 1, last: bool = True):
        self.capacity, self.next_id, self.unit, self.last = capacity, first_id, unit, last
        self.levels = -(-capacity // self.unit)
        self.count = np.zeros(self.levels + 1, np.int64)  # windows by fill level
        self.fill = np.zeros(self.levels + 1, np.int64)  # of the window of each level that is next to be filled; nothing where there is none
        self.windows: dict[int, list[tuple[list, int]]] = {}
        self.open = 0
        self.short: tuple[list, int] | None = None  # a window that is done, and the tokens that it lacks
        self.left: list[tuple] = []  # documents for the second pass

    def level(self, size: int) -> int:
        """The fill level to add ``size`` to; 0 opens a window."""
        now, first = self.count, -(-size // self.unit)
        done = lambda fill: fill > self.capacity - self.unit
        new = -1 if done(size) else 2 * int(now[first]) + 1
        at = np.flatnonzero(now[1:]) + 1
        at = at[self.fill[at] + size <= self.capacity]
        if not len(at):
            return 0
        fill = self.fill[at] + size
        then = -(-fill // self.unit)
        # one window less at the old level, one more at the new; a window that is done counts at none
        change = np.where(done(fill), 1 - 2 * now[at], np.where(then == at, 0, 2 * (now[then] - now[at] + 1)))
        best = int(change.min())
        return int(at[np.flatnonzero(change == best)[-1]]) if best <= new else 0

    def close(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, at
            at += len(ids) // 4
        self.next_id += 1

    def take(self, level: int) -> tuple[list, int]:
        pieces, fill = self.windows[level].pop()
        self.count[level] -= 1
        self.fill[level] = self.windows[level][-1][1] if self.windows[level] else 0
        self.open -= 1
        return pieces, fill

    def put(self, pieces: list, fill: int) -> None:
        level = -(-fill // self.unit)
        self.windows.setdefault(level, []).append((pieces, fill))
        self.count[level] += 1
        self.fill[level] = fill
        self.open += 1

    def add(self, doc, ids: bytes, start: int = 0, total: int | None = None) -> Iterator[tuple]:
        """Place a document, or the rest of one from ``start`` on."""
        width, end = self.capacity, start + len(ids) // 4
        total, first = end if total is None else total, start
        if self.short:
            pieces, gap = self.short
            cut = min(gap, end - start)
            pieces.append((doc, start, ids[: 4 * cut], total))
            start += cut
            self.short = (pieces, gap - cut) if cut < gap else None
            if self.short is None:
                yield from self.close(pieces)
        while end - start >= width:
            a = 4 * (start - first)
            yield from self.close([(doc, start, ids[a : a + 4 * width], total)])
            start += width
        if start == end:
            return
        at = self.level(end - start)
        pieces, fill = self.take(at) if at else ([], 0)
        pieces.append((doc, start, ids[4 * (start - first) :], total))
        fill += end - start
        if fill == width:
            yield from self.close(pieces)
        elif fill > width - self.unit:
            self.short = pieces, width - fill
        else:
            self.put(pieces, fill)
            if self.open > OPEN_WINDOWS:
                fullest = int(np.flatnonzero(self.count)[-1])
                if self.last:
                    yield from self.join_fullest()
                else:
                    self.left += self.take(fullest)[0]

    def join_fullest(self) -> Iterator[tuple]:
        """The two fullest windows joined: one full window and what is left over, at its own level."""
        both, size = [], 0
        for _ in range(2):
            pieces, fill = self.take(int(np.flatnonzero(self.count)[-1]))
            both += pieces
            size += fill
        if size >= self.capacity:
            now, room = [], self.capacity
            while room:
                doc, start, ids, total = both.pop(0)
                cut = min(room, len(ids) // 4)
                now.append((doc, start, ids[: 4 * cut], total))
                if 4 * cut < len(ids):
                    both.insert(0, (doc, start + cut, ids[4 * cut :], total))
                room -= cut
            size -= self.capacity
            yield from self.close(now)
        if size:
            self.put(both, size)

    def leave(self) -> list[tuple]:
        """The documents of all open windows, which are no longer open."""
        out, self.left = [*(self.short[0] if self.short else []), *self.left], []
        self.short = None
        for level in sorted(self.windows, reverse=True):
            for pieces, _ in self.windows[level]:
                out += pieces
        self.windows, self.open = {}, 0
        self.count[:] = 0
        self.fill[:] = 0
        return out

    def join_open(self) -> Iterator[tuple]:
        left: list = []
        size = 0
        for doc, start, ids, total in self.leave():
            while size + len(ids) // 4 >= self.capacity:
                cut = self.capacity - size
                yield from self.close([*left, (doc, start, ids[: 4 * cut], total)])
                left, size, start, ids = [], 0, start + cut, ids[4 * cut :]
            if ids:
                left.append((doc, start, ids, total))
                size += len(ids) // 4
        while size:
            width = 1 << (size.bit_length() - 1)
            now, need = [], width
            while need:
                doc, start, ids, total = left.pop(0)
                cut = min(need, len(ids) // 4)
                now.append((doc, start, ids[: 4 * cut], total))
                if 4 * cut < len(ids):
                    left.insert(0, (doc, start + cut, ids[4 * cut :], total))
                need -= cut
            size -= width
            yield from self.close(now)


KINDS = [pa.int64()] * 7
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)


def _pack(path: str, capacity: int, end_id: int, unit: int):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(columns[:7], KINDS, strict=True)), pa.array(columns[7], pa.binary())], [*NAMES, "ids"])

    def run(batches):
        encoder, end = WordEncoder.of(path), np.array([end_id], "<u4").tobytes()
        packer, out = Packer(capacity, TaskContext.get().partitionId() << 33, unit, last=False), []
        for batch in batches:
            raw, offsets = kernels.buffers(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for a, b in kernels.slices(offsets):
                got_rows = encoder.encode_rows(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for doc, got in zip(ids[a:b], got_rows, strict=True):
                    out += packer.add(doc, got + end)
                if len(out) >= 4096:
                    yield batch_of([(*row, None) for row in out])
                    out = []
        if out:
            yield batch_of([(*row, None) for row in out])
        left = packer.leave()
        for a in range(0, len(left), 512):
            yield batch_of([(doc, start, len(ids) // 4, 0, total, -1, 0, ids) for doc, start, ids, total in left[a : a + 512]])

    return run


def _pack_rest(capacity: int, unit: int):
    def run(batches):
        # above the ids that the first pass gives
        packer, out = Packer(capacity, 1 << 62 | TaskContext.get().partitionId() << 33, unit), []
        for batch in batches:
            for doc, start, total, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                out += packer.add(doc, ids, start, total)
            if out:
                yield _batch_of(out)
                out = []
        out = list(packer.join_open())
        if out:
            yield _batch_of(out)

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A task packs what it reads; only what it leaves open is exchanged, with its ids. A sequence_id carries the number of its partition. A
    null text is empty and gives its end id alone; a null doc_id stays null; repeated rows are packed each. ``ids_crc32`` is over the
    piece's ids as little-endian unsigned 32-bit numbers. A long text fills windows of its own before its rest is
    placed; of equally good levels the fullest is taken. An empty table gives no rows. Other columns play no part.
    """
    docs = unclashed(docs, id_col, text_col)
    plain = docs.select(column(docs, id_col, "long").alias("doc_id"), column(docs, text_col, "string").alias("text"))
    first = stored(plain.mapInArrow(_pack(tokenizer_path, capacity, end_id, UNIT), f"{SCHEMA}, ids binary"), "packed")
    rest = first.where("ids IS NOT NULL")
    again = rest.repartition(-(-rest.count() // SECOND) or 1).mapInArrow(_pack_rest(capacity, UNIT), SCHEMA)
    return first.where("ids IS NULL").drop("ids").unionByName(again)
