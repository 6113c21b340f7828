"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds the model's pieces. Read over a string, it stops at each position and follows its
output links through the pieces that end there, longest first; each relaxes its end from its start.

For a model of piece scores (unigram) the best sum of scores wins, ties to the longest last piece. In a
model of merges (BPE) a score is a merge's rank and the sum means nothing: there a piece extends the
path of its start where the two pieces that meet would also come out side by side if their strings were
merged alone. Exactly one piece at each position does, so the same pass gives the merges' result. Runs of marks
are the one exception, as their pieces have equal ranks: they merge after all else, from the left. A character that no piece covers alone stands below all scores and falls back to its bytes.

Pieces hold the space mark only at their front, so the path of a text is that of its units (marks
and what follows them) in a row. A worker segments each distinct unit once while it remembers it.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import kernels
from tamarack.llm.shared import column, ddl, fresh_prefix, quoted, unclashed

MARK = "▁"
#: A byte that UTF-8 never holds, between units.
CUT = b"\xff"
#: Units and meetings of pieces that a worker remembers, and the bytes of a text that are segmented at once.
UNITS, MEETINGS, CHUNK_BYTES = 700_000, 300_000, 1 << 20
#: Marks at the end of a unit, read backwards: a search from the front would begin anew at each sign of a long run.
TAIL = re.compile(r"[^\w\s▁]+")
#: How far an uncovered character's score lies below the lowest piece's.
UNKNOWN_BELOW = 10.0

_codecs: dict[str, Codec] = {}


class Codec(dict):
    """Ids of units, as little-endian 32-bit numbers, and the bytes of ids."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__({b"": b""})
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.automaton = ahocorasick.Automaton()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids: dict[int, int] = {}
        plain, lowest = [], 0.0
        self.ids: dict[str, tuple[float, int]] = {}
        self.meets: dict[int, bool] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif model.is_unknown(i):
                self.unknown = i
                self.bytes_of[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                if not model.is_unused(i):
                    plain.append(piece)
                    lowest = min(lowest, model.get_score(i))
                    self.ids[piece] = (model.get_score(i), i)
                    self.automaton.add_word(piece, (len(piece), model.get_score(i), i))
        self.automaton.make_automaton()
        self.pairs = {p[k : k + 2] for p in plain for k in range(len(p) - 1)}
        self.names = {i: p for p, (_, i) in self.ids.items()}
        #: Ranks of merges fall by one from piece to piece; log probabilities do not.
        ranks = [g for g, _ in self.ids.values() if g > -1e8]
        self.merges = len(ranks) > 1 and all(g == int(g) for g in ranks) and ranks == sorted(ranks, reverse=True)
        self.beyond = lowest - UNKNOWN_BELOW
        #: Pieces of marks alone rank below all others, and no other piece holds two marks.
        runs = {p for p in self.ids if not p.strip(MARK)}
        lowest_word = min((g for p, (g, _) in self.ids.items() if p not in runs and len(p) > 1), default=0.0)
        self.marks_last = MARK in runs and all(self.ids[p][0] < lowest_word for p in runs) and not any(MARK + MARK in p for p in self.ids if p not in runs)
        self.runs: dict[int, list[int]] = {}
        #: Without these a unit would not be a place to cut.
        self.cuts = all(MARK not in p.lstrip(MARK) for p in plain)
        self.line_cuts = self.cuts and not any("\n" in p for p in plain)

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in _codecs:
            _codecs[path] = cls(path)
        return _codecs[path]

    def merged(self, text: str) -> list[str]:
        """The parts of a string after all merges: the best-ranked neighbours first, the leftmost of equals.

        A queue holds the pairs that may merge, so the time follows the length (and its logarithm) however long a string is.
        """
        parts, n = list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        asks: list[tuple[float, int, str]] = []

        def ask(i: int) -> None:
            if i >= 0 and after[i] < n:
                both = parts[i] + parts[after[i]]
                if both in self.ids:
                    heapq.heappush(asks, (-self.ids[both][0], i, both))

        for i in range(n - 1):
            ask(i)
        while asks:
            _, i, both = heapq.heappop(asks)
            if not parts[i] or after[i] >= n or parts[i] + parts[after[i]] != both:
                continue  # one of the two has merged with another since
            j = after[i]
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            ask(i)
            ask(before[i])
        return [p for p in parts if p]

    def run_of_marks(self, n: int) -> list[int]:
        """The ids of n marks in a row; what a run comes to is remembered by its length."""
        if n not in self.runs:
            if len(self.runs) > 4096:
                self.runs.clear()
            self.runs[n] = [self.ids[p][1] for p in self.merged(MARK * n)]
        return self.runs[n]

    def meet(self, left: int, right: int) -> bool:
        """Would the two pieces stand side by side; left -1: would the right one come out whole."""
        want = ([self.names[left]] if left >= 0 else []) + [self.names[right]]
        if len(self.meets) > MEETINGS:
            self.meets.clear()
        known = self.meets[left << 32 | right] = self.merged("".join(want)) == want
        return known

    def best(self, unit: str) -> list[int]:
        """The ids of the best path."""
        if self.merges and unit.startswith(MARK + MARK):  # pieces of marks alone have equal ranks, for which the pass isn't unique
            word = unit.lstrip(MARK)
            marks = len(unit) - len(word)
            if not self.marks_last:
                return [i for p in self.merged(unit) for i in ([self.ids[p][1]] if p in self.ids else self.fallback(p))]
            # they merge after everything else: the word and the mark before it first, then what marks are left
            rest = self.best(MARK + word) if word else []
            return self.run_of_marks(marks - 1) + rest if rest and rest[0] != self.ids[MARK][1] else self.run_of_marks(marks) + rest[1:]
        n, merges, beyond, meets = len(unit), self.merges, self.beyond, self.meets
        score: list = [0.0] + [None] * n
        sizes, ids = [0] * (n + 1), [-1] * (n + 1)
        at = 0  # ends up to here have all their edges
        for end, (size, gain, piece) in self.automaton.iter(unit):
            end += 1
            while at < end - 1:  # what no piece reaches is reached by its last character alone
                at += 1
                if score[at] is None:
                    score[at], sizes[at] = score[at - 1] + beyond, 1
            if merges:
                if score[end] is None:
                    left = ids[end - size]
                    known = meets.get(left << 32 | piece)
                    if known or known is None and self.meet(left, piece):
                        score[end], sizes[end], ids[end] = 0.0, size, piece
            else:
                got = score[end - size] + gain
                if score[end] is None or got > score[end]:
                    score[end], sizes[end], ids[end] = got, size, piece
        while at < n:
            at += 1
            if score[at] is None:
                score[at], sizes[at] = score[at - 1] + beyond, 1
        out, end = [], n
        while end:
            if ids[end] >= 0:
                out.append(ids[end])
            else:
                out += reversed(self.fallback(unit[end - sizes[end] : end]))
            end -= sizes[end]
        return out[::-1]

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids.get(b, self.unknown) for b in char.encode()] if self.byte_ids else [self.unknown]

    def __missing__(self, unit: bytes) -> bytes:
        if len(self) > UNITS:
            self.clear()
            self[b""] = b""
        text = unit.decode()
        tail = TAIL.match(text[::-1])
        at = len(text) - tail.end() if tail else 0
        # a word and the marks after it are segmented apart where no piece holds the two characters that meet
        if at and text[at - 1 : at + 1] not in self.pairs and self.cuts:
            core = text[:at].encode()
            seen = core in self
            out = self[core] + self[text[at:].encode()]
            if seen:  # of a word met for the first time only the word is kept
                self[unit] = out
            return out
        out = self[unit] = array("I", self.best(text)).tobytes()
        return out

    def encode(self, text: bytes) -> bytes:
        """Ids of a text: a mark stands for each space and before the text; an empty text has none."""
        if not text:
            return b""
        mark = MARK.encode()
        if not self.cuts:
            return self[mark + text.replace(b" ", mark)]
        out, a, first = [], 0, True
        while a < len(text):
            # a long text is cut where a space follows something else, which is between two units
            b = text.find(b" ", a + CHUNK_BYTES) if len(text) - a > CHUNK_BYTES else -1
            while b > 0 and text[b - 1 : b] == b" ":
                b += 1
                b = text.find(b" ", b)
            part = text[a:b] if b > 0 else text[a:]
            a = b if b > 0 else len(text)
            data = (mark if first else b"") + part.replace(b" ", mark)
            first = False
            data = data.replace(mark, CUT + mark)
            while mark + CUT + mark in data:  # marks in a row are one unit
                data = data.replace(mark + CUT + mark, mark + mark)
            if self.line_cuts and b"\n" in data:
                data = data.replace(b"\n", CUT + b"\n" + CUT)
            out.append(b"".join(map(self.__getitem__, data.split(CUT))))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes joined, marks as spaces, without the space before the text. Bytes that are no UTF-8 become U+FFFD."""
        out = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """``decode`` of each ids[offsets[k] : offsets[k + 1]], by one gather of bytes for all."""
        if not hasattr(self, "flat"):
            self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
            self.sizes = np.array([len(b) for b in self.bytes_of], np.int32)
            self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes, dtype=np.int64)
        place = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
        data = self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + place].tobytes()
        at = np.concatenate([[0], ends])[offsets].tolist()
        texts = (data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False))
        return [t[1:] if t.startswith(" ") else t for t in texts]


def _encode(path: str, inner: str):
    def run(batches):
        codec = Codec.of(path)
        for batch in batches:
            raw, offsets = kernels.buffers(batch.column(inner))
            keep = [n for n in batch.schema.names if n != inner]
            for a, b in kernels.slices(offsets):
                data, at = raw[offsets[a] : offsets[b]].tobytes(), (offsets[a : b + 1] - offsets[a]).tolist()
                ids = [codec.encode(data[x:y]) for x, y in zip(at, at[1:], strict=False)]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                sums = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(a, b - a) for n in keep), lists, sums], [*keep, "ids", "ids_crc32"])

    return run


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ids array<int> and ids_crc32 long (over little-endian 32-bit ids), which replace columns of those names.

    A null text is empty; an empty text has no ids; a long one is encoded whole; repeated rows each; an empty table stays
    empty. Of names that differ in case alone all but one get a leading underscore. Without ``keep_text`` the text
    column goes. No shuffle.
    """
    docs = unclashed(docs, text_col)
    rest = docs.drop("ids", "ids_crc32", *([] if keep_text else [text_col]))
    inner = fresh_prefix(docs, "piece") + "text"
    given = docs.select(*[F.col(quoted(c)) for c in rest.columns], column(docs, text_col, "string").alias(inner))
    return given.mapInArrow(_encode(model_path, inner), f"{ddl(rest)}ids array<int>, ids_crc32 long")


def _decode(path: str):
    def run(batches):
        codec = Codec.of(path)
        for batch in batches:
            keep = batch.schema.names
            ids = batch.column("ids")
            for a in range(0, len(batch), 256):
                some = ids.slice(a, 256)
                ends = np.concatenate([[0], np.cumsum(some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                texts = pa.array(codec.decode_all(some.flatten().to_numpy(zero_copy_only=False), ends), pa.string(), mask=some.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(a, 256) for n in keep), texts], [*keep, "decoded"])

    return run


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of its ids (null ids: null)."""
    rest = encoded.drop("decoded")
    return rest.mapInArrow(_decode(model_path), f"{ddl(rest)}decoded string")


def round_trips(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, round_trip): does decoding a document's ids give its text, marks read as spaces.

    Only a checksum and the length of the text travel past the encoder. A null text is empty; an empty table gives no rows.
    """
    docs = unclashed(docs, "doc_id", "text")
    text = F.translate(F.coalesce(column(docs, "text", "string"), F.lit("")), MARK, " ")
    plain = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"), F.xxhash64(text).alias("sum"), F.length(text).alias("size"))
    back = decode(encode(plain, model_path, keep_text=False), model_path)
    same = (F.xxhash64("decoded") == F.col("sum")) & (F.length("decoded") == F.col("size"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", same.alias("round_trip"))
