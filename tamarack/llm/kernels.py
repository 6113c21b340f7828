"""Array kernels over the raw bytes of Arrow string columns.

A batch of texts is seen as one byte buffer with document offsets. Words,
lines and their hashes come out of a handful of vectorised passes, so the cost
of a row does not include a Python call per word. Hashes are 64-bit; where
strings of one text are counted as equal, their bytes are compared as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; a longer text forms a slice of its own.
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
MIX = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(2**61, 2**62, 8)]
#: Spans above this many bytes are hashed one by one.
LONG_SPAN = 256
#: The lowest 0 to 8 bytes of a number.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[0]
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and its len + 1 offsets."""
    if pa.types.is_large_string(column.type) or pa.types.is_string_view(column.type):
        column = column.cast(pa.large_string())
    else:
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


def spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that ``inside`` marks, cut at row ends."""
    before = np.zeros(len(raw), bool)
    after = np.zeros(len(raw), bool)
    if len(raw):
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        full = offsets[:-1] < offsets[1:]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, np.dtype("<u8"), padded, strides=(1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes and length: eight bytes at a time, each mixed in turn; of a long span its BLAKE2 digest.

    Hashes only bring strings together; who needs equality asks ``equal_spans``.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * MIX[2] + MIX[4])
    far = size > LONG_SPAN
    for i in np.flatnonzero(far).tolist():
        out[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]].data, digest_size=8).digest(), "little")
    eights, at, k = _eights(raw), np.flatnonzero(~far), 0
    while len(at):
        rest = size[at] - k
        got = eights[starts[at] + k] & LOW_BYTES[np.minimum(rest, 8)]
        out[at] = mix((out[at] ^ got) * MIX[5] + MIX[6])
        k += 8
        at = at[rest > 8]
    return out


def equal_spans(raw: np.ndarray, first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Do the spans of ``sizes`` bytes from each pair of places hold the same bytes."""
    out = np.ones(len(sizes), bool)
    far = sizes > LONG_SPAN
    for i in np.flatnonzero(far).tolist():
        a, b, n = int(first[i]), int(second[i]), int(sizes[i])
        out[i] = np.array_equal(raw[a : a + n], raw[b : b + n])
    eights, at, k = _eights(raw), np.flatnonzero(~far), 0
    while len(at):
        rest = sizes[at] - k
        out[at] &= ((eights[first[at] + k] ^ eights[second[at] + k]) & LOW_BYTES[np.minimum(rest, 8)]) == 0
        k += 8
        at = at[(rest > 8) & out[at]]
    return out


def seen(rows: np.ndarray, hashes: np.ndarray, equal, name) -> tuple[np.ndarray, np.ndarray]:
    """Of each item: does an equal one stand elsewhere in its row; does one stand earlier in its row.

    Items come in order. ``equal(i, j)`` tells for arrays of items whether they are the same, ``name(i)`` gives one
    item's own value: items that a hash brings together are compared, and where any of them differ all of that hash
    are told apart by their values.
    """
    key = mix(hashes + rows.astype(np.uint64) * MIX[6])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    at = np.flatnonzero(same)
    a, b = order[at], order[at + 1]
    wrong = at[~((rows[a] == rows[b]) & equal(a, b))]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    if len(wrong):
        group = np.concatenate([[0], np.cumsum(~same)])
        first: dict[tuple, int] = {}
        for i in sorted(order[np.isin(group, group[wrong])].tolist()):
            j = first.setdefault((int(rows[i]), name(i)), i)
            later[i], twice[i] = j != i, j != i
            if j != i:
                twice[j] = True
    return twice, later


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(raw, offsets, ~IS_SPACE[raw])


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of ``size`` words, ASCII lower-cased.

    A text of fewer words has its whole sequence as its one shingle, a text without words none.
    """
    raw = LOWER[raw]
    starts, ends, rows = words(raw, offsets)
    hashes = span_hashes(raw, starts, ends)
    first = np.searchsorted(rows, np.arange(len(offsets)))
    runs = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        runs += (hashes[k : k + len(runs)] ^ (hashes[k : k + len(runs)] >> np.uint64(17 + k))) * MIX[3 + k % 4] * np.uint64(2 * k + 1)
    runs = mix(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            got = np.sort(runs[a : b - size + 1])
            keep = np.empty(len(got), bool)
            keep[0] = True
            np.not_equal(got[1:], got[:-1], out=keep[1:])
            out.append(got[keep])
        elif b > a:
            whole = np.uint64(b - a) * MIX[7]
            for k in range(a, b):
                whole = mix(np.array([whole ^ hashes[k]]))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
