"""The entries of large JSON objects and arrays, read by many tasks.

A file is read as stretches between commas, which Spark's text reader cuts from byte ranges of it in any store. Whether a comma
parts two entries depends on all that stands before it: on being inside a string and on the depth of brackets. Both
are sums, so a first pass takes them over each range, with either beginning, a running sum over ranges tells
each range where it begins, and a second pass cuts the entries. What begins in one range and ends in another is put together
by a key that no other entry has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.sources.scratch import stored

STRETCHES = "file string, block long, text binary"
SPACE = b" \t\r\n"


#: Bytes that may open or close a string or a bracket.
SIGNS = np.zeros(256, bool)
SIGNS[list(b'"{}[]')] = True


def _signs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the signs of a batch stand, which are quotes that are not escaped, and what each bracket adds to the depth. A backslash never escapes a comma."""
    where = np.flatnonzero(SIGNS[raw])
    found = raw[where]
    quotes = found == 0x22
    slashes = raw == 0x5C
    if slashes.any():
        last = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(raw))))  # the last byte that is none
        before = np.maximum(where - 1, 0)
        quotes &= ~((where > 0) & slashes[before] & ((before - last[before]) % 2 == 1))
    opens, closes = (found == 0x7B) | (found == 0x5B), (found == 0x7D) | (found == 0x5D)
    return where, quotes, opens.astype(np.int64) - closes


class Scan:
    """Reads one range's stretches: in a string or not, and how deep."""

    def __init__(self, inside: bool = False, depth: int = 0):
        self.inside, self.depth = inside, depth

    def read(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the end of each stretch of a batch: is it in a string, and how deep."""
        where, quotes, steps = _signs(raw)
        inside = (np.cumsum(quotes) + self.inside) % 2 == 1
        depth = np.cumsum(steps * ~inside) + self.depth
        at = np.searchsorted(where, ends)
        insides, depths = np.concatenate([[self.inside], inside])[at], np.concatenate([[self.depth], depth])[at]
        if len(ends):
            self.inside, self.depth = bool(insides[-1]), int(depths[-1])
        return insides, depths


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = column.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """Stretches of one range in a row: (file and range, first, end)."""
    file, block, new = batch.column("file"), batch.column("block").to_numpy(), np.ones(len(batch), bool)
    if len(batch) > 1:
        new[1:] = pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
    firsts = np.flatnonzero(new).tolist()
    for a, b in zip(firsts, [*firsts[1:], len(batch)], strict=True):
        yield (file[a].as_py(), int(block[a])), a, b


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, odd, plain, quoted = None, False, 0, 0
    names = ["file", "block", "odd", "plain", "quoted"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def row():
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*now, int(odd), plain, quoted), kinds, strict=True)], names)

    for batch in batches:
        raw, at = _buffers(batch.column("text"))
        for key, a, b in _runs(batch):
            if key != now:
                if now is not None:
                    yield row()
                now, odd, plain, quoted = key, False, 0, 0
            _, quotes, steps = _signs(raw[at[a] : at[b]])
            inside = (np.cumsum(quotes) + odd) % 2 == 1
            # what is in a string for one beginning is outside for the other
            plain, quoted = plain + int(steps[~inside].sum()), quoted + int(steps[inside].sum())
            odd = bool((quotes.sum() + odd) % 2)
    if now is not None:
        yield row()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries and pieces of entries of each range: (file, block, at, head, tail, text)."""
    now, scan, held, place = None, None, [], 0
    names = ["file", "block", "at", "head", "tail", "text"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
    out: list[tuple] = []
    head = True

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for batch in batches:
        raw, at = _buffers(batch.column("text"))
        begins = batch.column("inside")
        for key, a, b in _runs(batch):
            if key != now:
                if held:
                    out.append((*now, place, head, False, b",".join(held)))
                now, held, place = key, [], 0
                scan = Scan(begins[a].as_py(), batch.column("depth")[a].as_py())
                # a range begins with an entry where the one before it ended with a comma between two, or a file begins
                head = not scan.inside and scan.depth <= 1
            part, ends = raw[at[a] : at[b]], at[a + 1 : b + 1] - at[a]
            insides, depths = scan.read(part, ends)
            # the stretches with their commas between them; an entry reaches from one border to the next
            data, start = np.insert(part, ends[:-1], 0x2C).tobytes(), 0
            for end in (ends + np.arange(b - a))[~insides & (depths <= 1)].tolist():
                out.append((*now, place, head, True, b",".join([*held, data[start:end]]) if held else data[start:end]))
                held, head, place, start = [], True, place + 1, end + 1
            if start <= len(data):
                held.append(data[start:])
        if len(out) >= 1000:
            yield rows()
            out.clear()
    if held:
        out.append((*now, place, head, False, b",".join(held)))
    if out:
        yield rows()


def entries(spark: SparkSession, paths: str | list[str], opens: str = "{") -> DataFrame:
    """(file, pos, entry): the text of each entry of the JSON object (or array, with opens='[') in each file.

    ``pos`` rises through a file; it is not dense. A file of anything else is an error, blank files and empty objects have none.
    """
    closes = {"{": "}", "[": "]"}[opens]
    wanted = f"no JSON {'object' if opens == '{' else 'array'} in "
    lines = spark.read.option("lineSep", ",").text(paths)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("text"))
    ranges = stored(rows.mapInArrow(_sums, "file string, block long, odd long, plain long, quoted long"), "ranges")
    # a row for each byte range that a task reads: in a string there is where an odd number of quotes stands before
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = ranges.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    begun = begun.withColumn("step", F.when(F.col("inside"), F.col("quoted")).otherwise(F.col("plain"))).withColumn("ends_inside", F.col("inside") != (F.col("odd") == 1))
    begun = begun.withColumns({"depth": F.coalesce(F.sum("step").over(before), F.lit(0)), "last": F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()})
    sound = F.when(F.col("last") & ((F.col("depth") + F.col("step") != 0) | F.col("ends_inside")), F.raise_error(F.concat(F.lit(wanted), F.col("file"))).cast("long")).otherwise(F.col("depth"))
    begun = begun.select("file", "block", "inside", sound.alias("depth"), "last")
    pieces = stored(rows.join(F.broadcast(begun.drop("last")), ["file", "block"]).mapInArrow(_cut, "file string, block long, at long, head boolean, tail boolean, text binary"), "pieces")
    pos = F.col("block") + F.col("at")  # an entry is a byte long at least, so these never meet
    whole = pieces.where("head AND tail").select("file", pos.alias("pos"), F.col("text").cast("string").alias("entry"))
    parted = pieces.where("NOT (head AND tail)").withColumn("pos", pos)
    chain = parted.withColumn("entry_no", F.sum(F.col("head").cast("int")).over(Window.partitionBy("file").orderBy("pos")))
    joined = chain.groupBy("file", "entry_no").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("text").cast("string").alias("text")))), lambda x: x["text"]), ",").alias("entry"))
    every = whole.unionByName(joined.select("file", "pos", "entry"))
    ends = every.groupBy("file").agg(F.min("pos").alias("first"), F.max("pos").alias("end"))
    bare = F.btrim("entry", F.lit(" \t\n\x0b\f\r"))
    stripped = F.when(F.col("pos") == F.col("first"), F.when(bare.startswith(opens), F.substr(bare, F.lit(2))).when(bare == "", bare).otherwise(F.raise_error(F.concat(F.lit(wanted), F.col("file"))))).otherwise(bare)
    placed = every.join(F.broadcast(ends), "file").withColumn("entry", stripped)  # a row for each file
    closing = F.when(F.col("pos") == F.col("end"), F.when(F.col("entry").endswith(closes), F.expr("left(entry, length(entry) - 1)")).when(F.col("entry") == "", F.col("entry")).otherwise(F.raise_error(F.concat(F.lit(wanted), F.col("file"))))).otherwise(F.col("entry"))
    return placed.select("file", "pos", closing.alias("entry")).where(F.trim("entry") != "")


def map_entries(spark: SparkSession, paths: str | list[str], value: str) -> DataFrame:
    """(file, pos, key, value) of every entry; one that is no JSON is an error."""
    rows = entries(spark, paths)
    parsed = rows.withColumn("e", F.map_entries(F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), f"map<string,{value}>")))
    fine = F.when(F.size("e") == 1, F.col("e")[0]).otherwise(F.raise_error(F.concat(F.lit("no JSON object in "), F.col("file"))).cast(f"struct<key:string,value:{value}>"))
    return parsed.withColumn("x", fine).select("file", "pos", F.col("x.key").alias("key"), F.col("x.value").alias("value"))
