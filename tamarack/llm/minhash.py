"""Near-duplicate documents by circulant MinHash with exact confirmation.

Signature: a first permutation sends each shingle to one of ``POSITIONS`` places, a second one gives
each place a rank. Coordinate k of a signature is the smallest rank over the document's places when
the second permutation is shifted circularly by k, so two permutations yield all coordinates: for a
shingle they are one contiguous slice of the rank table.

Plan: documents -> distinct sets (copies collapse to one class with an id of its own) -> band keys of
the classes -> each bucket's smallest class leads it -> (leader, member) pairs, once each -> whole sets
joined to the pairs, a leader's dealt to its members in shares. A member whose set matches its leader's
is linked there. The others are compared exactly with every member of the same leader, in blocks of
bounded size that are dealt by block and not by leader, and each block returns a spanning forest of its
links, never its pairs. All pairs that share any bucket share a leader, so none is missed.

Shingles are 64-bit hashes of their words; a link is confirmed on the full sets of them. Two different
shingles of a pair of documents with n shingles each meet with probability n^2 / 2^64 (5e-13 at 3,000).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import kernels
from tamarack.llm.graph import components
from tamarack.llm.shared import column, fresh_prefix, neutral, stored, unclashed

POSITIONS = 1 << 20
#: A pair at similarity 0.85 shares no bucket with probability 8e-7, one at 0.9 with 1e-9.
BANDS, ROWS = 24, 5
#: Most shingles and most members of one block of members.
BLOCK_SHINGLES, BLOCK_MEMBERS = 1_000_000, 512
#: Members that one copy of a leader's set is dealt to.
SHARE = 1024
#: Bits of the filter that texts and keys pass before they are shuffled.
FILTER_BITS = 1 << 25

_ranks: dict[int, np.ndarray] = {}


def ranks(width: int) -> np.ndarray:
    """Row j: the ranks of place j under shifts 0 .. width - 1."""
    if width not in _ranks:
        order = np.random.Generator(np.random.PCG64(7)).permutation(POSITIONS).astype(np.uint32)
        _ranks[width] = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:width]]), width)
    return _ranks[width]


def signature(hashes: np.ndarray, width: int) -> np.ndarray:
    table = ranks(width)
    places = (hashes >> np.uint64(44)).astype(np.int64)  # the first permutation: the top bits of a mixed hash
    out = np.full(width, np.uint32(POSITIONS), np.uint32)
    for a in range(0, len(places), 2048):
        np.minimum(out, table[places[a : a + 2048]].min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands * rows) signatures to (documents, bands) keys; a key names its band too."""
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for k in range(rows):
        keys = kernels.mix(keys ^ parts[:, :, k] ^ kernels.MIX[k % 8])
    return kernels.mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * kernels.MIX[4])


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    raw, offsets = kernels.buffers(column)
    for a, b in kernels.slices(offsets):
        yield from kernels.shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)


def _describe(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            n = len(batch)
            counts, marks, signatures = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64), np.zeros((n, bands * rows), np.uint32)
            for i, s in enumerate(_sets(batch.column("text"), size)):
                if len(s):
                    counts[i] = len(s)
                    marks[i] = s.sum(), np.bitwise_xor.reduce(kernels.mix(s + kernels.MIX[5]))
                    signatures[i] = signature(s, bands * rows)
            keys = band_keys(signatures, bands, rows).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            marks = marks.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sum"), pa.array(counts), pa.array(marks[:, 0]), pa.array(marks[:, 1]), lists], ["doc_id", "sum", "n", "x", "y", "keys"]
            )

    return run


def _whole_sets(size: int):
    def run(batches):
        for batch in batches:
            rows, a, held = [], 0, 0
            for i, s in enumerate(_sets(batch.column("text"), size)):
                rows.append(s.view(np.int64))
                held += len(rows[-1])
                if held > 1 << 20 or i + 1 - a == 256:
                    yield _set_batch(batch, a, rows)
                    rows, a, held = [], i + 1, 0
            if rows:
                yield _set_batch(batch, a, rows)

    return run


def _set_batch(batch: pa.RecordBatch, a: int, rows: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))
    return pa.RecordBatch.from_arrays([batch.column("cid").slice(a, len(rows)), lists], ["cid", "shingles"])


def _forest(num: int, den: int):
    """Spanning forest of the exact links between open members and all members of a block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, first = np.unique(table["member"].to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        open_ = table["open"].to_numpy(zero_copy_only=False).astype(bool)
        lists = table["shingles"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        sizes = np.diff(lists.offsets.to_numpy())
        flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(nodes)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        term = np.cumsum(new) - 1
        often = np.bincount(term) > 1  # what one member alone holds is in no intersection
        keep = often[term]
        term, owner = (np.cumsum(often) - 1)[term[keep]], owner[keep]
        left = np.flatnonzero(open_)
        both = np.zeros((len(left), len(nodes)), np.float32)
        step = max(64, (4 << 20) // max(1, len(nodes)))
        for a in range(0, int(often.sum()), step):
            lo, hi = np.searchsorted(term, [a, a + step])
            part = np.zeros((len(nodes), step), np.float32)
            part[owner[lo:hi], term[lo:hi] - a] = 1
            both += part[left] @ part.T
        # row by row, so that whole numbers take no room beside the products
        linked = np.empty(both.shape, bool)
        for i in range(len(left)):
            common = np.rint(both[i]).astype(np.int64)
            linked[i] = den * common >= num * (sizes[left[i]] + sizes - common)
        linked[np.arange(len(left)), left] = False
        # breadth first over rows and columns of the link matrix, which holds a row for each open member
        row_of = np.full(len(nodes), -1)
        row_of[left] = np.arange(len(left))
        fresh, out = np.ones(len(nodes), bool), []
        for start in left.tolist():
            if not fresh[start]:
                continue
            fresh[start], queue = False, [start]
            while queue:
                i = queue.pop()
                near = np.zeros(len(nodes), bool)
                if row_of[i] >= 0:
                    near |= linked[row_of[i]]
                near[left] |= linked[:, i]
                near &= fresh
                fresh[near] = False
                new = np.flatnonzero(near).tolist()
                out += [(nodes[i], nodes[j]) for j in new]
                queue += new
        out = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    return run


MARK = ["n", "x", "y"]


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, sum): ``sum`` tells the texts of one doc_id apart."""
    text = column(docs, text_col, "string")
    return docs.select(column(docs, id_col, "long").alias("doc_id"), text.alias("text"), F.xxhash64(text, F.octet_length(text)).alias("sum"))


def _classes(texts: DataFrame, size: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Each row's mark (doc_id, sum, n, x, y, keys), and the classes of equal sets (n, x, y, cid, first, keys).

    ``first`` is the smallest (doc_id, sum) of a class. The ids are given as the classes are written, so they stand
    whatever is computed again.
    """
    described = stored(texts.mapInArrow(_describe(size, bands, rows), "doc_id long, sum long, n long, x long, y long, keys array<long>"), "minhash")
    full = described.where("doc_id is not null and n > 0")
    classes = full.groupBy(*MARK).agg(F.min(F.struct("doc_id", "sum")).alias("first"), F.first("keys").alias("keys"))
    return described, stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")


def _perhaps(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows`` whose keys ``chosen`` may hold, with all that it does hold, without a shuffle: a join that decides must follow.

    A filter of ``FILTER_BITS`` in maps of 4 KB, 4 MB however many keys are chosen; two million pass 6 % of the other rows,
    and what more keys cost is rows that are shuffled in vain.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    maps = chosen.select(bit.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))
    at = rows.withColumn("_bit", bit).withColumn("_map", F.bitmap_bucket_number("_bit"))
    place = F.bitmap_bit_position("_bit")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, (place % 8).cast("int")) == 1
    return at.join(F.broadcast(maps), "_map").where(held).select(*rows.columns)


def _links(texts: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): enough links between classes to connect all that any chain of links connects."""
    keyed = classes.select("cid", F.explode("keys").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("cid").alias("lead"), F.max("cid").alias("last")).where("lead <> last").select("key", "lead")
    heads = stored(heads, "heads")  # few keys are held twice: the others are not shuffled again
    pairs = stored(_perhaps(keyed, heads, ["key"]).join(heads, "key").where("cid <> lead").select("lead", F.col("cid").alias("member")).distinct(), "pairs")

    # the whole sets of the classes that share a bucket, read from the texts again rather than kept for all
    named = pairs.select(F.col("lead").alias("cid")).unionByName(pairs.select(F.col("member").alias("cid"))).distinct()
    chosen = classes.join(named, "cid", "left_semi").select("cid", "first.doc_id", "first.sum")
    # only rows that may be chosen are shuffled; rows that repeat are one by the same keys, so their texts travel once
    once = _perhaps(texts, chosen, ["doc_id", "sum"]).join(chosen.hint("merge"), ["doc_id", "sum"]).dropDuplicates(["doc_id", "sum"])
    sets = stored(once.select("cid", "text").mapInArrow(_whole_sets(size), "cid long, shingles array<long>"), "sets")

    shares = pairs.groupBy("lead").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    dealt = pairs.join(shares, "lead").select("lead", "member", F.pmod(F.xxhash64("member"), "shares").cast("int").alias("share"))
    right = sets.select(F.col("cid").alias("member"), "shingles", F.size("shingles").cast("long").alias("n"))
    left = sets.join(shares, sets.cid == shares.lead).select("lead", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("shingles").alias("lead_shingles"))
    common, total = F.size(F.array_intersect("shingles", "lead_shingles")), F.size("shingles") + F.size("lead_shingles")
    stars = dealt.join(right, "member").join(left, ["lead", "share"]).withColumn("common", common)
    stars = stored(stars.select("lead", "member", "n", (100 * F.col("common") < percent * (total - F.col("common"))).alias("open")), "stars")
    # blocks: open members meet every member of their leader, settled ones need not meet each other
    many = lambda w: F.greatest(F.ceil(F.sum(F.when(w, F.col("n"))) / BLOCK_SHINGLES), F.ceil(F.sum(F.when(w, 1)) / BLOCK_MEMBERS), F.lit(1)).cast("int")
    need = stars.groupBy("lead").agg(many(F.col("open")).alias("nu"), many(~F.col("open")).alias("nv"), F.max("open").alias("any")).where("any").drop("any")
    at = stars.join(need, "lead").withColumn("h", F.xxhash64("member"))
    own = F.when(F.col("open"), F.pmod("h", "nu")).otherwise(F.pmod("h", "nv"))
    at = at.withColumn("own", own.cast("int"))
    meets = F.when(
        F.col("open"),
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("nu") - 1), lambda j: F.struct(F.least(j, "own").alias("i"), F.greatest(j, "own").alias("j"), F.lit(False).alias("v"))),
            F.transform(F.sequence(F.lit(0), F.col("nv") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("v"))),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("nu") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(True).alias("v"))))
    # one block of each kind: all of them meet in one place
    meets = F.when((F.col("nu") == 1) & (F.col("nv") == 1), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("v")))).otherwise(meets)
    # the places come first and the sets after them, dealt by block: no task holds what one leader alone gathers
    seats = at.select("lead", "member", "open", F.explode(meets).alias("to")).select("lead", "to.*", "member", "open")
    blocks = seats.join(right.drop("n"), "member").repartition("lead", "i", "j", "v")
    more = blocks.groupBy("lead", "i", "j", "v").applyInArrow(_forest(percent, 100), "a long, b long")
    settled = stars.where("not open").select(F.col("lead").alias("a"), F.col("member").alias("b"))
    return settled.unionByName(more)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set holds its
    distinct runs of ``size`` words, or its whole sequence when it has fewer. Documents are linked
    where 100 * intersection >= percent * union. A null text is empty; an empty set is linked with
    nothing (component_id = doc_id). Rows that repeat a doc_id count as one document with several
    texts. A row whose doc_id is null is linked with nothing: component_id null, kept true. Texts of any
    length are read whole; an empty table gives no rows. Extra columns of ``docs`` are not read.
    """
    texts = _read(unclashed(docs, id_col, text_col), id_col, text_col)
    described, classes = _classes(texts, size, bands, rows)
    full = described.where("doc_id is not null and n > 0")
    # a doc_id of several texts joins their classes
    twice = full.groupBy("doc_id").agg(F.min(F.struct(*MARK)).alias("u"), F.max(F.struct(*MARK)).alias("w")).where("u <> w").select("doc_id")
    several = full.join(twice, "doc_id", "left_semi").join(classes.select(*MARK, "cid"), MARK).select("doc_id", "cid")
    several = several.join(several.groupBy("doc_id").agg(F.min("cid").alias("a")), "doc_id").select("a", F.col("cid").alias("b"))
    links = stored(_links(texts, classes, size, percent).unionByName(several), "links")
    found = components(links).withColumnsRenamed({"node": "cid"})
    # the smallest doc_id of each component, by a minimum that is combined before it is shuffled
    reps = classes.select("cid", F.col("first.doc_id").alias("rep"))
    least = found.join(reps, "cid").groupBy("component").agg(F.min("rep").alias("least"))
    found = found.join(least, "component").select("cid", "least")
    named = classes.join(found, "cid", "left").select(*MARK, F.coalesce("least", "first.doc_id").alias("component_id"))
    linked = full.join(named, MARK).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = described.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row of each group of linked texts: that of the smallest doc_id, with its columns as they came.

    Here a text is linked by its content alone: rows that share a doc_id but not their text go or stay each by its
    own links, so no text is lost that has no near copy among those kept. Rows that repeat both are one. Rows without
    a doc_id and texts without words are linked with nothing and stay. An empty table stays empty. Other columns may
    have any names.
    """
    names, docs = docs.columns, neutral(docs, id_col, text_col)
    texts = _read(docs, id_col, text_col)
    described, classes = _classes(texts, size, bands, rows)
    found = components(stored(_links(texts, classes, size, percent), "links")).withColumnsRenamed({"node": "cid"})
    best = found.join(classes.select("cid", "first"), "cid").groupBy("component").agg(F.min("first").alias("best"))
    found = found.join(best, "component").select("cid", "best")
    named = classes.join(found, "cid", "left").select(*MARK, F.coalesce("best", "first").alias("best"))
    rows_ = described.where("doc_id is not null and n > 0").groupBy("doc_id", "sum", *MARK).agg(F.count("*").alias("times"))
    rows_ = stored(rows_.join(named, MARK).select("doc_id", "sum", "times", (F.struct("doc_id", "sum") != F.col("best")).alias("goes")), "verdicts")
    p = fresh_prefix(docs, "near")
    keyed = docs.withColumns({f"{p}id": column(docs, id_col, "long"), f"{p}sum": F.xxhash64(column(docs, text_col, "string"), F.octet_length(column(docs, text_col, "string")))})
    on = [f"{p}id", f"{p}sum"]
    of = lambda w: rows_.where(w).select(F.col("doc_id").alias(on[0]), F.col("sum").alias(on[1]))
    left = keyed.join(of("goes"), on, "left_anti")
    again = of("times > 1 and not goes")
    once = left.join(again, on, "left_anti").unionByName(left.join(again, on, "left_semi").dropDuplicates(on))
    return once.drop(*on).toDF(*names)
