"""A trie of conversation prefixes, rolled up by pointer jumping.

A node is named by a digest of the turns on its way: four residues of a polynomial over the turns' SHA-256.
Such digests compose: that of a conversation cut anywhere follows from those of its parts, so turns are
digested in sorted ranges of about equal size, and one endless conversation is spread over many tasks. The node
before a turn gives each node's parent edge. Then every node points twice as far up in each round: what a node
has gathered from below goes to the ancestor it points to, and it takes over that ancestor's own pointer. The
rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

import itertools
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.shared import column, spread_join, stored, unclashed

#: The residues' moduli, primes below 2 ** 31, so that products fit 64 bits, and the polynomials' points.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
POINTS = np.array([1103515245, 1566083941, 1812433253, 1664525011], np.uint64) % PRIMES
INVERSES = np.array([pow(int(b), -1, int(p)) for b, p in zip(POINTS, PRIMES, strict=True)], np.uint64)
#: The root's name: the digest of no turns.
ROOT = bytes(16)
#: Conversations with ids of one hundred share the turns of the first; of a beginning this many at most.
GROUP, MOST_SHARED = 100, 5
#: Bytes of ids that travel as one row.
PIECE = 1 << 16


def _powers(base: np.ndarray, n: int) -> np.ndarray:
    """(4, n): each base to the powers 0 to n - 1."""
    out, step = np.ones((4, 1), np.uint64), base.copy()
    while out.shape[1] < n:
        out = np.concatenate([out, out * step[:, None] % PRIMES[:, None]], axis=1)
        step = step * step % PRIMES
    return out[:, :n]


def _raised(exponents: np.ndarray) -> np.ndarray:
    """(4, n): the points to the given powers."""
    out, step, left = np.ones((4, len(exponents)), np.uint64), POINTS.copy(), exponents.astype(np.uint64)
    while left.any():
        out = np.where((left & np.uint64(1)).astype(bool), out * step[:, None] % PRIMES[:, None], out)
        step = step * step % PRIMES
        left >>= np.uint64(1)
    return out


def _lanes(values: pa.Array) -> np.ndarray:
    """(4, n) residues of a column of names; nulls are zero."""
    joined = b"".join(ROOT if x is None else x for x in values.to_pylist())
    return np.frombuffer(joined, "<u4").reshape(-1, 4).T.astype(np.uint64)


def _names(lanes: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(lanes.T.astype("<u4")).tobytes()
    return pa.array([data[k : k + 16] for k in range(0, len(data), 16)], pa.binary())


def chained(x: np.ndarray, fresh: np.ndarray, carry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests after and before each turn. ``x``: (4, n) turns; ``fresh``: does a conversation begin here; ``carry``: the digest before the first."""
    n = x.shape[1]
    p, up, down = PRIMES[:, None], _powers(POINTS, n + 1), _powers(INVERSES, n + 1)
    total = np.zeros((4, n + 1), np.uint64)
    np.cumsum(x * down[:, 1:] % p, axis=1, out=total[:, 1:])  # below 2 ** 31 each, so that billions add up
    starts = np.flatnonzero(fresh)
    at = np.searchsorted(starts, np.arange(n), "right") - 1
    begun = np.where(at >= 0, starts[at] if len(starts) else 0, 0)
    after = (total[:, 1:] - total[:, begun]) % p * up[:, 1:] % p
    first = at < 0
    after[:, first] = (after[:, first] + carry[:, None] * up[:, 1:][:, first]) % p
    before = np.concatenate([carry[:, None], after[:, :-1]], axis=1)
    before[:, fresh] = 0
    return after, before


def _digest(batches):
    """Sorted turns of a task with their place and digests within it."""
    part, conv, at, carry = TaskContext.get().partitionId(), None, 0, np.zeros(4, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy()
        data = b"".join(batch.column("mark").to_pylist())
        x = np.frombuffer(data, "<u8").reshape(-1, 4).T % PRIMES[:, None]
        fresh = np.concatenate([[conv is None or ids[0] != conv], ids[1:] != ids[:-1]])
        after, before = chained(x, fresh, carry)
        starts = np.where(fresh, np.arange(len(ids)), -1)
        places = np.arange(len(ids)) - np.maximum.accumulate(starts) + 1
        if not fresh[0]:
            places[np.maximum.accumulate(starts) < 0] = at + 1 + np.arange(int((np.maximum.accumulate(starts) < 0).sum()))
        conv, at, carry = ids[-1], int(places[-1]), after[:, -1]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(np.full(len(ids), part, np.int64)), pa.array(places.astype(np.int64)), _names(after), _names(before), batch.column("chars")],
            ["conv_id", "part", "place", "name", "parent", "chars"],
        )


def _lift(batches):
    """Digests of turns after other beginnings: ``added`` (times the point to the power of ``after``) on top, ``taken`` off; the columns but these three."""
    for batch in batches:
        k = batch.column("after").to_numpy()
        change = (_lanes(batch.column("added")) + PRIMES[:, None] - _lanes(batch.column("taken"))) % PRIMES[:, None]
        columns = {n: batch.column(n) for n in batch.schema.names if n not in ("added", "taken", "after")}
        if len(k):
            low = _raised(k - 1)
            for name, power in (("name", low * POINTS[:, None] % PRIMES[:, None]), ("parent", low)):
                columns[name] = _names((_lanes(columns[name]) + change * power) % PRIMES[:, None])
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def lifted(rows: DataFrame) -> DataFrame:
    kinds = [f for f in rows.schema.fields if f.name not in ("added", "taken", "after")]
    return rows.mapInArrow(_lift, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds))


def _folded(key, pieces):
    """Where each of a conversation's parts begins and the digest before it; one row for each task that the conversation spans."""
    import pandas as pd

    done, lanes, rows = 0, np.zeros((4, 1), np.uint64), []
    for part, n, name in pieces.sort_values("part")[["part", "n", "name"]].itertuples(index=False):
        rows.append((key[0], part, done, _names(lanes)[0].as_py()))
        lanes = (_lanes(pa.array([name], pa.binary())) + lanes * _raised(np.array([n]))) % PRIMES[:, None]
        done += n
    return pd.DataFrame(rows, columns=["conv_id", "part", "done", "added"])


def placed_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, name, parent, chars) of each turn: its place from 1 on, the digests with and before it, its text's code points.

    Turns are ordered by turn, null first, those of one turn by their SHA-256. Rows are dealt by ranges of all of that, so the
    turns of one conversation may lie in many tasks; what a task lacks is one row for the conversation that began before it.
    """
    turns = unclashed(turns, "conv_id", "turn", "role", "text")
    text = lambda c: F.coalesce(column(turns, c, "string"), F.lit(""))
    mark = F.unhex(F.sha2(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")), 256))
    rows = turns.select(column(turns, "conv_id", "long").alias("conv_id"), column(turns, "turn", "long").alias("turn"), mark.alias("mark"), F.length(text("text")).cast("long").alias("chars")).where("conv_id IS NOT NULL")
    order = ("conv_id", "turn", "mark")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = stored(dealt.mapInArrow(_digest, "conv_id long, part long, place long, name binary, parent binary, chars long"), "trie-turns")
    pieces = local.groupBy("conv_id", "part").agg(F.max("place").alias("n"), F.max_by("name", "place").alias("name"))
    cut = pieces.join(pieces.groupBy("conv_id").agg(F.count("*").alias("k")).where("k > 1").select("conv_id"), "conv_id")
    begun = stored(cut.groupBy("conv_id").applyInPandas(_folded, "conv_id long, part long, done long, added binary").where("done > 0"), "trie-cuts")
    # a task goes on with one conversation at most, so these rows are fewer than tasks
    whole = local.join(F.broadcast(begun), ["conv_id", "part"], "left")
    fits = whole.where("done IS NULL").select("conv_id", "place", "name", "parent", "chars")
    later = whole.where("done IS NOT NULL").select("conv_id", (F.col("place") + F.col("done")).alias("place"), "name", "parent", "chars", "added", F.lit(None).cast("binary").alias("taken"), F.col("place").alias("after"))
    return fits.unionByName(lifted(later))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv_id, n) and (conv_id, depth, name, parent, chars, ends).

    A conversation c takes the first h turns of c - c % 100, h = crc32(c) % 6, in place of its own first h.
    """
    placed = stored(placed_turns(turns), "trie-placed")
    heads = stored(placed.where(F.col("place") <= MOST_SHARED), "trie-heads")
    c = F.col("conv_id")
    counts = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = counts.withColumns({"base": c - c % GROUP, "h": F.crc32(c.cast("string").cast("binary")) % (MOST_SHARED + 1)})
    # a base has two hundred conversations at most and a head five turns: no join here meets a hot key
    bases = counts.where(c % GROUP == 0).select(c.alias("base"), F.col("n").alias("n_base"))
    sized = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    at = lambda conv, place, name: heads.select(F.col("conv_id").alias(conv), F.col("place").alias(place), F.col("name").alias(name))
    known = sized.join(at("base", "m", "added"), ["base", "m"], "left").join(at("conv_id", "h", "taken"), ["conv_id", "h"], "left")
    convs = stored(known.withColumn("total", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-convs")
    shared = convs.where("m > 0").select("conv_id", "base", "m", "total").join(heads.withColumnRenamed("conv_id", "base"), "base").where("place <= m")
    shared = shared.select("conv_id", F.col("place").alias("depth"), "name", "parent", "chars", (F.col("place") == F.col("total")).alias("ends"))
    own = spread_join(placed, convs.select("conv_id", "n", "h", "m", "added", "taken", "total"), ["conv_id"], "n").where("place > h")
    own = own.withColumns({"after": F.col("place") - F.col("h"), "depth": F.col("place") - F.col("h") + F.col("m")})
    own = lifted(own.select("conv_id", "depth", "name", "parent", "chars", (F.col("depth") == F.col("total")).alias("ends"), "added", "taken", "after"))
    return convs.select("conv_id", F.col("total").alias("n")), stored(shared.unionByName(own), "trie-rebuilt")


def _join_ids(batches):
    """Sorted (name, conv_id) as few rows of ids joined by commas, in order within the task."""
    part, name, ids, size, k = TaskContext.get().partitionId(), None, [], 0, 0
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())

    def row():
        return (name, part, k, ",".join(ids))

    for batch in batches:
        out = []
        for x, conv in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (x != name or size > PIECE):
                out.append(row())
                ids, size, k = [], 0, k + 1
            name = x
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if out:
            yield _rows(out, kinds, ("name", "part", "k", "ids"))
    if ids:
        yield _rows([row()], kinds, ("name", "part", "k", "ids"))


def _rows(rows: list[tuple], kinds: tuple, names: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def _hash_ids(batches):
    name, hashed = None, None
    for batch in batches:
        out = []
        for x, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if x != name:
                if hashed:
                    out.append((name, hashed.hexdigest()))
                name, hashed = x, sha256(ids.encode())
            else:
                hashed.update(b"," + ids.encode())
        if out:
            yield _rows(out, (pa.binary(), pa.string()), ("name", "ends_sha256"))
    if hashed:
        yield _rows([(name, hashed.hexdigest())], (pa.binary(), pa.string()), ("name", "ends_sha256"))


def id_hashes(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of (name, conv_id): ids are sorted and joined by ranges, so a node of very many is hashed from few rows, as a stream."""
    pieces = ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(_join_ids, "name binary, part long, k long, ids string")
    return pieces.repartition("name").sortWithinPartitions("name", "part", "k").select("name", "ids").mapInArrow(_hash_ids, "name binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, kids: DataFrame, depth: int) -> DataFrame:
    """(name, more_leaves, more_saved): what the nodes below each node add to it, in log2(depth) rounds.

    ``nodes``: (name, parent, depth, leaf, saved), stored. In round k a node holds the sums of its descendants less than
    2 ** k below and the name of its ancestor 2 ** k above; both double. Nodes that have no such ancestor are done.
    """
    state = nodes.where("depth >= 1").select("name", F.col("parent").alias("above"), "depth", F.col("leaf").alias("leaves"), "saved")
    gains, reach = [], 1
    while reach <= depth:
        gathered = state.groupBy("above").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("fan"))
        there = stored(gathered.join(state.select(F.col("name").alias("above"), F.col("above").alias("further")), "above", "left"), "trie-gains")
        gains.append(there.select(F.col("above").alias("name"), "more_leaves", "more_saved"))
        reach *= 2
        if reach <= depth:
            # a whole row for each node that still points at one: its sums take in what came from below, its pointer jumps
            grown = state.where(F.col("depth") >= reach).join(gains[-1], "name", "left")
            grown = grown.select("name", "above", "depth", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
            jumped = spread_join(stored(grown, "trie-grown"), there.select("above", "further", "fan"), ["above"], "fan")
            state = stored(jumped.select("name", F.col("further").alias("above"), "depth", "leaves", "saved"), "trie-state")
    every = gains[0] if gains else nodes.limit(0).select("name", F.col("leaf").alias("more_leaves"), F.col("saved").alias("more_saved"))
    for g in gains[1:]:
        every = every.unionByName(g)
    return every.groupBy("name").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Null roles and texts are empty; rows without a conv_id belong to no conversation; repeated rows are turns of their own;
    turns of one number are ordered by their SHA-256. Texts of any length travel as a digest and a length, no further than
    the task that reads them. A conversation whose rebuilt form has no turns is a member of the root alone. An empty
    table has no nodes. Other columns play no part, whatever their names.
    """
    convs, rows = rebuilt(turns)
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"))
    grown = rows.groupBy("name").agg(F.any_value("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    nodes = stored(grown.unionByName(root), "trie-nodes")
    kids = stored(nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")).join(nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent"), "trie-kids")
    with_kids = nodes.join(kids.select(F.col("parent").alias("name"), "n_children"), "name", "left")
    whole = stored(with_kids.select(*nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "trie-whole")
    depth = whole.agg(F.max("depth")).first()[0] or 0
    ends = rows.where("ends").select("name", "conv_id").unionByName(convs.where("n = 0").select(F.lit(ROOT).alias("name"), "conv_id"))
    told = whole.join(rolled_up(whole, kids, depth), "name", "left").join(id_hashes(ends), "name", "left")
    told = stored(told, "trie-told")
    named = spread_join(told, kids.select("parent", "parent_conv_id", F.col("n_children").alias("fan")), ["parent"], "fan")
    zero = F.lit(0)
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaf") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )
