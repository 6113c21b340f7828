"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Vectors are scaled to length one, where a cosine of 0.9 is a distance of sqrt(0.2). A table's key is the
floor of ``PROJECTIONS`` Gaussian projections over ``WIDTH``, each with its own offset, hashed together;
vectors that share the key of any of ``TABLES`` tables are compared by their cosine in double precision.
A pair at cosine 0.9 shares a key of one table with probability 0.14, of any of 32 with 0.99; one at 0.95
with 0.9998.

Equal vectors collapse to one class. A bucket is compared in blocks of ``BLOCK`` members, so one that
holds a third of all rows is spread over tasks. A block returns counts and a spanning forest, never
pairs; a pair counts only in the first table that brings it together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import kernels
from tamarack.llm.graph import components
from tamarack.llm.shared import column, stored, unclashed

TABLES, PROJECTIONS, WIDTH = 32, 10, 2.0
BLOCK = 1024


def _hashes(dim: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(9 + dim))
    return rng.standard_normal((dim, tables * PROJECTIONS)), rng.random(tables * PROJECTIONS)


def keys_of(unit: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """(vectors, tables) 32-bit keys of vectors of length one."""
    directions, offsets = _hashes(unit.shape[1], tables)
    cells = np.floor(unit @ directions / WIDTH + offsets).astype(np.int64).view(np.uint64).reshape(len(unit), tables, PROJECTIONS)
    out = np.zeros(cells.shape[:2], np.uint64)
    for k in range(PROJECTIONS):
        out = kernels.mix(out ^ (cells[:, :, k] * kernels.MIX[3] + kernels.MIX[4]))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _read(tables: int, single: bool):
    def run(batches):
        for batch in batches:
            lists = batch.column("embedding")
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            flat, at = lists.flatten(), np.concatenate([[0], np.cumsum(np.array(lists.value_lengths().fill_null(0)))])
            gaps = np.array(flat.is_null()) if flat.null_count else None
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            if gaps is not None:
                values = np.where(gaps, np.nan, values)
            widths = np.diff(at)
            n = len(batch)
            good, keys, marks = np.zeros(n, bool), np.zeros((n, tables), np.int32), np.zeros((n, 2), np.uint64)
            for width in np.unique(widths[widths > 0]).tolist():
                rows = np.flatnonzero(widths == width)
                x = values[at[rows][:, None] + np.arange(width)] + 0.0  # -0.0 to 0.0
                with np.errstate(over="ignore", invalid="ignore"):
                    norm = np.linalg.norm(x / np.maximum(np.nanmax(np.abs(x), axis=1, initial=0, keepdims=True), 1e-300), axis=1)
                ok = np.isfinite(x).all(axis=1) & (norm > 0) & np.isfinite(norm)
                rows, x = rows[ok], x[ok]
                if not len(rows):
                    continue
                x /= np.abs(x).max(axis=1, keepdims=True)
                good[rows] = True
                keys[rows] = keys_of(x / np.linalg.norm(x, axis=1, keepdims=True), tables)
                bits = kernels.mix((values[at[rows][:, None] + np.arange(width)] + 0.0).view(np.uint64) + np.arange(1, width + 1, dtype=np.uint64) * kernels.MIX[3])
                marks[rows, 0], marks[rows, 1] = bits.sum(axis=1), np.bitwise_xor.reduce(kernels.mix(bits + kernels.MIX[5]), axis=1)
            flags = pa.array(good)
            key_lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
            marks = marks.view(np.int64)
            clean = pa.array(np.where(np.isfinite(values), values, 0.0).astype(np.float32 if single else np.float64))
            clean = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), clean)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), flags, pa.array(marks[:, 0]), pa.array(marks[:, 1]), key_lists, clean], ["vec_id", "good", "x", "y", "keys", "v"])

    return run


def _compare(threshold: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        t, i, j = (k.as_py() for k in key[:3])
        rep, mine, times = (table[c].to_numpy() for c in ("rep", "own", "times"))
        matrix = lambda c: np.array(table[c].combine_chunks().flatten()).reshape(len(rep), -1)
        lists, keys = matrix("v"), matrix("keys")
        lists = lists.astype(np.float64)
        lists = lists / np.abs(lists).max(axis=1, keepdims=True)
        norm = np.sqrt((lists * lists).sum(axis=1))
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        cos = (lists[left] @ lists[right].T) / norm[left][:, None] / norm[right][None, :]
        a, b = np.nonzero(cos >= threshold)
        a, b = left[a], right[b]
        keep = rep[a] < rep[b] if i == j else rep[a] != rep[b]
        a, b = a[keep], b[keep]
        if t and len(a):
            first = np.ones(len(a), bool)
            for s in range(0, len(a), 1 << 16):
                first[s : s + (1 << 16)] = ~(keys[a[s : s + (1 << 16)], :t] == keys[b[s : s + (1 << 16)], :t]).any(axis=1)
            a, b = a[first], b[first]
        links = np.bincount(a, times[b], len(rep)) + np.bincount(b, times[a], len(rep))
        root, forest = np.arange(len(rep)), []
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            x, y = p, q
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            while root[y] != y:
                root[y] = root[root[y]]
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                forest.append((p, q))
        counted = np.flatnonzero(links)
        f = np.array(forest, np.int64).reshape(-1, 2)
        none = np.zeros(len(f), np.int64)
        return pa.table({
            "a": np.concatenate([rep[counted], rep[f[:, 0]]]),
            "b": pa.array(np.concatenate([rep[counted], rep[f[:, 1]]])),
            "links": np.concatenate([np.rint(links[counted]).astype(np.int64), none]),
        })

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tables: int = TABLES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    n_links counts the other rows linked directly (cosine >= threshold, found through a shared key);
    component_id is the smallest vec_id reachable. A null or zero vector, or one that holds a null or a
    non-finite component, links with nothing, as do vectors of different lengths. Repeated rows are rows
    of their own and link with each other, and a cosine of just the threshold links. A null vec_id has links counted, and a
    null component. Long vectors are read whole; an empty table gives no rows. Extra columns are not read.
    """
    vectors = unclashed(vectors, id_col, vector_col)
    single = vector_col in vectors.columns and vectors.schema[vector_col].dataType.simpleString() == "array<float>"  # travels as such
    plain = vectors.select(column(vectors, id_col, "long").alias("vec_id"), column(vectors, vector_col, "array<double>").alias("embedding"))
    read = stored(plain.mapInArrow(_read(tables, single), f"vec_id long, good boolean, x long, y long, keys array<int>, v array<{'float' if single else 'double'}>"), "vectors")
    mark = ["x", "y"]
    good = read.where("good")
    classes = good.groupBy(*mark).agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("keys").alias("keys"), F.first("v").alias("v"))
    # a class of rows without an id has one of its own below all real ones
    classes = stored(classes.withColumn("rep", F.coalesce("rep", F.lit(-(2**62)) - F.abs(F.xxhash64(*mark) % (2**61)))), "classes")
    spread = classes.select("rep", "times", F.posexplode("keys").alias("t", "key"), F.size("v").alias("dim"))
    crowd = spread.groupBy("t", "key", "dim").agg(F.count("*").alias("m")).where("m > 1").withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int")).drop("m")
    seats = spread.join(crowd, ["t", "key", "dim"]).withColumn("own", F.pmod(F.xxhash64("rep"), "nb").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j")))
    seats = seats.select("rep", "times", "t", "key", "dim", "own", F.explode(meets).alias("at")).select("t", "at.i", "at.j", "key", "dim", "rep", "times", "own")
    full = seats.join(classes.select("rep", "keys", "v"), "rep")
    found = full.groupBy("t", "i", "j", "key", "dim").applyInArrow(_compare(threshold), "a long, b long, links long")
    found = stored(found, "found")
    counts = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    named = classes.select(*mark, "rep", "times").join(counts, "rep", "left").join(groups, "rep", "left")
    # the smallest real id of a component
    component = F.coalesce("component", "rep")
    real = named.select(component.alias("c"), "rep").where(f"rep > {-(2**62)}").groupBy("c").agg(F.min("rep").alias("component_id"))
    named = named.withColumn("c", component).join(real, "c", "left").select(*mark, (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    linked = good.select("vec_id", *mark).join(named, mark).select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = read.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
