"""Files read in parts and written in generations, against plain readings of them."""

import json
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamarack.operators import relations
from tamarack.sources import entries, files, versions

SIGNS = ["a", '"', "\\", "{", "}", "[", "]", ",", ":", "é", "\n", " ", "😀", ",,", '\\"']


@pytest.fixture
def small_ranges(spark):
    """Byte ranges so small that entries lie across several of them."""
    keys = {"spark.sql.files.maxPartitionBytes": "3k", "spark.sql.files.openCostInBytes": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def odd_map(n):
    rng = random.Random(3)
    sign = lambda most: "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, most)))
    return {sign(6) + str(k): sign(40 if k % 97 else 9000) for k in range(n)}


@pytest.mark.parametrize("indent", [None, 1])
def test_a_map_is_read_in_ranges(spark, tmp_path, small_ranges, indent):
    whole = odd_map(800)
    path = tmp_path / "m.json"
    path.write_text(json.dumps(whole, indent=indent, ensure_ascii=bool(indent)))
    got = entries.map_entries(spark, str(path), "string")
    assert spark.read.option("lineSep", ",").text(str(path)).rdd.getNumPartitions() > 10
    assert [(r.key, r.value) for r in got.orderBy("pos").collect()] == list(whole.items())
    rows = [{"k": k, "v": [v, None, {"x": 1}]} for k, v in list(whole.items())[:200]]
    path.write_text(json.dumps(rows, indent=indent))
    back = entries.entries(spark, str(path), "[").orderBy("pos").collect()
    assert [json.loads(r.entry) for r in back] == rows


@pytest.mark.parametrize("text", ["[1]", '{"a":1', '"x"', '{"a":"1"}x', '{"a":"b}', '{"a" "1"}', '{"a":"1",}x'])
def test_what_is_no_map_is_an_error(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="no JSON object"):
        entries.map_entries(spark, str(tmp_path / "x.json"), "string").collect()


@pytest.mark.parametrize("text", ["", "{}", " { } \n"])
def test_empty_maps(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    assert entries.map_entries(spark, str(tmp_path / "x.json"), "string").collect() == []


def test_large_maps_take_the_ranges(spark, tmp_path, monkeypatch):
    """Both readings of one file agree, and of a repeated key the last value counts in either."""
    path = tmp_path / "m.json"
    path.write_text('{"10": "x", "1": "a", "2": "c, d", "1": "b"}')
    small = sorted(map(tuple, files.read_map(spark, str(path)).select("key", "value").collect()))
    monkeypatch.setattr(files, "RANGE", 0)
    rows = files.read_map(spark, str(path))
    assert sorted(map(tuple, rows.select("key", "value").collect())) == small == [("1", "b"), ("10", "x"), ("2", "c, d")]
    assert [r.key for r in rows.orderBy("pos").collect()] == ["10", "2", "1"]


def pairs(spark, *of):
    return spark.createDataFrame(list(of), "key string, value string")


def content(spark, path):
    return {r.key: r.value for r in files.read_map(spark, path).collect()}


class Stopped(Exception):
    pass


@pytest.mark.parametrize("step", ["write_parts", "commit", "half a manifest"])
def test_a_writer_that_stops_loses_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "m.json")
    (tmp_path / "m.json").write_text('{"a": "1", "b": "2"}')
    files.append_map(pairs(spark, ("b", "3")), path)
    before = content(spark, path)
    assert before == {"a": "1", "b": "3"} and json.loads((tmp_path / "m.json").read_text()) == {"a": "1", "b": "2"}
    with monkeypatch.context() as m:
        if step == "half a manifest":
            real = versions.commit

            def half(spark, path, parts, after):
                m.setattr(versions, "END", "en")
                real(spark, path, parts, after)
                raise Stopped

            m.setattr(versions, "commit", half)
        else:
            def stop(*_, **__):
                raise Stopped

            m.setattr(versions, step, stop)
        with pytest.raises(Stopped):
            files.append_map(pairs(spark, ("c", "lost")), path)
    assert content(spark, path) == before
    files.append_map(pairs(spark, ("d", "4")), path)
    assert content(spark, path) == {"a": "1", "b": "3", "d": "4"}
    versions.compact(spark, path, "string")
    assert content(spark, path) == {"a": "1", "b": "3", "d": "4"} and len(versions.current(spark, path)) == 1
    files.write_map(pairs(spark, ("z", "9")), "key", F.col("value"), path)
    assert content(spark, path) == {"z": "9"}


def test_two_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "m.json")
    files.append_map(pairs(spark, ("a", "1")), path)
    with pytest.raises(Exception, match="(?i)exist"):
        versions.commit(spark, path, ["elsewhere"], 0)  # as a writer would that read the state before the append
    assert content(spark, path) == {"a": "1"}


def test_lists_grow(spark, tmp_path):
    path = str(tmp_path / "l.json")
    items = spark.range(10).selectExpr("id AS at", "concat('q', id) AS question", "id AS uid")
    versions.append_list(items.where("at < 4"), "at", path)
    versions.append_list(items.where("at >= 4").withColumn("at", -F.col("at")), "at", path)
    got = versions.read_list(spark, path, "uid bigint, question string").orderBy("order").collect()
    assert [r.uid for r in got] == [0, 1, 2, 3, 9, 8, 7, 6, 5, 4]
    with pytest.raises(FileNotFoundError):
        versions.read_list(spark, str(tmp_path / "none"), "uid bigint")


def test_lines_are_numbered_over_parts_and_ranges(spark, tmp_path, small_ranges):
    lines = [f"line {k} " + "x" * (k % 50) if k % 9 else "" for k in range(2000)]
    (tmp_path / "one.txt").write_text("\r\n".join(lines) + "\n")
    got = files.numbered_lines(spark, str(tmp_path / "one.txt"), "t").orderBy("idx").collect()
    assert [(r.idx, r.t) for r in got] == [(k, x.strip()) for k, x in enumerate(lines)]
    frame = spark.createDataFrame([("train", k, x, x[::-1]) for k, x in enumerate(lines)], "part string, idx long, nl string, ql string").repartition(7)
    files.write_parallel(frame, str(tmp_path / "out"), "nl")
    assert len(list((tmp_path / "out" / "train-nl.txt").glob("part-*"))) > 1
    back = files.read_parallel(spark, *files.parallel_paths(str(tmp_path / "out"), "train", "nl")).orderBy("idx").collect()
    assert [(r.idx, r.nl, r.ql) for r in back] == [(k, x.strip(), x[::-1].strip()) for k, x in enumerate(lines)]
    files.write_lines(frame.where("idx < 5"), "idx", F.col("nl"), str(tmp_path / "out" / "train-sparql.txt"))
    with pytest.raises(Exception, match="differ in length"):
        files.read_parallel(spark, *files.parallel_paths(str(tmp_path / "out"), "train", "nl")).collect()


def test_ranks_of_keys_that_begin_alike(spark):
    """Twenty equal characters in front, and one key that a third of all rows have."""
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'entity_of_a_long_name_hot' ELSE concat('entity_of_a_long_name_', id) END AS uid", "id").repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = relations.ranked(rows, F.col("uid"), "rank", "n")
        got = placed.orderBy("rank").collect()
        dealt = rows.withColumn("t", F.spark_partition_id()).repartitionByRange(6, "uid", "t").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [r["rank"] for r in got] == list(range(1, 30_001)) and [r.uid for r in got] == sorted(r.uid for r in got)
    assert {r.n for r in got} == {30_000} and sorted(r.id for r in got) == list(range(30_000))
    assert max(r["count"] for r in dealt) < 8000
    assert "TakeOrderedAndProject" not in placed._jdf.queryExecution().toString()


def test_stretches_are_cut_in_bulk():
    """Entries of a batch come from whole columns, not stretch by stretch."""
    items = [f'{{"uid":{k},"q":"a, b \\" }} c","n":[],"a":{{"x":[{k},2]}}}}' for k in range(60_000)]
    text = "[" + ",".join(items) + "]"
    stretches = [s.encode() for s in text.split(",")]
    n = len(stretches)
    file, block = pa.array(["f"] * n), pa.array(np.zeros(n, np.int64))
    batch = pa.RecordBatch.from_arrays([file, block, pa.array(stretches, pa.binary()), pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, np.int64))], ["file", "block", "text", "inside", "depth"])
    began = time.process_time()
    sums = [r for b in entries._sums(iter([batch])) for r in b.to_pylist()]
    cut = [t for b in entries._cut(iter([batch])) for t in b.column("text").to_pylist()]
    spent = time.process_time() - began
    assert [(r["odd"], r["plain"]) for r in sums] == [(0, 0)]
    assert ",".join(t.decode() for t in cut) == text and [t.decode() for t in cut[1:-1]] == items[1:-1]
    assert spent < 4e-6 * n
