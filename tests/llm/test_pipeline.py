import random

import duckdb
import pytest
from tests.llm.helpers import empty, groups, odd_documents, shingles

from tamarack.llm import queries as llm
from tamarack.llm import shared

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "near duplicates":
            sets = {r.doc_id: shingles(r.text, 5) for r in before.collect()}
            root = groups(sets, 80)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i in sets if root[i] == i)
        if name == "personal data":
            assert all(r.n_chars == len(r.text) and "@mail" not in r.text for r in docs.collect())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4]


def test_run(spark, sf):
    packed = pipeline.run(spark, sf).collect()
    assert packed and {"doc_id", "sequence_id", "offset"} <= set(packed[0].asDict())


def test_rules_follow_the_spread_of_the_data(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(3, 8)))
    menu = lambda: " ".join(word() + (" |" if k % 3 == 2 else "") for k in range(90))
    prose = lambda: " ".join(word() for _ in range(90))
    rows = [(i, menu() if i % 12 == 0 else prose(), "en", "s") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in pipeline.quality_rules(spark, docs, "").collect()}
    assert not any(i % 12 == 0 for i in kept) and len(kept) >= 216  # of 220 without marks
    menus = spark.createDataFrame([(i, menu(), "en", "s") for i in range(240)], docs.schema)  # where all hold marks they are no outliers
    assert pipeline.quality_rules(spark, menus, "").count() >= 235


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://there/x"}
    assert shared.shared_dir(Session()) == "hdfs://there/x"


def test_rows_of_one_id_with_other_texts_stay(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(80)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, "c " + b), (1, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, docs, "").collect()) == [(1, a), (1, b)]


def test_odd_documents(spark, sf):
    for given in (odd_documents(spark), empty(odd_documents(spark))):
        for name, stage in pipeline.STAGES:
            got = stage(spark, given, sf)
            rows = got.collect()
            assert name == "packing" or got.columns == given.columns
            assert rows or given.isEmpty()


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = con.execute(llm.oracle_sql()[name])
    names = [x[0] for x in result.description]
    frame = llm.queries()[name](spark, sf)
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in frame.collect()))) == sorted(map(repr, result.fetchall()))
