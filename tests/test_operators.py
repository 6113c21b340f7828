"""Masking, labels, finalising, validation, encoding, beams, scores, sources and resumption on small relations."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from tamarack.functions import text
from tamarack.operators import beams, encoding, evaluation, finalise, labels, masking, relations, validation
from tamarack.plans import tasks
from tamarack.sources import files, services
from tamarack.streaming import incremental


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def mask(spark, q, a, named, mode="literal", **more):
    pairs = spark.createDataFrame([(1, q, a)], "uid int, q string, a string")
    ids = pairs.select("uid", text.ids_of(F.col("a")).alias("ids"))
    got = masking.masked_pairs(pairs, ids, spark.createDataFrame(list(named.items()), "id string, labels array<string>"), mode, **more).collect()
    return (got[0].q, got[0].a) if got else None


def test_masking(spark):
    assert mask(spark, "Wie is Douglas Adams?", "wd:Q42", {"Q42": ["Adams", "Douglas Adams"]}) == ("Wie is Douglas Q1?", "wd:Q1")
    assert mask(spark, "a b", "wd:Q42 wd:Q421", {"Q42": ["a"], "Q421": ["b"]}) == ("Q1 b".replace("b", "Q2"), "wd:Q1 wd:Q11")
    assert mask(spark, "a b", "wd:Q42 wd:Q421", {"Q42": ["a"], "Q421": ["b"]}, safe_ids=True)[1] == "wd:Q1 wd:Q2"
    assert mask(spark, "x y z", "Q2 Q10 P5", {"Q2": ["x"], "Q10": ["y"], "P5": ["z"]}) == ("Q2 Q1 P1", "Q2 Q1 P1")
    assert mask(spark, "x", "wd:Q1", {"Q1": []}) is None  # an id without labels
    assert mask(spark, "x", "wd:Q1", {"Q1": [""]}) is None  # an empty label matches nothing
    assert mask(spark, "abcd", "Q1 Q2", {"Q1": ["abc"], "Q2": ["cd"]}) is None  # overlap
    assert mask(spark, "abcd", "Q1 Q2", {"Q1": ["ab"], "Q2": ["cd"]}) == ("Q1Q2", "Q1 Q2")
    assert mask(spark, "no ids", "ASK", {}) == ("no ids", "ASK")
    assert mask(spark, None, "ASK", {}) == ("", "ASK")
    assert mask(spark, "f(x) f(x)", "Q1", {"Q1": ["f(x)"]}) == ("Q1 Q1", "Q1")
    assert mask(spark, "fx", "Q1", {"Q1": ["f."]}, "regex") == ("Q1", "Q1")


def test_collision_forms_agree(spark):
    cases = [[(0, 3), (3, 5)], [(0, 3), (4, 5)], [], [(4, 6), (1, 4)], [(1, 9)]]
    flat = spark.createDataFrame([(i, a, b) for i, c in enumerate(cases) for a, b in c], "uid int, start int, end int")
    lists = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "uid int, ms array<struct<start:int,end:int>>")
    assert rows(lists.where(masking.collides(F.col("ms"))).select("uid")) == rows(masking.collisions_by_window(flat)) == [(0,), (3,)]


def test_mask_then_validate(spark):
    pairs = spark.createDataFrame([(1, "Q1 en P1", "wd:Q1 P1"), (2, "Q1 Q2", "Q2 Q1")], "uid int, q string, a string")
    other = pairs.select("uid", *[F.translate(c, "12", "78").alias(c) for c in ("q", "a")])
    report = validation.validate_masking(pairs, other)
    assert validation.verdict(report) and rows(report, "part", "total") == [("answer", 2), ("question", 2)]
    with pytest.raises(Exception, match="one side only"):
        validation.validate_masking(pairs, other.where("uid = 1")).collect()
    texts = pairs.select("uid", F.col("q").alias("question"))
    assert rows(validation.validate_translation(texts.where("uid = 1"), texts)) == [(0, 1, 0.0)]
    with pytest.raises(Exception, match="no reference"):
        validation.validate_translation(texts, texts.where("uid = 1")).collect()


def test_partition_order(spark):
    pairs = spark.createDataFrame([(u, f"q{u}", "a") for u in (1, 2, 10, 20, 100)], "uid int, q string, a string")
    got = finalise.partitioned(pairs, "train", 0.5).orderBy("part", "idx").collect()
    assert [(r.part, r.idx, r.nl) for r in got] == [("train", 0, "q100"), ("train", 1, "q2"), ("train", 2, "q20"), ("validate", 0, "q1"), ("validate", 1, "q10")]
    assert [r.idx for r in finalise.partitioned(pairs, "test", 0.5).orderBy("idx").collect()] == [0, 1, 2, 3, 4]


def test_chunks_and_ranks(spark):
    ids = spark.range(57).select(F.col("id"))
    got = relations.chunked(ids, F.col("id"), 20).groupBy("chunk").count()
    assert rows(got) == [(0, 20), (1, 20), (2, 17)]
    assert rows(relations.chunked(ids.where("id < 0"), F.col("id"), 20)) == []
    with pytest.raises(ValueError):
        relations.chunked(ids, F.col("id"), 0)
    assert rows(relations.ranked(ids, -F.col("id")).where("rank <= 2")) == [(55, 2), (56, 1)]


def test_sets(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "x")], "uid int, v string"), spark.createDataFrame([(2, "y"), (3, "y")], "uid int, v string")
    assert rows(relations.upserted(a, b, "uid")) == [(1, "x"), (2, "y"), (3, "y")]
    assert rows(relations.pending(a, b, "uid")) == [(1,)]
    assert rows(relations.key_differences(a, b, "uid")) == [(1, "left"), (3, "right")]
    with pytest.raises(relations.MissingKeys, match="3"):
        relations.assert_covers(b, a, "uid")
    with pytest.raises(ValueError):
        relations.assert_disjoint(a, b, "uid")
    assert relations.same_rows(a, a) and not relations.same_rows(a, b)


def test_label_requests(spark):
    wanted = spark.createDataFrame([("Q1",), ("P2",)], "id string")

    class Client:
        def __init__(self):
            self.busy = True

        def bindings(self, query):
            if self.busy:
                self.busy = False
                raise services.Busy
            return [("Q1", "b"), ("Q1", "a")] if "wd:Q1 rdfs:label" in query else []

    ids = spark.createDataFrame([(1, ["Q1", "P2"])], "uid int, ids array<string>")
    done = spark.createDataFrame([], "id string, labels array<string>")
    services_sleep = services.patient.__defaults__
    services.patient.__defaults__ = (0.0, lambda _: None)
    try:
        got = tasks.label_ids(ids, done, Client, "nl", 15, 0.0)
        assert rows(got) == [("P2", []), ("Q1", ["b", "a"])]
    finally:
        services.patient.__defaults__ = services_sleep
    body = json.dumps({"results": {"bindings": [{"id": {"value": "Q1"}, "label": {"value": "x"}}]}})
    parsed = labels.parsed_response(spark.createDataFrame([(body,)], "body string"))
    assert rows(labels.from_bindings(wanted, parsed)) == [("P2", []), ("Q1", ["x"])]
    first = spark.createDataFrame([(1, "wd:Q1", 0), (1, "wd:Q9", 1)], "uid int, sparql_wikidata string, at int")
    assert rows(labels.question_ids(first, order=F.col("at"))) == [(1, ["Q1"])]


def test_translation_resumes(spark):
    source = spark.createDataFrame([(u, None, f"a question number {u}", None) for u in (1, 2, 3)], "uid int, paraphrased_question string, question string, NNQT_question string")
    done = spark.createDataFrame([(2, "x")], "uid int, question string")
    got = tasks.translate(source, done, lambda: services.TableTranslator({"a question number 1": "een"}), "nl", 1)
    assert rows(got, "uid", "question") == [(1, "een"), (3, "a question number 3")]


def test_encoding(spark):
    words = spark.createDataFrame([(w, i) for i, w in enumerate("abcd", 4)], "token string, id int")
    points = spark.createDataFrame([(0, "a b c d", "a"), (1, "", "x")], "idx long, nl string, ql string")
    five = {r.idx: (r.ids, r.m) for r in encoding.encoded(points, "nl", words, 5, "ids", "m").collect()}
    assert five[0] == ([1, 4, 5, 6, 2], [1] * 5) and five[1] == ([1, 2, 0, 0, 0], [1, 1, 0, 0, 0])
    eight = encoding.encoded(points, "nl", words, 8, "ids", "m").where("idx = 0").collect()[0]
    assert (eight.ids, eight.m) == ([1, 4, 5, 6, 7, 2, 0, 0], [1] * 6 + [0, 0])
    both = encoding.data_points(points, words, words, 5, 4, "test").where("idx = 0").collect()[0]
    assert both.out_ids == [1, 3, 2, 0]  # the word None is not in the vocabulary
    assert encoding.tensors(encoding.data_points(points, words, words, 5, 4, "test"), "test").columns == ["idx", "inp_ids", "inp_att_mask"]
    assert rows(encoding.batched(points, 1).select("idx", "batch")) == [(0, 0), (1, 1)]


def test_beams(spark):
    steps = [(0, 1, 0, [-1.0, -2.0, -3.0]), (0, 1, 1, [0.0, 0.0, 0.0]), (0, 2, 0, [-1.0, -1.5, -5.0]), (0, 2, 1, [-0.1, -4.0, -4.0])]
    frame = spark.createDataFrame(steps, "seq long, step int, beam int, logprobs array<double>")
    got = beams.decode(frame, 2, 9, 2).orderBy("rank").collect()
    assert [r.tokens for r in got] == [[0, 0], [0, 0]]  # nothing finished: beam 0 first, then again among the others
    first = beams.top_beams(frame.where("step = 1 and beam = 0").withColumn("parent_score", F.lit(0.0)), 2)
    assert rows(first, "rank", "dep_beam", "token") == [(0, 0, 0), (1, 0, 1)]
    words = spark.createDataFrame([("x", 7), ("y", 8)], "token string, id int")
    best = spark.createDataFrame([(0, 0, 0.0, [7, 8, 0, 7])], "seq long, rank int, score double, tokens array<int>")
    assert rows(beams.sentences(best, words)) == [(0, "x y")]


def test_scores(spark):
    pairs = spark.createDataFrame([(0, "a b c d e".split(), ["a b c d e".split()])], "idx long, pred array<string>, refs array<array<string>>")
    assert abs(evaluation.corpus_bleu(pairs).collect()[0][0] - 100) < 1e-9
    none = spark.createDataFrame([(0, ["x"], [["y"]])], "idx long, pred array<string>, refs array<array<string>>")
    assert evaluation.corpus_bleu(none).collect()[0][0] == 0
    best = evaluation.improvements(spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 3.0)], "epoch int, bleu double"))
    assert rows(best, "epoch", "improved") == [(1, True), (2, True), (3, False)]
    joined = evaluation.evaluation_pairs(spark.createDataFrame([(0, "a , b")], "idx long, sentence string"), spark.createDataFrame([(0, " a b ")], "idx long, ql string"))
    assert rows(joined) == [(0, ["a,b"], [["a", "b"]])]


def test_files(spark, tmp_path):
    path = str(tmp_path / "m.json")
    (tmp_path / "m.json").write_text('{"10": "x", "1": "a", "1": "b"}')
    assert rows(files.read_texts(spark, path), "uid", "question") == [(1, "b"), (10, "x")]
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(Exception, match="no JSON object"):
        files.read_map(spark, str(tmp_path / "l.json")).collect()
    with pytest.raises(FileNotFoundError):
        files.read_map(spark, str(tmp_path / "none.json"))
    assert files.read_map(spark, str(tmp_path / "none.json"), missing="none") is None and files.read_texts(spark, str(tmp_path / "none.json")).isEmpty()
    pairs = spark.createDataFrame([(2, "q2", "a2"), (10, "q10", "a10")], "uid int, q string, a string")
    files.write_pairs(pairs, str(tmp_path / "pairs"))
    back = files.read_pairs(spark, str(tmp_path / "pairs"))
    assert rows(back, "pos", "uid", "q", "a") == [(0, 10, "q10", "a10"), (1, 2, "q2", "a2")]
    parts = finalise.partitioned(back, "train", 0.5)
    files.write_parallel(parts, str(tmp_path / "out"), "nl")
    assert rows(files.read_parallel(spark, *files.parallel_paths(str(tmp_path / "out"), "train", "nl")), "idx", "nl", "ql") == [(0, "q2", "a2")]
    old = files.read_map(spark, path)
    assert rows(files.merged(old, old.withColumn("value", F.lit("n")).where("key = '1'"))) == [("1", "n"), ("10", "x")]
    assert rows(files.merged(None, old)) == [("1", "b"), ("10", "x")]
    (tmp_path / "qa.json").write_text(json.dumps([{"uid": 1, "question": [], "template_id": 3, "sparql_wikidata": "wd:Q1"}]))
    q = files.read_questions(spark, str(tmp_path / "qa.json")).collect()[0]
    assert (q.uid, q.question, q.template_id) == (1, None, "3")


def test_translation_is_saved_by_chunk(spark, tmp_path):
    source = spark.createDataFrame([(u, None, f"a question number {u}", None) for u in range(1, 8)], "uid int, paraphrased_question string, question string, NNQT_question string")
    sink = str(tmp_path / "sink")
    assert tasks.translate_into(source.where("uid < 4"), sink, lambda: services.TableTranslator({"a question number 1": "een"}), "nl", 2) == 2
    assert tasks.translate_into(source, sink, lambda: services.TableTranslator({}), "nl", 2) == 2  # four are left
    assert tasks.translate_into(source, sink, lambda: services.TableTranslator({}), "nl", 2) == 0
    assert rows(spark.read.parquet(sink), "uid", "question") == [(1, "een"), *((u, f"a question number {u}") for u in range(2, 8))]


def test_labels_from_an_endpoint(spark, tmp_path):
    asked = []

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(429 if len(asked) == 1 else 200)
            self.end_headers()
            if len(asked) > 1:
                self.wfile.write(json.dumps({"results": {"bindings": [{"id": {"value": "Q1"}, "label": {"value": "een"}}] if "wd%3AQ1+" in self.path else []}}).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address, kept = f"http://127.0.0.1:{server.server_port}/sparql", services.patient.__defaults__
    try:
        with pytest.raises(services.Busy):
            services.SparqlEndpoint(address).bindings("x")
        ids = spark.createDataFrame([(1, ["Q1", "P2"]), (2, ["P2", "Q33"])], "uid int, ids array<string>")
        sink = str(tmp_path / "labels")
        assert tasks.label_into(ids, sink, lambda: services.SparqlEndpoint(address), "nl", 2, 0.0, 1) == 2
        assert rows(spark.read.parquet(sink)) == [("P2", []), ("Q1", ["een"]), ("Q33", [])] and len(asked) == 3
        assert tasks.label_into(ids, sink, lambda: services.SparqlEndpoint(address), "nl", 2, 0.0, 1) == 0
    finally:
        services.patient.__defaults__ = kept
        server.shutdown()


def test_maps_grow(spark, tmp_path):
    path = str(tmp_path / "labels.json")
    new = lambda *of: spark.createDataFrame(list(of), "key string, value array<string>")
    files.append_map(new(("Q1", ["a"]), ("Q2", [])), path)
    files.append_map(new(("Q2", ["b"]), ("Q3", ["c"])), path)
    assert rows(files.read_lists(spark, path, "id", "labels")) == [("Q1", ["a"]), ("Q2", ["b"]), ("Q3", ["c"])]
    assert files.replacements_path("x", "train", "nl") == "x/train-nl-error-replacements.json"
    with pytest.raises(ValueError):
        files.replacements_path("x", "validate", "nl")
    with pytest.raises(Exception, match="(?i)utf"):
        spark.createDataFrame([(bytearray(b"\xff\xfe"),)], "b binary").select(text.decoded(F.col("b"))).collect()


def test_shards_and_loader(spark):
    ids = spark.range(1000).select(F.col("id").alias("idx"))
    by_turns = relations.sharded(ids, F.col("idx"), 3, shuffle=False)
    assert rows(by_turns.groupBy("shard").count()) == [(0, 334), (1, 333), (2, 333)]
    dealt = rows(relations.sharded(ids, F.col("idx"), 4).groupBy("shard").count())
    assert sum(n for _, n in dealt) == 1000 and all(n > 180 for _, n in dealt)
    words = spark.createDataFrame([(w, i) for i, w in enumerate("abcd", 4)], "token string, id int")
    points = spark.createDataFrame([(k, "a b", "c") for k in range(10)], "idx long, nl string, ql string")
    batches = encoding.loaded(points, words, words, 5, 4, "train", 4, seed=1).collect()
    assert sorted(r.batch for r in batches) == [0] * 4 + [1] * 4 + [2] * 2 and {tuple(r.out_ids) for r in batches} == {(1, 6, 2, 0)}
    assert [r.idx for r in sorted(batches, key=lambda r: r.batch)] != list(range(10))


def test_command_line(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"1": "a_b &amp; c"}')
    tasks.main(["replace-special-symbols", "--input", str(tmp_path / "in.json"), "--output", str(tmp_path / "out")], spark)
    assert rows(files.read_texts(spark, str(tmp_path / "out")), "question") == [("a b & c",)]
    with pytest.raises(SystemExit):
        tasks.main(["mask", "--input", "x"], spark)


def test_stages_are_encoded_and_evaluated(spark, tmp_path):
    said = {"train": ["ask where q1 p1 q2", "select var_1 where q1 p2 var_1", "ask where q3 p1 q2"], "test": ["ask where q3 p1 q1", "select var_1 where q9 p2 var_1"]}
    for stage, lines in said.items():
        (tmp_path / f"{stage}-nl.txt").write_text("".join(f"is {x} so ?\n" for x in lines))
        (tmp_path / f"{stage}-sparql.txt").write_text("".join(x + "\n" for x in lines))
    texts, out = str(tmp_path), str(tmp_path / "out")
    lengths = ["--in-length", "12", "--out-length", "9"]
    for stage in ("train", "test"):
        tasks.main(["encode", "--input", texts, "--output", out, "--stage", stage, *lengths], spark)
    words = {r.token: r.id for r in spark.read.parquet(f"{out}/words-ql").collect()}
    assert sorted(words.values()) == list(range(4, 4 + len({w for x in said["train"] for w in x.split()})))
    train, test = (spark.read.parquet(f"{out}/points-{stage}").orderBy("idx").collect() for stage in said)
    assert [r.out_ids for r in train] == [([1, *(words[w] for w in x.split()), 2] + [0] * 9)[:9] for x in said["train"]]
    assert test[0].asDict().keys() == {"idx", "inp_ids", "inp_att_mask"} and 3 in test[1].inp_ids  # a word that training never met
    beams = [(r.idx, 0, r.out_ids) for r in train] + [(r.idx, 1, [1, 2]) for r in train]
    spark.createDataFrame(beams, "seq long, rank int, tokens array<int>").write.parquet(f"{out}/beams")
    tasks.main(["evaluate", "--input", texts, "--other", f"{out}/beams", "--output", out, "--stage", "train"], spark)
    assert [(r.n, round(r.bleu, 6)) for r in spark.read.parquet(f"{out}/score-train").collect()] == [(3, 100.0)]
    assert rows(files.numbered_lines(spark, f"{out}/train-predicted.txt", "line")) == rows(files.numbered_lines(spark, f"{out}/train-ground-truth.txt", "line"))
    # the same beams against other queries: only points that have both are scored, and not all of them well
    score = tasks.evaluate_stage(spark, texts, f"{out}/beams", out, "test", "nl").first()
    assert score.n == 2 and 0 <= score.bleu < 100
    with pytest.raises(SystemExit):
        tasks.main(["evaluate", "--input", texts, "--output", out], spark)


def test_stream_resumes(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "uid int, question string"

    def go():
        incremental.work_through(spark, source, schema, lambda d: d.withColumn("question", F.upper("question")), sink, schema, "uid", state).awaitTermination()

    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(source)
    go()
    spark.createDataFrame([(2, "again"), (3, "c")], schema).write.mode("append").parquet(source)
    go()
    assert rows(spark.read.parquet(sink)) == [(1, "A"), (2, "B"), (3, "C")]
