"""Registered queries over the star schema's tables and their DuckDB equivalents.

The question-answer corpus is derived from orders, customers and nations: a question per order, whose query
holds the customer as an entity and the nation as a property. Some ids have no label and some labels
overlap, so every path of the masking is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions import arrays, lcs, text
from tamarack.operators import beams, encoding, epochs, evaluation, finalise, labels, masking, relations, substrings, subwords, validation
from tamarack.plans import tasks
from tamarack.sources import entries, files, services, versions
from tamarack.sources.scratch import scratch, stored
from tamarack.streaming import incremental, paced

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, q, a)."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    q = F.concat(F.lit("Wat is "), "n_name", F.lit(" van "), "c_name", F.lit("?"))
    a = F.concat(F.lit("SELECT ?ans ?ans_1 WHERE { wd:Q"), F.col("c_custkey").cast("string"), F.lit(" wdt:P"), F.col("n_nationkey").cast("string"), F.lit(" ?ans_1 . ?ans_1 wdt:P31 ?ans }"))
    return joined.select(F.col("o_orderkey").alias("uid"), q.alias("q"), a.alias("a"))


def qa_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, labels)."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    q = customer.where("c_custkey % 10 <> 0").select(F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("id"), F.array("c_name").alias("labels"))
    name = F.when(F.col("n_nationkey") % 7 == 0, F.concat(F.lit("is "), "n_name")).otherwise(F.col("n_name"))
    p = nation.where("n_nationkey <> 31").select(F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("id"), F.array(name).alias("labels"))
    own = spark.range(1).select(F.lit("P31").alias("id"), F.array(F.lit("is")).alias("labels"))
    return q.unionByName(p).unionByName(own)


def qa_ids(pairs: DataFrame) -> DataFrame:
    return pairs.select("uid", text.ids_of(F.col("a")).alias("ids"))


QA = """qa AS (SELECT o_orderkey AS uid, 'Wat is ' || n_name || ' van ' || c_name || '?' AS q,
  'SELECT ?ans ?ans_1 WHERE { wd:Q' || c_custkey || ' wdt:P' || n_nationkey || ' ?ans_1 . ?ans_1 wdt:P31 ?ans }' AS a
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
NAMED = """named AS (SELECT 'Q' || c_custkey AS id, c_name AS label FROM customer WHERE c_custkey % 10 <> 0
  UNION ALL SELECT 'P' || n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN 'is ' || n_name ELSE n_name END FROM nation UNION ALL SELECT 'P31', 'is')"""
FLAT = "flat AS (SELECT DISTINCT uid, unnest(regexp_extract_all(a, '[QP][0-9]+')) AS id FROM qa)"
FOUND = f"""WITH {QA}, {NAMED}, {FLAT}, found AS (SELECT flat.uid, flat.id, label, nullif(strpos(q, label), 0) AS s, nullif(strpos(q, label), 0) + length(label) - 1 AS e
  FROM flat JOIN qa USING (uid) LEFT JOIN named USING (id))"""
PAIRS = f"""{FOUND}, collision AS (SELECT DISTINCT uid FROM (SELECT uid, e, lead(s) OVER (PARTITION BY uid ORDER BY s, e) AS n FROM found WHERE s IS NOT NULL) WHERE e >= n),
  kept AS (SELECT uid FROM found GROUP BY uid HAVING bool_and(s IS NOT NULL)), numbered AS (SELECT found.*, left(id, 1) || row_number() OVER (PARTITION BY uid, left(id, 1) ORDER BY id) AS mask FROM found),
  folds AS (SELECT uid, list(label || '|' || mask ORDER BY id) AS ql, list(id || '|' || mask ORDER BY id) AS al FROM numbered WHERE uid IN (SELECT uid FROM kept) AND uid NOT IN (SELECT uid FROM collision) GROUP BY uid),
  pairs AS (SELECT uid, list_reduce(list_concat([q], ql), lambda z, y: replace(z, split_part(y, '|', 1), split_part(y, '|', 2))) AS q,
    list_reduce(list_concat([a], al), lambda z, y: replace(z, split_part(y, '|', 1), split_part(y, '|', 2))) AS a FROM qa JOIN folds USING (uid))"""
FINISHED_Q = "regexp_replace(regexp_replace(regexp_replace(lower(q), '[pq][0-9]+', ' \\0 ', 'g'), '\\?$', ' ?'), ' {2,}', ' ', 'g')"
BARE_A = "regexp_replace(replace(replace(replace(replace(replace(replace(lower(a), '{', ' brack_open '), '}', ' brack_close '), '(', ' attr_open '), ')', ' attr_close '), '.', ' sep_dot '), ',', ' , '), '[a-z]+:([pq][0-9]+)', '\\1', 'g')"
FINISHED_A = f"regexp_replace(regexp_replace(replace(replace({BARE_A}, '?ans', 'var_1'), 'var_1_1', 'var_1_1'), ' {{2,}}', ' ', 'g'), ' +$', '')"
WORDS = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')"


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = qa(spark, sf_dir)
    return masking.masked_pairs(pairs, qa_ids(pairs), qa_labels(spark, sf_dir))


@query(f"{PAIRS} SELECT uid, {FINISHED_Q} AS q, {FINISHED_A} AS a FROM pairs")
def masked_pairs(spark, sf_dir):
    """The flagship: masked, linearised question-answer pairs."""
    return finalise.finished(masked(spark, sf_dir))


@query(f"{PAIRS} SELECT uid, q, a FROM pairs")
def mask_question_answer_pairs(spark, sf_dir):
    return masked(spark, sf_dir)


@query("SELECT page_id, replace(replace(replace(html, '_', ' '), '{', ''), '}', '') AS html FROM pages")
def symbol_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.symbols_replaced(F.col("html")).alias("html"))


def _nested_replace(column: str) -> str:
    for name, char in text.HTML_ENTITIES.items():
        if name not in ("&amp;", "&frac12;"):
            column = f"replace({column}, '{name}', '{char}')"
    return f"replace({column}, '&amp;', '&')"


@query(f"SELECT page_id, {_nested_replace('html')} AS html FROM pages")
def html_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_decoded(F.col("html")).alias("html"))


@query("SELECT item_id, CASE WHEN length(left(text, item_id % 30)) > 15 THEN left(text, item_id % 30) WHEN length(left(text, item_id % 50)) > 20 THEN left(text, item_id % 50) ELSE text END AS question FROM benchmark")
def question_choice(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    part = lambda n: F.expr(f"left(text, cast(item_id % {n} as int))")
    return items.select("item_id", text.chosen_question(part(30), part(50), F.col("text")).alias("question"))


@query("""SELECT uid, CASE WHEN uid % 3 = 0 THEN regexp_replace(regexp_replace('Wie is ERROR' || uid || ' van ' || n_name || ' ?', 'ERROR[0-9]+', n_name, 'g'), ' ?\\?$', '?')
  ELSE 'Wie is ERROR' || uid || ' van ' || n_name || ' ?' END AS question FROM (SELECT n_nationkey AS uid, n_name FROM nation)""")
def error_replace(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("uid"), "n_name")
    texts = nation.select("uid", F.concat(F.lit("Wie is ERROR"), F.col("uid").cast("string"), F.lit(" van "), "n_name", F.lit(" ?")).alias("question"))
    return tasks.replace_errors(texts, nation.where("uid % 3 = 0").select("uid", F.col("n_name").alias("question")))


@query(f"WITH {QA}, {FLAT} SELECT uid, string_agg(id, ',' ORDER BY id) AS ids FROM flat GROUP BY uid")
def extract_ids(spark, sf_dir):
    return qa_ids(qa(spark, sf_dir)).select("uid", F.array_join("ids", ",").alias("ids"))


@query(f"WITH {QA}, {FLAT} SELECT uid, count(*) AS n_ids, string_agg(id, ',' ORDER BY id) AS ids FROM flat GROUP BY uid")
def id_map_round_trip(spark, sf_dir):
    return labels.gathered(labels.exploded(qa_ids(qa(spark, sf_dir)))).select("uid", F.size("ids").cast("long").alias("n_ids"), F.array_join("ids", ",").alias("ids"))


@query(f"WITH {QA}, {FLAT} SELECT DISTINCT id, CASE WHEN left(id, 1) = 'Q' THEN 'entity' ELSE 'property' END AS kind FROM flat")
def distinct_ids(spark, sf_dir):
    return labels.distinct_ids(qa_ids(qa(spark, sf_dir))).select("id", text.id_kind(F.col("id")).alias("kind"))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti(spark, sf_dir):
    return relations.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 15 AS chunk FROM documents")
def chunked(spark, sf_dir):
    return relations.chunked(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 15).select("doc_id", "chunk")


@query(f"WITH {QA}, {NAMED}, {FLAT} SELECT id, coalesce(string_agg(label, ';' ORDER BY label), '') AS labels, count(label) AS n_labels FROM (SELECT DISTINCT id FROM flat) LEFT JOIN named USING (id) GROUP BY id")
def label_group(spark, sf_dir):
    wanted = labels.distinct_ids(qa_ids(qa(spark, sf_dir)))
    bindings = qa_labels(spark, sf_dir).select("id", F.posexplode("labels").alias("pos", "label"))
    found = labels.from_bindings(wanted, bindings)
    return found.select("id", F.array_join("labels", ";").alias("labels"), F.size("labels").cast("long").alias("n_labels"))


@query(f"{FOUND} SELECT uid, id, CASE WHEN s IS NOT NULL THEN label END AS label, s, CASE WHEN s IS NOT NULL THEN e END AS e FROM found")
def label_match(spark, sf_dir):
    pairs = qa(spark, sf_dir)
    flat = labels.with_labels(qa_ids(pairs), qa_labels(spark, sf_dir)).join(pairs, "uid")
    m = masking.best_match(F.col("q"), F.col("labels"))
    return flat.select("uid", "id", m["label"].alias("label"), m["start"].alias("s"), m["end"].alias("e"))


@query(f"{FOUND} SELECT DISTINCT uid FROM (SELECT uid, e, lead(s) OVER (PARTITION BY uid ORDER BY s, e) AS n FROM found WHERE s IS NOT NULL) WHERE e >= n")
def collisions(spark, sf_dir):
    found = label_match(spark, sf_dir).where("s is not null")
    return masking.collisions_by_window(found.select("uid", F.col("s").alias("start"), F.col("e").alias("end")))


@query(f"WITH {QA}, {FLAT} SELECT uid, id, left(id, 1) || row_number() OVER (PARTITION BY uid, left(id, 1) ORDER BY id) AS mask FROM flat")
def mask_numbers(spark, sf_dir):
    flat = labels.exploded(qa_ids(qa(spark, sf_dir)))
    kind = F.substring("id", 1, 1)
    rank = F.row_number().over(Window.partitionBy("uid", kind).orderBy("id"))
    return flat.select("uid", "id", F.concat(kind, rank.cast("string")).alias("mask"))


@query(f"WITH {QA} SELECT uid, {FINISHED_Q} AS q FROM qa")
def finalise_question(spark, sf_dir):
    return qa(spark, sf_dir).select("uid", text.question_finished(F.col("q")).alias("q"))


@query(f"WITH {QA} SELECT uid, {FINISHED_A} AS a FROM qa")
def finalise_answer(spark, sf_dir):
    return qa(spark, sf_dir).select("uid", text.answer_finished(F.col("a")).alias("a"))


@query(f"""WITH {QA}, placed AS (SELECT *, row_number() OVER (ORDER BY CAST(uid AS VARCHAR)) AS r, floor(count(*) OVER () * 0.1) AS m FROM qa)
  SELECT CASE WHEN r <= m THEN 'validate' ELSE 'train' END AS part, CAST(CASE WHEN r <= m THEN r - 1 ELSE r - 1 - m END AS BIGINT) AS idx, q AS nl, a AS ql FROM placed""")
def train_validate_split(spark, sf_dir):
    return finalise.partitioned(qa(spark, sf_dir), "train", 0.1)


@query(f"WITH {QA} SELECT CAST(sum(CASE WHEN uid % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS differences, count(*) AS total, 100 * sum(CASE WHEN uid % 7 = 0 THEN 1 ELSE 0 END) / count(*) AS percentage FROM qa")
def validate_translation(spark, sf_dir):
    reference = qa(spark, sf_dir).select("uid", F.col("q").alias("question"))
    proposal = reference.withColumn("question", F.when(F.col("uid") % 7 == 0, F.concat("question", F.lit("!"))).otherwise(F.col("question")))
    return validation.validate_translation(proposal, reference)


@query(f"""{PAIRS} SELECT part, CAST(sum(d) AS BIGINT) AS differences, count(*) AS total, 100 * sum(d) / count(*) AS percentage FROM (
  SELECT 'question' AS part, 0 AS d FROM pairs UNION ALL SELECT 'answer', CASE WHEN uid % 5 = 0 THEN 1 ELSE 0 END FROM pairs) GROUP BY part""")
def validate_masking(spark, sf_dir):
    """A reference with masks of other numbers is equal up to their names; every fifth answer differs."""
    proposal = stored(masked(spark, sf_dir), "proposal")  # both sides come from it
    other = lambda c: F.regexp_replace(F.regexp_replace(c, "([PQ])1([^0-9]|$)", "$17$2"), "([PQ])2([^0-9]|$)", "$18$2")
    reference = proposal.withColumns({c: other(F.col(c)) for c in ("q", "a")})
    proposal = proposal.withColumn("a", F.when(F.col("uid") % 5 == 0, F.concat("a", F.lit(" x"))).otherwise(F.col("a")))
    return validation.validate_masking(proposal, reference)


@query(f"WITH {QA} SELECT uid, CASE WHEN uid % 4 = 0 THEN 'new' ELSE 'old' END AS side FROM qa WHERE uid % 3 = 0 OR uid % 4 = 0")
def set_ops(spark, sf_dir):
    """Upsert: rows of the new batch replace those of the old one."""
    pairs = qa(spark, sf_dir).select("uid")
    old, new = pairs.where("uid % 3 = 0").withColumn("side", F.lit("old")), pairs.where("uid % 4 = 0").withColumn("side", F.lit("new"))
    return relations.upserted(old, new, "uid")


@query(f"WITH {QA} SELECT uid, CASE WHEN uid % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM qa WHERE (uid % 2 = 0) <> (uid % 3 = 0) AND (uid % 2 = 0 OR uid % 3 = 0)")
def key_differences(spark, sf_dir):
    pairs = qa(spark, sf_dir).select("uid")
    return relations.key_differences(pairs.where("uid % 2 = 0"), pairs.where("uid % 3 = 0"), "uid")


POINTS = "points AS (SELECT conv_id * 100 + turn AS idx, text FROM conversations)"
VOCABULARY = f"vocabulary AS (SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, token) + 3 AS INTEGER) AS id FROM (SELECT unnest({WORDS}) AS token FROM points) GROUP BY token ORDER BY count(*) DESC, token LIMIT 500)"


def _points(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("idx"), "text")


@query(f"""WITH {POINTS}, {VOCABULARY}, flat AS (SELECT idx, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS token FROM (SELECT idx, list_slice({WORDS}, 1, 14) AS t FROM points)),
  whole AS (SELECT idx, list_concat(list_concat([1], list(coalesce(id, 3) ORDER BY pos)), [2]) AS l FROM flat LEFT JOIN vocabulary USING (token) GROUP BY idx)
  SELECT idx, array_to_string(list_concat(l, list_transform(range(16 - len(l)), lambda x: 0)), ',') AS ids, array_to_string(list_concat(list_transform(l, lambda x: 1), list_transform(range(16 - len(l)), lambda x: 0)), ',') AS mask FROM whole""")
def encode_points(spark, sf_dir):
    points = _points(spark, sf_dir)
    out = encoding.encoded(points, "text", encoding.vocabulary(points, "text", 500), 16, "ids", "mask")
    return out.select("idx", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("ids", "mask")])


@query(f"WITH {POINTS} SELECT idx, (row_number() OVER (ORDER BY idx) - 1) // 32 AS batch FROM points")
def minibatch(spark, sf_dir):
    return encoding.batched(_points(spark, sf_dir), 32).select("idx", "batch")


@query(f"WITH {POINTS} SELECT idx FROM points ORDER BY md5(idx || ':7'), idx LIMIT 100")
def sample_hash(spark, sf_dir):
    """A sampling operator: at most 100 points, the same in every run."""
    return relations.sampled(_points(spark, sf_dir), F.col("idx"), 100, seed=7).select("idx")


@query(f"WITH {POINTS} SELECT idx, CAST(CAST('0x' || left(md5(idx || ':3'), 8) AS BIGINT) % 4 AS INTEGER) AS shard FROM points")
def sharded_points(spark, sf_dir):
    """Which of four readers gets each point."""
    return relations.sharded(_points(spark, sf_dir), F.col("idx"), 4, seed=3).select("idx", "shard")


@query(f"WITH {POINTS} SELECT idx, text FROM points ORDER BY idx LIMIT 16")
def first_points(spark, sf_dir):
    """The first points, as a debugging run reads them."""
    return encoding.first_points(_points(spark, sf_dir), 16)


def _halves(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("idx"), F.col("text").alias("nl"), F.col("role").alias("ql"))


def _whole(column: str, most: int) -> str:
    words = WORDS.replace("text", column)
    return f"""{column}_words AS (SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, token) + 3 AS INTEGER) AS id FROM (SELECT unnest({words}) AS token FROM halves) GROUP BY token),
  {column}_flat AS (SELECT idx, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS token FROM (SELECT idx, list_slice({words}, 1, {most - 2}) AS t FROM halves)),
  {column}_whole AS (SELECT idx, list_concat(list_concat([1], list(coalesce(id, 3) ORDER BY pos)), [2]) AS l FROM {column}_flat LEFT JOIN {column}_words USING (token) GROUP BY idx)"""


def _written(lists: str, most: int) -> str:
    return f"array_to_string(list_concat({lists}, list_transform(range({most} - len({lists})), lambda x: 0)), ',')"


_ENCODED = f"""WITH halves AS (SELECT conv_id * 100 + turn AS idx, text AS nl, role AS ql FROM conversations), {_whole('nl', 12)}, {_whole('ql', 4)},
  joined AS (SELECT idx, n.l AS n, q.l AS q FROM nl_whole n JOIN ql_whole q USING (idx))"""


@query(f"{_ENCODED} SELECT idx, {_written('n', 12)} AS inp_ids, {_written('list_transform(n, lambda x: 1)', 12)} AS inp_att_mask, {_written('q', 4)} AS out_ids, {_written('list_transform(q, lambda x: 1)', 4)} AS out_att_mask FROM joined")
def data_points(spark, sf_dir):
    """Both halves of each point with their masks, under vocabularies of all words."""
    halves = _halves(spark, sf_dir)
    words = [encoding.vocabulary(halves, c, None) for c in ("nl", "ql")]
    out = encoding.data_points(halves, *words, 12, 4, "train")
    return out.select("idx", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("inp_ids", "inp_att_mask", "out_ids", "out_att_mask")])


@query(f"{_ENCODED} SELECT idx, (row_number() OVER (ORDER BY idx) - 1) // 16 AS batch, {_written('n', 12)} AS inp_ids, {_written('list_transform(n, lambda x: 1)', 12)} AS inp_att_mask FROM joined")
def loaded_batches(spark, sf_dir):
    """The loader of a stage outside of training: input halves in batches, in order."""
    halves = _halves(spark, sf_dir)
    words = [encoding.vocabulary(halves, c, None) for c in ("nl", "ql")]
    out = encoding.loaded(halves, *words, 12, 4, "validate", 16)
    return out.select("idx", "batch", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("inp_ids", "inp_att_mask")])


def _detok_sql(c: str) -> str:
    c = f"replace(replace(trim({c}), '< ', '<'), ' >', '>')"
    c = f"""regexp_replace({c}, ' ?([!"#$%&''(’)*+,\\-./:;=?@\\\\^_`{{|}}~]) ?', '\\1', 'g')"""
    for old, new in (("attr_close>", "attr_close >"), ("_attr_open", "_ attr_open"), (" [ ", " ["), (" ] ", "] "), ("_obd_", " _obd_ "), ("_oba_", " _oba_ ")):
        c = f"replace({c}, '{old}', '{new}')"
    return c


@query(f"WITH {QA} SELECT uid, {_detok_sql(FINISHED_A)} AS sentence FROM qa")
def eval_detok(spark, sf_dir):
    return qa(spark, sf_dir).select("uid", text.prediction_joined(text.answer_finished(F.col("a"))).alias("sentence"))


def _bleu_pairs(spark, sf_dir):
    """Each turn's text against its predecessor's of the same conversation."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, sf_dir, "conversations").withColumn("before", before).where("before is not null")
    return turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("idx"), text.words_of(F.lower("text")).alias("pred"), F.array(text.words_of(F.lower("before"))).alias("refs"))


@query(f"""WITH pairs AS (SELECT conv_id * 100 + turn AS idx, {WORDS} AS p, {WORDS.replace('text', 'b')} AS r FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL),
  ns AS (SELECT unnest([1, 2, 3, 4]) AS n),
  ours AS (SELECT idx, n, g, count(*) AS c FROM (SELECT idx, n, unnest(list_transform(range(1, len(p) - n + 2), lambda i: array_to_string(list_slice(p, i, i + n - 1), ' '))) AS g FROM pairs, ns) GROUP BY ALL),
  theirs AS (SELECT idx, n, g, count(*) AS rc FROM (SELECT idx, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(list_slice(r, i, i + n - 1), ' '))) AS g FROM pairs, ns) GROUP BY ALL),
  hits AS (SELECT n, sum(least(c, coalesce(rc, 0))) AS hit FROM ours LEFT JOIN theirs USING (idx, n, g) GROUP BY n),
  totals AS (SELECT n, sum(greatest(1, len(p) - n + 1)) AS total FROM pairs, ns GROUP BY n), sizes AS (SELECT sum(len(p)) AS h, sum(len(r)) AS r FROM pairs)
  SELECT round(100 * CASE WHEN h > r THEN 1 ELSE exp(1 - r / h) END * p, 6) AS bleu FROM sizes, (SELECT exp(avg(ln(CASE WHEN hit > 0 THEN hit / total ELSE 2.2250738585072014e-308 END))) AS p FROM totals LEFT JOIN hits USING (n))""")
def corpus_bleu(spark, sf_dir):
    return evaluation.corpus_bleu(_bleu_pairs(spark, sf_dir)).select(F.round("bleu", 6).alias("bleu"))


@query("""WITH l AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS x FROM embeddings), m AS (SELECT *, list_max(x) AS top FROM l),
  s AS (SELECT *, list_transform(x, lambda v: v - top - ln(list_sum(list_transform(x, lambda w: exp(w - top))))) AS lp FROM m)
  SELECT vec_id, round(-(0.9 * lp[vec_id % 64 + 1] + 0.1 / 63 * (list_sum(lp) - lp[vec_id % 64 + 1])), 6) AS loss FROM s""")
def smoothed_loss(spark, sf_dir):
    logits = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    loss = arrays.smoothed_loss(F.col("lp"), (F.col("vec_id") % 64).cast("int"), 0.1)
    return logits.withColumn("lp", arrays.log_softmax(F.col("x"))).select("vec_id", F.round(loss, 6).alias("loss"))


def _beams(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("seq"), F.lit(1).alias("step"), (F.col("vec_id") % 4).cast("int").alias("beam"), F.col("embedding").cast("array<double>").alias("logprobs"))


@query("""WITH f AS (SELECT vec_id // 4 AS seq, CAST(vec_id % 4 AS INTEGER) AS dep_beam, unnest(range(64)) AS token, unnest(embedding)::DOUBLE AS lp FROM embeddings),
  s AS (SELECT *, lp - dep_beam * 0.5 AS score FROM f) SELECT seq, CAST(rank - 1 AS INTEGER) AS rank, dep_beam, CAST(token AS INTEGER) AS token, score
  FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, dep_beam, token) AS rank FROM s) WHERE rank <= 4""")
def beam_topk(spark, sf_dir):
    scores = _beams(spark, sf_dir).withColumn("parent_score", F.col("beam") * -0.5)
    return beams.top_beams(scores, 4).select("seq", "rank", "dep_beam", "token", "score")


def _beam_sql(k: int, end: int) -> str:
    """The whole search in DuckDB: rows of beams instead of lists, a window in each round."""
    return f"""WITH RECURSIVE f AS (SELECT vec_id // 8 AS seq, vec_id // 2 % 4 AS step, vec_id % 2 AS beam, unnest(range(64)) AS tok, unnest(embedding)::DOUBLE AS lp FROM embeddings WHERE vec_id % 2 < {k}),
  steps AS (SELECT seq, step, row_number() OVER (PARTITION BY seq ORDER BY step) AS n FROM (SELECT DISTINCT seq, step FROM f)),
  search AS (SELECT DISTINCT seq, 0::BIGINT AS n, 0::BIGINT AS place, 0::BIGINT AS dep, 1::BIGINT AS token, 0::DOUBLE AS score, 0::BIGINT AS finished, false AS best FROM f
    UNION ALL SELECT seq, n, place, dep, token, score, finished + CAST(sum(CASE WHEN token = {end} THEN 1 ELSE 0 END) OVER (PARTITION BY seq) AS BIGINT), best OR bool_or(place = 0 AND token = {end}) OVER (PARTITION BY seq) FROM (
      SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, dep, token) - 1 AS place FROM (
        SELECT s.seq, t.n, s.place AS dep, f.tok AS token, CASE WHEN s.n > 0 AND s.token = {end} THEN -1e20 ELSE s.score + f.lp END AS score, s.finished, s.best
        FROM search s JOIN steps t ON t.seq = s.seq AND t.n = s.n + 1 JOIN f ON f.seq = t.seq AND f.step = t.step AND f.beam = s.place WHERE NOT (s.best AND s.finished >= {k})) QUALIFY place < {k})),
  chosen AS (SELECT * FROM search WHERE n > 0), ends AS (SELECT seq, max(n) AS last, bool_or(token = {end}) AS any_end FROM chosen GROUP BY seq),
  roles AS (SELECT c.*, 0 AS role FROM chosen c JOIN ends USING (seq) WHERE token = {end} OR (n = last AND place = 0 AND NOT any_end) UNION ALL SELECT c.*, 1 FROM chosen c JOIN ends USING (seq) WHERE n = last AND token <> {end}),
  final AS (SELECT seq, n, place, score, row_number() OVER (PARTITION BY seq ORDER BY role, score DESC, n, place) - 1 AS rank FROM roles QUALIFY rank < {k}),
  path AS (SELECT seq, rank, score, n, place, []::BIGINT[] AS tokens FROM final UNION ALL SELECT p.seq, p.rank, p.score, p.n - 1, c.dep, list_concat([c.token], p.tokens) FROM path p JOIN chosen c ON c.seq = p.seq AND c.n = p.n AND c.place = p.place)
  SELECT seq, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, array_to_string(CASE WHEN list_contains(tokens, {end}) THEN tokens[: list_position(tokens, {end}) - 1] ELSE tokens END, ',') AS tokens FROM path WHERE n = 0"""


def _beam_steps(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(F.floor(F.col("vec_id") / 8).alias("seq"), (F.floor(F.col("vec_id") / 2) % 4).cast("int").alias("step"), (F.col("vec_id") % 2).cast("int").alias("beam"), F.col("embedding").cast("array<double>").alias("logprobs"))


def _beam_rows(found: DataFrame) -> DataFrame:
    return found.select("seq", "rank", F.round("score", 6).alias("score"), F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))


@query(_beam_sql(2, 2))
def beam_search(spark, sf_dir):
    """Four steps of two beams for each group of eight vectors, taken as log probabilities, with an end token."""
    return _beam_rows(beams.decode(_beam_steps(spark, sf_dir), 2, 1, 2))


@query(_beam_sql(2, 7))
def beam_search_greedy_ends(spark, sf_dir):
    """The same with another end token, whose searches stop at other steps."""
    return _beam_rows(beams.decode(_beam_steps(spark, sf_dir), 2, 1, 7))


SUBSTRINGS = "list_distinct(flatten(list_transform(range(1, length({c}) + 1), lambda i: list_transform(range(1, length({c}) - i + 2), lambda k: substr({c}, i, k)))))"


@query(f"""WITH s AS (SELECT n_name, r_name, unnest(list_intersect({SUBSTRINGS.format(c='n_name')}, {SUBSTRINGS.format(c='r_name')})) AS x FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT n_name, r_name, first(x ORDER BY length(x) DESC, x) AS common FROM s GROUP BY n_name, r_name""")
def longest_common(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return joined.select("n_name", "r_name", text.longest_common_substring(F.col("n_name"), F.col("r_name")).alias("common")).where("common is not null")


@query(f"""WITH s AS (SELECT p_partkey, unnest(list_intersect({SUBSTRINGS.format(c='a')}, {SUBSTRINGS.format(c='b')})) AS x FROM (SELECT p_partkey, p_name AS a, lower(p_type) || ' ' || p_brand AS b FROM part))
  SELECT p_partkey, first(x ORDER BY length(x) DESC, x) AS common FROM s GROUP BY p_partkey""")
def longest_common_long(spark, sf_dir):
    """What a part's name shares with its type and brand, by the function for long texts."""
    other = F.concat(F.lower("p_type"), F.lit(" "), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", lcs.longest_common()(F.col("p_name"), other).alias("common")).where("common is not null")


@query(f"WITH {QA} SELECT uid, url_encode(q) AS q FROM qa")
def url_encode(spark, sf_dir):
    return qa(spark, sf_dir).select("uid", text.url_encoded(F.col("q")).alias("q"))


_ONE = """'\t\tSELECT DISTINCT ?id ?label WHERE {' || chr(10) || '\t\t\tBIND("' || id || '" AS ?id) .' || chr(10) || '\t\t\t{' || chr(10) || '\t\t\t\twd:' || id || ' rdfs:label ?label .' || chr(10) || '\t\t\t} UNION {' || chr(10)
  || '\t\t\t\twd:' || id || ' skos:altLabel ?label .' || chr(10) || '\t\t\t}' || chr(10) || '\t\t\tFILTER(LANG(?label) = "nl") .' || chr(10) || '\t\t}' || chr(10)"""


@query(f"""WITH {QA}, {FLAT}, ids AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 15 AS chunk FROM (SELECT DISTINCT id FROM flat))
  SELECT chunk, 'SELECT ?id ?label WHERE {{' || chr(10) || string_agg('\t{{' || chr(10) || {_ONE} || '\t}}' || chr(10), '\tUNION' || chr(10) ORDER BY id) || '}}' AS query FROM ids GROUP BY chunk""")
def sparql_text(spark, sf_dir):
    ids = labels.distinct_ids(qa_ids(qa(spark, sf_dir)))
    return labels.labelling_queries(relations.chunked(ids, F.col("id"), 15), "nl")


@query(f"WITH {QA}, {NAMED} SELECT DISTINCT id, label FROM (SELECT DISTINCT unnest(regexp_extract_all(a, '[QP][0-9]+')) AS id FROM qa) JOIN named USING (id)")
def local_labels(spark, sf_dir):
    """What the labelling query asks for, over local tables: two sources, one language, distinct."""
    named = qa_labels(spark, sf_dir).select("id", F.explode("labels").alias("label"))
    both = [named.withColumn("lang", F.lit(x)) for x in ("nl", "en")]
    return labels.local_lookup(labels.distinct_ids(qa_ids(qa(spark, sf_dir))), both[0].unionByName(both[1]), both[0], "nl")


@query("SELECT user_id, event_id, value, round(sum(value) OVER w, 4) AS loss_sum, round(avg(value) OVER w, 11) AS loss_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_loss(spark, sf_dir):
    losses = table(spark, sf_dir, "events").select(F.col("user_id").alias("epoch"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    out = evaluation.running_loss(losses, digits=11)
    return out.select(F.col("epoch").alias("user_id"), F.col("step").alias("event_id"), F.col("loss").alias("value"), F.round("loss_sum", 4).alias("loss_sum"), "loss_mean")


@query("SELECT event_id, CASE WHEN event_id < 100 THEN event_id / 100 ELSE greatest(0.0, (1000 - event_id) / 900) END AS factor FROM events")
def learning_rate(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", arrays.schedule(F.col("event_id"), 1000).alias("factor"))


QA_GAPS = QA.replace("'Wat is ' || n_name || ' van ' || c_name || '?' AS q", "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Wat is ' || n_name || ' van ' || c_name || '?' END AS q")


@query(f"{PAIRS.replace(QA, QA_GAPS)} SELECT uid, q, a FROM pairs")
def mask_task(spark, sf_dir):
    """The whole masking task; a quarter of the questions have no translation and so no label in them."""
    pairs = qa(spark, sf_dir)
    source = pairs.select("uid", F.col("a").alias("sparql_wikidata"))
    translations = pairs.where("uid % 4 <> 0").select("uid", F.col("q").alias("question"))
    return masking.mask_task(source, translations, qa_ids(pairs), qa_labels(spark, sf_dir))


@query(f"{PAIRS} SELECT uid, q, a FROM pairs")
def mask_by_pattern(spark, sf_dir):
    """Labels read as patterns; these hold no signs, so the result is that of the literal ones."""
    pairs = qa(spark, sf_dir)
    return masking.masked_pairs(pairs, qa_ids(pairs), qa_labels(spark, sf_dir), mode="regex")


@query(f"WITH {QA} SELECT uid % 500 AS uid, array_to_string(list_sort(list_distinct(regexp_extract_all(arg_min(a, uid), '[QP][0-9]+'))), ',') AS ids FROM qa GROUP BY uid % 500")
def question_ids(spark, sf_dir):
    """The id map of a split whose uids repeat: the first row of each counts."""
    source = qa(spark, sf_dir).select((F.col("uid") % 500).alias("uid"), F.col("a").alias("sparql_wikidata"), F.col("uid").alias("at"))
    return labels.question_ids(source, order=F.col("at")).select("uid", F.array_join("ids", ",").alias("ids"))


@query(f"WITH {QA}, {FLAT} SELECT DISTINCT id FROM flat WHERE id NOT IN (SELECT 'Q' || c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def unlabelled_ids(spark, sf_dir):
    """Ids still to be labelled where half of the entities have been."""
    done = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("id"))
    return relations.pending(labels.distinct_ids(qa_ids(qa(spark, sf_dir))), done, "id")


@query("SELECT n_nationkey AS uid, chr(65 + n_nationkey) || ' ' || replace(n_name, '_', ' ') || ' &quot; < é &Eacute; &#99999; &' AS question FROM nation")
def special_symbols(spark, sf_dir):
    """Symbols first, then named and numeric references, the ampersand last."""
    marked = F.concat(F.lit("&#"), (F.col("n_nationkey") + 65).cast("string"), F.lit(";_{"), "n_name", F.lit("} &amp;quot; &lt; &#233; &Eacute; &#99999; &#38;"))
    return tasks.replace_special_symbols(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("uid"), marked.alias("question")))


@query(f"""WITH {QA}, placed AS (SELECT *, row_number() OVER (ORDER BY CAST(uid AS VARCHAR)) AS r, floor(count(*) OVER () * 0.25) AS m FROM qa)
  SELECT CASE WHEN r <= m THEN 'validate' ELSE 'train' END AS part, CAST(CASE WHEN r <= m THEN r - 1 ELSE r - 1 - m END AS BIGINT) AS idx, {FINISHED_Q} AS nl, {FINISHED_A} AS ql FROM placed""")
def finalise_dataset(spark, sf_dir):
    """The whole finalising task: both texts finished, then split."""
    return tasks.finalise_dataset(qa(spark, sf_dir), "train", 0.25)


@query("""WITH f AS (SELECT vec_id // 4 AS seq, vec_id // 2 % 2 AS step, vec_id % 2 AS beam, unnest(range(64)) AS token, unnest(embedding)::DOUBLE AS lp FROM embeddings),
  one AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY lp DESC, token) - 1 AS rank FROM f WHERE step = 0 AND beam = 0 QUALIFY rank < 2),
  two AS (SELECT one.seq, one.token AS first, f.token AS second, one.lp + f.lp AS score, row_number() OVER (PARTITION BY one.seq ORDER BY one.lp + f.lp DESC, f.beam, f.token) AS place FROM one JOIN f ON f.seq = one.seq AND f.step = 1 AND f.beam = one.rank)
  SELECT seq, CAST(k AS INTEGER) AS rank, round(score, 6) AS score, first || ',' || second AS tokens FROM two, (SELECT unnest([0, 1]) AS k) WHERE place = 1""")
def beam_two_steps(spark, sf_dir):
    """Two steps of two beams without an end: the first beam stands for the finished ones that are missing, then again for itself."""
    vectors = table(spark, sf_dir, "embeddings")
    steps = vectors.select(F.floor(F.col("vec_id") / 4).alias("seq"), (F.floor(F.col("vec_id") / 2) % 2).cast("int").alias("step"), (F.col("vec_id") % 2).cast("int").alias("beam"), F.col("embedding").cast("array<double>").alias("logprobs"))
    # a sequence that ends before its second step, as the last of a table may, has no row
    return _beam_rows(beams.decode(steps, 2, 1, 999).where(F.size("tokens") == 2))


@query("SELECT n_nationkey AS epoch, n_nationkey * 37 % 11 / 10 AS bleu, max(n_nationkey * 37 % 11 / 10) OVER w AS best_before, coalesce(n_nationkey * 37 % 11 / 10 > max(n_nationkey * 37 % 11 / 10) OVER w, true) AS improved FROM nation WINDOW w AS (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def improvements(spark, sf_dir):
    return evaluation.improvements(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("epoch"), (F.col("n_nationkey") * 37 % 11 / 10).alias("bleu")))


@query(r"""SELECT p_partkey, NOT regexp_matches(n, 'bias|LayerNorm\.weight') AS decays, starts_with(n, 'random-') AS random, regexp_matches(['P1', 'x2', 'Q33'][p_size % 3 + 1], '^[PQ][0-9]+$') AS mask, array_to_string([regexp_extract('1' || p_size || '.' || p_size || '.3', '^(\d+)\.(\d+)', 1), regexp_extract('1' || p_size || '.' || p_size || '.3', '^(\d+)\.(\d+)', 2)], '.') AS version,
  CASE WHEN p_size % 2 = 0 THEN 'character' ELSE 'numeric' END AS entity FROM (SELECT *, ['random-', 'dense.', 'LayerNorm.'][p_size % 3 + 1] || ['bias', 'weight'][p_size % 2 + 1] AS n FROM part)""")
def predicates(spark, sf_dir):
    """Which parameters decay, random models, mask symbols, versions and kinds of references."""
    item = lambda *of: F.element_at(F.array(*map(F.lit, of)), (F.col("p_size") % len(of) + 1).cast("int"))
    parts = table(spark, sf_dir, "part").withColumn("n", F.concat(item("random-", "dense.", "LayerNorm."), item("bias", "weight")))
    size = F.col("p_size").cast("string")
    version = F.array_join(text.major_minor(F.concat(F.lit("1"), size, F.lit("."), size, F.lit(".3"))).cast("array<string>"), ".")
    return parts.select("p_partkey", arrays.decays(F.col("n")).alias("decays"), arrays.is_random_model(F.col("n")).alias("random"), text.is_mask_symbol(item("P1", "x2", "Q33")).alias("mask"), version.alias("version"), text.entity_kind(item("&lt;", "&#60;")).alias("entity"))


@query(r"""SELECT p_partkey, regexp_replace(p_name || '(a.b)*$', '([.()\[\]|{}*+\-?^$/\\])', '\\\1', 'g') AS escaped, nullif(strpos(p_name, 'e'), 0) AS starts, nullif(strpos(p_name, 'e'), 0) AS ends,
  CASE WHEN strpos(p_name, 'e') > 0 THEN left(p_name, strpos(p_name, 'e') - 1) || '<>' || substr(p_name, strpos(p_name, 'e') + 1) ELSE p_name END AS replaced,
  array_to_string(list_sort(list_distinct(string_split(p_name, ''))), '') AS points, decode(encode(p_name)) AS decoded FROM part""")
def text_tools(spark, sf_dir):
    """Escaping, the first occurrence and its replacement, distinct characters, decoding."""
    name = F.col("p_name")
    bounds = text.first_bounds(name, F.lit("e"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.regex_escaped(F.concat(name, F.lit("(a.b)*$"))).alias("escaped"), bounds["start"].alias("starts"), bounds["end"].alias("ends"),
        text.first_replaced(name, F.lit("e"), F.lit("<>")).alias("replaced"), F.array_join(text.unique_code_points(name), "").alias("points"), text.decoded(F.encode(name, "UTF-8")).alias("decoded"),
    )


_LIST = "list_transform(range(1, 9), lambda i: (doc_id * i) % 5)"


@query(f"""SELECT doc_id, array_to_string(CASE WHEN list_position(l, 0) > 0 THEN list_slice(l, 1, list_position(l, 0) - 1) ELSE l END, ',') AS before, array_to_string(list_filter(l, lambda x, i: i = list_position(l, x)), ',') AS distinct_,
  array_to_string(list_reverse(l), ',') AS turned, CAST(len(list_filter(l[1:7], lambda x, i: l[i + 1] <> 0)) AS BIGINT) AS length, round(list_sum(list_concat([0.0], list_transform(list_filter(l[1:7], lambda x, i: l[i + 1] <> 0), lambda x: x / 4.0))), 6) AS loss FROM (SELECT doc_id, {_LIST} AS l FROM documents)""")
def list_tools(spark, sf_dir):
    """Cutting at the first 0, distinct items in order, reversal, active tokens and their summed loss."""
    l = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.col("doc_id") * i % 5)  # noqa: E741
    rows = table(spark, sf_dir, "documents").select("doc_id", l.alias("l"))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    scaled = arrays.scaled_loss(F.transform(F.slice("l", 1, 7), lambda x: x / 4.0), F.col("l"))
    return rows.select("doc_id", joined(arrays.before(F.col("l"), 0)).alias("before"), joined(arrays.unique(F.col("l"))).alias("distinct_"), joined(F.reverse("l")).alias("turned"), scaled["length"].cast("long").alias("length"), F.round(scaled["loss"], 6).alias("loss"))


@query("SELECT vec_id, round(list_sum([tanh(x::DOUBLE) for x in embedding]), 6) AS total, array_to_string(flatten(list_transform(range(4), lambda i: list_transform(range(4), lambda j: CASE WHEN j <= i THEN 1 ELSE 0 END))), '') AS mask FROM embeddings")
def activations(spark, sf_dir):
    """Hyperbolic tangents and the mask of places that a token may see."""
    values = arrays.activated(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.array_join(F.flatten(arrays.causal_mask(4)).cast("array<string>"), "").alias("mask"))


@query(f"""WITH {QA}, l AS (SELECT row_number() OVER (ORDER BY uid) - 1 AS idx, q FROM qa), r AS (SELECT row_number() OVER (ORDER BY uid) - 1 AS idx, a FROM qa) SELECT idx, q, a FROM l JOIN r USING (idx)""")
def zipped_lines(spark, sf_dir):
    """Two files' lines side by side by their places."""
    pairs = qa(spark, sf_dir)
    side = lambda c: relations.ranked(pairs.select("uid", c), F.col("uid")).select((F.col("rank") - 1).alias("idx"), c)
    return relations.zipped(side("q"), side("a"))


@query(f"""WITH {QA}, todo AS (SELECT uid, CASE WHEN length(q) > 15 THEN q ELSE 'template of ' || uid END AS question FROM qa WHERE uid % 5 <> 0)
  SELECT uid, question, (row_number() OVER (ORDER BY uid) - 1) // 100 AS chunk FROM todo""")
def translate_task(spark, sf_dir):
    """Questions not yet translated, by a translator that knows none of them, with their chunks."""
    pairs = qa(spark, sf_dir)
    source = pairs.select("uid", F.col("q").alias("question"), F.lit(None).cast("string").alias("paraphrased_question"), F.concat(F.lit("template of "), F.col("uid").cast("string")).alias("NNQT_question"))
    done = pairs.where("uid % 5 = 0").select("uid", F.col("q").alias("question"))
    return tasks.translate(source, done, lambda: services.TableTranslator({}), "nl", 100)


_EVALUATED = f"""{_detok_sql(FINISHED_A)}"""


def _epoch_sql(third: int) -> str:
    """(n, bleu) where every answer whose uid ``third`` divides has two words too many."""
    return f"""WITH {QA}, s AS (SELECT uid, {_EVALUATED} AS t FROM qa), w AS (SELECT uid, string_split_regex(CASE WHEN uid % {third} = 0 THEN t || ' extra word' ELSE t END, '\\s+') AS p, string_split_regex(t, '\\s+') AS r FROM s),
  ns AS (SELECT unnest([1, 2, 3, 4]) AS n),
  ours AS (SELECT uid, n, g, count(*) AS c FROM (SELECT uid, n, unnest(list_transform(range(1, len(p) - n + 2), lambda i: array_to_string(list_slice(p, i, i + n - 1), ' '))) AS g FROM w, ns) GROUP BY ALL),
  theirs AS (SELECT uid, n, g, count(*) AS rc FROM (SELECT uid, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(list_slice(r, i, i + n - 1), ' '))) AS g FROM w, ns) GROUP BY ALL),
  hits AS (SELECT n, sum(least(c, rc)) AS hit FROM ours JOIN theirs USING (uid, n, g) GROUP BY n),
  totals AS (SELECT n, sum(greatest(1, len(p) - n + 1)) AS total FROM w, ns GROUP BY n), sizes AS (SELECT sum(len(p)) AS h, sum(len(r)) AS r FROM w)
  SELECT count AS n, round(100 * CASE WHEN h > r THEN 1 ELSE exp(1 - r / h) END * p, 6) AS bleu FROM sizes, (SELECT exp(avg(ln(hit / total))) AS p FROM totals JOIN hits USING (n)), (SELECT count(*) AS count FROM w)"""


@query(_epoch_sql(3))
def evaluation_epoch(spark, sf_dir):
    """An epoch from best beams to its score: beams become sentences, meet the truth, and are compared."""
    sentences = qa(spark, sf_dir).select(F.col("uid").alias("idx"), text.prediction_joined(text.answer_finished(F.col("a"))).alias("t"))
    sentences = stored(sentences, "sentences")  # its patterns are matched once, not for each of its three uses
    number = lambda token: F.abs(F.xxhash64(token)) + 1
    extra = F.when(F.col("idx") % 3 == 0, F.array(F.lit("extra"), F.lit("word"))).otherwise(F.array().cast("array<string>"))
    words = sentences.select(F.explode(F.concat(text.words_of(F.col("t")), F.array(F.lit("extra"), F.lit("word")))).alias("token")).distinct().select("token", number("token").alias("id"))
    best = sentences.select(F.col("idx").alias("seq"), F.lit(0).alias("rank"), F.transform(F.concat(text.words_of(F.col("t")), extra), number).alias("tokens"))
    return evaluation.epoch(best, words, sentences.select("idx", F.col("t").alias("ql"))).select("n", F.round("bleu", 6).alias("bleu"))


@query(f"""WITH {QA}, f AS (SELECT uid, q, a FROM qa) SELECT CAST(uid AS VARCHAR) AS uid, q, a FROM f""")
def pair_files(spark, sf_dir):
    """Masked-pair files: an object from each task, read back entry by entry from byte ranges."""
    folder = scratch(spark, "pairs")
    versions.write_parts(qa(spark, sf_dir), "uid", F.struct("q", "a"), folder)
    return entries.map_entries(spark, folder, "struct<q:string,a:string>").select(F.col("key").alias("uid"), "value.q", "value.a")


@query(f"""WITH {QA}, {FLAT}, ids AS (SELECT uid, string_agg(id, ',' ORDER BY id) AS ids FROM flat GROUP BY uid)
  SELECT CAST(uid AS VARCHAR) AS uid, CASE WHEN uid % 6 = 0 THEN 'none' ELSE ids END AS ids FROM ids""")
def grown_map(spark, sf_dir):
    """An id map written, then added to: even uids first, then the others and every third of the even ones anew."""
    ids, path = qa_ids(qa(spark, sf_dir)).select(F.col("uid").cast("string").alias("key"), F.col("ids").alias("value"), "uid"), scratch(spark, "map")
    files.append_map(ids.where("uid % 2 = 0").select("key", "value"), path)
    again = F.when(F.col("uid") % 6 == 0, F.array(F.lit("none"))).otherwise(F.col("value"))
    files.append_map(ids.where("uid % 2 = 1 OR uid % 6 = 0").select("key", again.alias("value")), path)
    return versions.read_map(spark, path, "array<string>").select(F.col("key").alias("uid"), F.array_join("value", ",").alias("ids"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey, half) - 1 AS place, o_orderkey AS uid, o_orderpriority AS question FROM orders, (SELECT unnest([0, 1]) AS half) WHERE half = o_orderkey % 2 AND half = 0 UNION ALL SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) + row_number() OVER (ORDER BY o_orderkey) - 1, o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1")
def grown_list(spark, sf_dir):
    """A question array written and added to: even keys, then odd ones, read back in order."""
    path, orders = scratch(spark, "list"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("question"), F.col("o_orderkey").alias("at"))
    for half in (0, 1):
        versions.append_list(orders.where(F.col("at") % 2 == half), "at", path)
    rows = versions.read_list(spark, path, "uid bigint, question string")
    return relations.ranked(rows, F.col("order"), "rank").select((F.col("rank") - 1).alias("place"), "uid", "question")


@query(f"""WITH {QA}, placed AS (SELECT *, row_number() OVER (ORDER BY CAST(uid AS VARCHAR)) AS r, floor(count(*) OVER () * 0.1) AS m FROM qa)
  SELECT CAST(r - 1 - m AS BIGINT) AS idx, q AS nl, a AS ql FROM placed WHERE r > m""")
def parallel_files(spark, sf_dir):
    """The train part as two line-aligned files of many parts, read back by their lines' numbers."""
    folder = scratch(spark, "parallel")
    files.write_parallel(finalise.partitioned(qa(spark, sf_dir), "train", 0.1), folder, "nl")
    return files.read_parallel(spark, *files.parallel_paths(folder, "train", "nl"))


@query()
def benchmark_overlap(spark, sf_dir):
    """Of each document the longest passage that any benchmark item holds too, letter by letter."""
    left = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    right = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("id"), "text")
    return substrings.longest_with_any(left, right).select(F.col("id").alias("doc_id"), "length", "common")


@query(f"""WITH ours AS (SELECT p_partkey, unnest({SUBSTRINGS.format(c='p_name')}) AS x FROM part), theirs AS (SELECT DISTINCT unnest({SUBSTRINGS.format(c='t')}) AS x FROM (SELECT DISTINCT lower(p_type) || ' ' || p_brand AS t FROM part))
  SELECT p_partkey, first(CAST(length(x) AS BIGINT) ORDER BY length(x) DESC, x) AS length, first(x ORDER BY length(x) DESC, x) AS common FROM ours JOIN theirs USING (x) GROUP BY p_partkey""")
def longest_common_any(spark, sf_dir):
    """What a part's name shares at most with any part's type and brand."""
    part = table(spark, sf_dir, "part")
    kinds = part.select(F.concat(F.lower("p_type"), F.lit(" "), F.col("p_brand")).alias("text")).distinct().withColumn("id", F.xxhash64("text"))
    found = substrings.longest_with_any(part.select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("text")), kinds)
    return found.select(F.col("id").alias("p_partkey"), "length", "common")


def _whole_pieces(most: int) -> str:
    return f"""counts AS (SELECT token AS word, count(*) AS n FROM (SELECT unnest({WORDS}) AS token FROM points) GROUP BY token),
  common AS (SELECT 0 AS kind, -n AS o, word AS piece FROM counts WHERE length(word) BETWEEN 2 AND 32 ORDER BY n DESC, word LIMIT {most}),
  letters AS (SELECT DISTINCT 1 AS kind, 0 AS o, unnest(string_split(word, '')) AS piece FROM counts),
  pieces AS (SELECT piece, begins, row_number() OVER (ORDER BY kind, o, piece, NOT begins) + 3 AS id FROM (SELECT * FROM common UNION ALL SELECT * FROM letters WHERE piece <> ''), (SELECT unnest([true, false]) AS begins))"""


@query(f"""WITH RECURSIVE {POINTS}, {_whole_pieces(300)}, front AS (SELECT idx, list_slice({WORDS}, 1, 14) AS w FROM points), flat AS (SELECT idx, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM front),
  walk AS (SELECT DISTINCT word, 0::BIGINT AS place, []::BIGINT[] AS ids FROM flat
    UNION ALL SELECT word, place + length(piece), list_concat(ids, [id]) FROM (SELECT w.*, piece, id FROM walk w JOIN pieces p ON p.begins = (w.place = 0) AND substr(w.word, w.place + 1, length(p.piece)) = p.piece WHERE w.place < length(w.word)) QUALIFY row_number() OVER (PARTITION BY word ORDER BY length(piece) DESC) = 1),
  whole AS (SELECT idx, list_concat(list_concat([1], list_slice(flatten(list(ids ORDER BY pos)), 1, 14)), [2]) AS l FROM flat JOIN walk USING (word) WHERE place = length(word) GROUP BY idx)
  SELECT idx, array_to_string(list_concat(l, list_transform(range(16 - len(l)), lambda x: 0)), ',') AS ids, CAST(len(l) AS BIGINT) AS used FROM whole""")
def encode_pieces(spark, sf_dir):
    """Subword ids: common words and single characters, the longest that fits first."""
    points = _points(spark, sf_dir)
    out = subwords.encoded(points, "text", subwords.pieces(points, "text", 300), 16)
    return out.select("idx", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("used"))


@query(f"WITH scored AS ({' UNION ALL '.join(f'SELECT {e} AS epoch, * FROM ({_epoch_sql(k)})' for e, k in enumerate((3, 2, 5)))}) SELECT CAST(epoch AS BIGINT) AS epoch, n, bleu, max(bleu) OVER w AS best_before, coalesce(bleu > max(bleu) OVER w, true) AS improved FROM scored WINDOW w AS (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def training_epochs(spark, sf_dir):
    """Three epochs whose predictions go wrong for every third, second and fifth pair; the run is broken off after the second and goes on."""
    folder = scratch(spark, "training")
    truth = qa(spark, sf_dir).select(F.col("uid").alias("idx"), text.prediction_joined(text.answer_finished(F.col("a"))).alias("t"))
    truth = stored(truth.select("idx", text.words_of(F.col("t")).alias("words")), "truth")
    wrong = (3, 2, 5)
    state = lambda e: truth.select("idx", F.when(F.col("idx") % wrong[e] == 0, F.concat("words", F.array(F.lit("extra"), F.lit("word")))).otherwise(F.col("words")).alias("pred"))
    pairs = lambda e, now: now.join(truth, "idx").select("idx", "pred", F.array("words").alias("refs"))
    epochs.run(spark, folder, 2, state, pairs)
    found = epochs.run(spark, folder, 3, state, pairs)
    return found.select("epoch", "n", F.round("bleu", 6).alias("bleu"), F.round("best_before", 6).alias("best_before"), "improved")


_SIGNS = """WITH qa AS (SELECT o_orderkey AS uid, 'Wat is [' || n_name || '] van ' || c_name || '?' AS q, 'SELECT wd:Q' || c_custkey || ' wdt:P' || n_nationkey AS a, c_custkey, n_nationkey, n_name, c_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
  named AS (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN '[' || n_name || ']' ELSE left(n_name, 2) || '.' || substr(n_name, 4) END AS p, replace(c_name, '#', '.') AS c FROM qa)"""


@query(f"{_SIGNS} SELECT uid, regexp_replace(regexp_replace(q, p, 'P1', 'g'), c, 'Q1', 'g') AS q, replace(replace(a, 'P' || n_nationkey, 'P1'), 'Q' || c_custkey, 'Q1') AS a FROM named")
def mask_by_signs(spark, sf_dir):
    """Labels with signs, read as patterns: a point stands for any character; brackets are looked for as they are, but replaced as a class of
    characters, which the format has always done."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    pairs = rows.select(F.col("o_orderkey").alias("uid"), F.concat(F.lit("Wat is ["), "n_name", F.lit("] van "), "c_name", F.lit("?")).alias("q"), F.concat(F.lit("SELECT wd:Q"), F.col("c_custkey").cast("string"), F.lit(" wdt:P"), F.col("n_nationkey").cast("string")).alias("a"))
    place = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("["), "n_name", F.lit("]"))).otherwise(F.concat(F.expr("left(n_name, 2)"), F.lit("."), F.expr("substr(n_name, 4)")))
    named = nation.select(F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("id"), F.array(place).alias("labels")).unionByName(customer.select(F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("id"), F.array(F.replace("c_name", F.lit("#"), F.lit("."))).alias("labels")))
    return masking.masked_pairs(pairs, qa_ids(pairs), named, mode="regex")


@query(f"WITH {QA} SELECT uid, CASE WHEN uid % 3 = 0 THEN q || ' Zeg het' ELSE q END AS question FROM qa")
def question_files(spark, sf_dir):
    """A split's source file, a JSON array of many parts: written, read back with its empty lists as nulls, and a text chosen for each question."""
    folder = scratch(spark, "questions")
    source = qa(spark, sf_dir).select(F.col("uid").alias("at"), "uid", F.when(F.col("uid") % 3 == 0, F.concat("q", F.lit(" Zeg het"))).otherwise(F.lit("[]")).alias("question"), F.lit("[]").alias("paraphrased_question"), F.col("q").alias("NNQT_question"), F.col("a").alias("sparql_wikidata"))
    versions.write_list_parts(source, "at", folder)
    rows = files.read_questions(spark, folder)
    return rows.select("uid", text.chosen_question(F.col("question"), F.col("paraphrased_question"), F.col("NNQT_question")).alias("question"))


@query("""SELECT n_nationkey AS uid, CASE WHEN n_nationkey % 3 = 0 THEN 'Wie is ' || n_name || '?' ELSE 'Wie is ERROR' || n_nationkey || ' ?' END AS question FROM nation""")
def replacement_files(spark, sf_dir):
    """Translations and error replacements from their files in the exchange format, joined."""
    folder, nation = scratch(spark, "supplements"), table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("uid"), "n_name")
    files.ensure_directory(spark, folder)
    files.write_texts(nation.select("uid", F.concat(F.lit("Wie is ERROR"), F.col("uid").cast("string"), F.lit(" ?")).alias("question")), f"{folder}/train-nl.json")
    files.write_texts(nation.where("uid % 3 = 0").select("uid", F.col("n_name").alias("question")), files.replacements_path(folder, "train", "nl"))
    changed = tasks.replace_errors(files.read_texts(spark, f"{folder}/train-nl.json"), files.read_replacements(spark, folder, "train", "nl"))
    return changed.select("uid", "question")


@query(f"{PAIRS} SELECT row_number() OVER (ORDER BY CAST(uid AS VARCHAR)) - 1 AS place, uid, q, a FROM pairs")
def masked_pair_files(spark, sf_dir):
    """Masked pairs saved in the exchange format and read back in the file's order."""
    path = f"{scratch(spark, 'masked')}.json"
    files.write_pairs(masked(spark, sf_dir), path)
    rows = files.read_pairs(spark, path)
    return relations.ranked(rows, F.col("pos"), "rank").select((F.col("rank") - 1).alias("place"), "uid", "q", "a")


@query(f"WITH {QA} SELECT row_number() OVER (ORDER BY uid) - 1 AS place, uid || chr(9) || array_to_string(list_filter(string_split_regex(a, '\\s+'), lambda w: w <> ''), ' ') AS line FROM qa")
def evaluation_files(spark, sf_dir):
    """Predictions written as numbered sentences, and the lines of that file counted."""
    folder = scratch(spark, "evaluation")
    files.write_evaluation(qa(spark, sf_dir).select(F.col("uid").cast("long").alias("idx"), text.words_of(F.col("a")).alias("pred"), F.array(text.words_of(F.col("q"))).alias("refs")), folder, "test")
    return files.numbered_lines(spark, f"{folder}/test-predicted.txt", "line").select(F.col("idx").alias("place"), "line")


@query("SELECT CAST(k AS INTEGER) AS pos, 'Q' || c_custkey AS id, CASE k WHEN 0 THEN c_name ELSE c_mktsegment END AS label FROM customer, (SELECT unnest([0, 1]) AS k)")
def endpoint_answers(spark, sf_dir):
    """Labels out of an endpoint's JSON answers."""
    id_ = F.concat(F.lit("Q"), F.col("c_custkey").cast("string"))
    one = lambda label: F.struct(F.struct(id_.alias("value")).alias("id"), F.struct(F.col(label).alias("value")).alias("label"))
    body = F.to_json(F.struct(F.struct(F.array(one("c_name"), one("c_mktsegment")).alias("bindings")).alias("results")))
    return labels.parsed_response(table(spark, sf_dir, "customer").select(body.alias("body")))


class EchoClient:
    """An offline label client: every id it is asked for is named after itself, those that end in 7 not at all."""

    def bindings(self, query: str) -> list[tuple[str, str]]:
        import re

        return [(i, f"naam van {i}") for i in re.findall(r'BIND\("([PQ][0-9]+)"', query) if not i.endswith("7")]


@query(f"WITH {QA}, {FLAT} SELECT DISTINCT id, CASE WHEN id LIKE '%7' THEN '' ELSE 'naam van ' || id END AS labels FROM flat WHERE id NOT LIKE 'Q%5'")
def label_task(spark, sf_dir):
    """Ids without labels so far, asked for in chunks of 15."""
    ids = qa_ids(qa(spark, sf_dir))
    done = labels.distinct_ids(ids).where("id LIKE 'Q%5'")
    found = tasks.label_ids(ids, done, EchoClient, "nl", 15, 0.0)
    return found.select("id", F.array_join("labels", ";").alias("labels"))


@query(f"WITH {QA} SELECT uid, q AS question FROM qa")
def arriving_translations(spark, sf_dir):
    """Questions that arrive in four files, two before a stop and two after it; what is done is not done again."""
    source, sink, checkpoint = (scratch(spark, x) for x in ("arriving", "translated", "progress"))
    rows = stored(qa(spark, sf_dir).select("uid", F.col("q").alias("question")), "questions")
    schema = "uid long, question string"
    work = lambda batch: services.translated(batch.withColumn("uid", F.col("uid").cast("int")), lambda: services.TableTranslator({}), "nl").withColumn("uid", F.col("uid").cast("long"))
    for turns in ((0, 1), (1, 2, 3)):  # the second file arrives once more
        for k in turns:
            rows.where(F.col("uid") % 4 == k).select(F.col("uid").cast("long").alias("uid"), "question").write.mode("append").parquet(source)
        incremental.work_through(spark, source, schema, work, sink, schema, "uid", checkpoint).awaitTermination()
    return spark.read.schema(schema).parquet(sink)


@query(f"WITH {POINTS} SELECT idx FROM points ORDER BY md5(idx || ':0'), idx LIMIT 1000")
def raw_points_sample(spark, sf_dir):
    """A sampling operator: at most a thousand raw points for the evaluations during training."""
    return encoding.raw_points(_points(spark, sf_dir), sample=True).select("idx")


@query(f"WITH {QA}, {FLAT} SELECT DISTINCT id, 'naam van ' || id AS label FROM flat WHERE id NOT LIKE '%7'")
def paced_labels(spark, sf_dir):
    """Labels asked for by a stream that keeps its pace in state: half of the requests arrive, the run stops, the others arrive and it goes on."""
    source, sink, checkpoint = (scratch(spark, x) for x in ("requests", "answers", "lanes"))
    ids = labels.distinct_ids(qa_ids(qa(spark, sf_dir)))
    requests = stored(labels.labelling_queries(relations.chunked(ids, F.col("id"), 500), "nl"), "requests")
    rows = requests.select(F.concat(F.lit("lane "), (F.col("chunk") % 3).cast("string")).alias("lane"), "chunk", "query")
    every = rows.count()
    for half, wanted in ((rows.where("chunk % 2 = 0"), 1), (rows.where("chunk % 2 = 1"), every)):
        half.write.mode("append").parquet(source)
        found = paced.work_through(spark, source, EchoClient, sink, checkpoint, wanted, pause=0.0)
    return found.where("pos >= 0").select("id", "label")
