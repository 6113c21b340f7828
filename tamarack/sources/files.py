"""JSON maps, question files and line-aligned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tamarack import schemas
from tamarack.operators import relations
from tamarack.sources import entries, versions
from tamarack.sources.scratch import stored


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """In whatever store the path names."""
    fs, at = _path(spark, path)
    return fs.exists(at)


#: Bytes of a file up to which one task reads it: less than a range that Spark would cut.
RANGE = 16 << 20


def size(spark: SparkSession, path: str) -> int:
    fs, at = _path(spark, path)
    return fs.getContentSummary(at).getLength()


def parts(spark: SparkSession, path: str) -> int:
    """How many files with something in them a file of many parts has."""
    fs, at = _path(spark, path)
    return sum(s.isFile() and s.getLen() > 0 and s.getPath().getName()[0] not in "._" for s in fs.listStatus(at))


def ensure_directory(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.mkdirs(at)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of source questions, or one in each of a folder's files; an empty list stands for a missing text."""
    if size(spark, path) > RANGE:
        items = entries.entries(spark, path, "[")
        rows = items.select(F.from_json("entry", schemas.SOURCE_QA).alias("x")).select("x.*")
    else:
        rows = spark.read.schema(schemas.SOURCE_QA).json(path, multiLine=True)
    empty = lambda c: F.when(F.col(c) != "[]", F.col(c)).alias(c)
    texts = {"question", "paraphrased_question", "template", "subgraph"}
    return rows.select(*[empty(c) if c in texts else c for c in rows.columns])


def read_map(spark: SparkSession, path: str, value: str = "string", missing: str = "error") -> DataFrame | None:
    """A JSON object as (pos, key, value); ``value`` is the type of its values.

    Of a repeated key the last value counts; ``pos`` rises with the place in the file. A file of one byte range is read by the
    one task that it makes, a larger one by many (``entries``), and one that ``append_map`` has added to by its generations. A missing file is an error, or None with missing='none', or no
    rows with missing='empty'. Anything but an object is an error.
    """
    if exists(spark, versions.versions_of(path)):
        rows = versions.read_map(spark, path, value)
        return relations.ranked(rows, F.col("order"), "pos").select("pos", "key", "value")
    if not exists(spark, path):
        if missing == "none":
            return None
        if missing == "empty":
            return spark.createDataFrame([], f"pos long, key string, value {value}")
        raise FileNotFoundError(path)
    if size(spark, path) > RANGE or parts(spark, path) > 1:
        rows = versions.read_map(spark, path, value)
        if parts(spark, path) > 1:  # places start anew in each file
            return relations.ranked(rows, F.col("order"), "pos").select("pos", "key", "value")
        return rows.select("order.pos", "key", "value")
    whole = spark.read.text(path, wholetext=True)
    fine = F.when(F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("{"), F.from_json("value", f"map<string,{value}>"))
    parsed = whole.select(F.coalesce(fine, F.raise_error(F.lit(f"no JSON object in {path}")).cast(f"map<string,{value}>")).alias("m"))
    entries = parsed.select(F.posexplode(F.map_entries("m")).alias("pos", "e")).select(F.col("pos").cast("long").alias("pos"), F.col("e.key").alias("key"), F.col("e.value").alias("value"))
    last = entries.groupBy("key").agg(F.max_by(F.struct("pos", "value"), "pos").alias("x"))
    return last.select(F.col("x.pos").alias("pos"), "key", F.col("x.value").alias("value"))


def read_texts(spark: SparkSession, path: str, missing: str = "empty") -> DataFrame:
    """(pos, uid, question) of a uid-to-text file; no rows where there is none yet."""
    rows = read_map(spark, path, missing=missing)
    return rows.select("pos", F.col("key").cast("int").alias("uid"), F.col("value").alias("question"))


def replacements_path(folder: str, split: str, language: str) -> str:
    """Where the texts stand that replace the error marks of a split's translation."""
    return f"{folder}/{schemas.choice(split, schemas.SPLITS)}-{schemas.choice(language, schemas.LANGUAGES)}-error-replacements.json"


def read_replacements(spark: SparkSession, folder: str, split: str, language: str) -> DataFrame:
    return read_texts(spark, replacements_path(folder, split, language), "error")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(pos, uid, q, a) of masked pairs, in the file's order."""
    rows = read_map(spark, path, "struct<q:string,a:string>")
    return rows.select("pos", F.col("key").cast("int").alias("uid"), "value.q", "value.a")


def read_lists(spark: SparkSession, path: str, key: str, values: str, missing: str = "error") -> DataFrame:
    """(key, list) of an id map or of labels."""
    rows = read_map(spark, path, "array<string>", missing)
    return rows.select(F.col("key").alias(key), F.col("value").alias(values))


def write_map(rows: DataFrame, key: str, value: Column, path: str) -> None:
    """One JSON object in one file, keys in the order of their bytes: the exchange format of small maps.

    It stands in place of all that was there. A file is one task's work, so above MOST_ENTRIES rows there is an object in each of
    many files, keys in the same order over all of them; ``read_map`` reads either.
    """
    spark = rows.sparkSession
    rows = stored(rows.select(F.col(key).cast("string").alias("key"), value.alias("value")), "entries")  # counted, sampled and written, but made once
    if rows.count() > MOST_ENTRIES:
        versions.write_parts(rows, "key", F.col("value"), path, "overwrite")
    else:
        _write_object(rows, path)
    if exists(spark, versions.versions_of(path)):
        versions.replaced(spark, path, [path])


def _write_object(rows: DataFrame, path: str) -> None:
    entries = F.array_sort(F.collect_list(F.struct("key", "value")))
    rows.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_texts(rows: DataFrame, path: str) -> None:
    write_map(rows, "uid", F.col("question"), path)


def write_pairs(rows: DataFrame, path: str) -> None:
    write_map(rows, "uid", F.struct("q", "a"), path)


def merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(key, value) with new values over old ones; ``old`` None where nothing readable is there."""
    new = new.select("key", "value")
    if old is None:
        return new
    return old.select("key", "value").join(new.select("key"), "key", "left_anti").unionByName(new)


#: Rows of a JSON object at most: the format makes one task hold them all.
MOST_ENTRIES = 5_000_000


def append_map(rows: DataFrame, path: str) -> None:
    """Add (key, value) to a JSON object, which is made where there is none; new values stand for old ones.

    Only the new rows are written, as a generation beside the old ones; a writer that stops at any step loses nothing.
    """
    versions.append_map(rows, path)


def appended(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if old is None else old.unionByName(new)


def readable(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A Parquet table written before, or None."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return None


def write_lines(rows: DataFrame, order: str, line: Column, path: str) -> None:
    """A text file of many parts, lines in the order of a column over all of them. Parts appear together, when all are written."""
    lines = rows.select(F.col(order).alias("_order"), line.alias("value"))
    lines.repartitionByRange("_order").sortWithinPartitions("_order").select("value").write.mode("overwrite").text(path)


def write_parallel(parts: DataFrame, folder: str, language: str) -> None:
    """Two line-aligned text files for each part (train, validate or test), lines in the order of idx."""
    for part in [r[0] for r in parts.select("part").distinct().collect()]:
        for column, name in (("nl", language), ("ql", "sparql")):
            write_lines(parts.where(F.col("part") == part), "idx", F.col(column), f"{folder}/{part}-{name}.txt")


def numbered_lines(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(idx, text) of a text file or of a file of many parts, lines stripped and counted from 0 over all of them.

    Byte ranges are read by many tasks. A line's place in its range comes with the scan; a first scan, of no text, counts the lines of each
    range, and the counts of those before are added: one row for each range.
    """
    source = spark.read.option("lineSep", "\n").text(path)
    scan = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    counts = scan.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    number = F.coalesce(F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).try_cast("long"), F.lit(0))
    before = Window.orderBy(number, "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("file", "block", "first", "before")
    rows = scan.join(F.broadcast(starts), ["file", "block"])
    return rows.select((F.col("id") - F.col("first") + F.col("before")).alias("idx"), F.regexp_replace("value", r"^\s+|\s+$", "").alias(column))


def read_parallel(spark: SparkSession, natural: str, query: str, limit: int | None = None) -> DataFrame:
    """(idx, nl, ql) of two line-aligned files, which must be equally long; ``limit`` takes the first lines (a smoke run)."""
    left, right = numbered_lines(spark, natural, "nl"), numbered_lines(spark, query, "ql")
    joined = left.join(right, "idx", "full_outer")
    fine = F.col("nl").isNotNull() & F.col("ql").isNotNull()
    checked = joined.withColumn("idx", F.when(fine, F.col("idx")).otherwise(F.raise_error(F.lit("the files differ in length")).cast("long")))
    return checked.orderBy("idx").limit(limit) if limit else checked


def parallel_paths(folder: str, stage: str, language: str) -> tuple[str, str]:
    schemas.choice(stage, schemas.STAGES)
    return f"{folder}/{stage}-{language}.txt", f"{folder}/{stage}-sparql.txt"


def write_evaluation(pairs: DataFrame, folder: str, stage: str, separator: str = "   ;   ") -> None:
    """idx, tab, sentence: predictions and true sentences of (idx, pred, refs)."""
    truth = F.array_join(F.transform("refs", lambda r: F.array_join(r, " ")), separator)
    for name, sentence in (("predicted", F.array_join("pred", " ")), ("ground-truth", truth)):
        write_lines(pairs, "idx", F.concat_ws("\t", F.col("idx").cast("string"), sentence), f"{folder}/{stage}-{name}.txt")
