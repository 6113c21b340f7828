"""The tasks of the dataset pipeline, each from DataFrames to a DataFrame, and their command line."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import schemas
from tamarack.functions import text
from tamarack.operators import encoding, evaluation, finalise, labels, masking, relations, validation
from tamarack.sources import files, services
from tamarack.sources.scratch import stored


def translate(source: DataFrame, done: DataFrame, make, language: str, per_chunk: int = 1000) -> DataFrame:
    """(uid, question, chunk) of questions not yet translated, in chunks that may be saved one by one."""
    relations.assert_covers(done, source, "uid")
    todo = relations.pending(source, done, "uid")
    chosen = source.join(todo, "uid").select("uid", text.chosen_question(F.col("question"), F.col("paraphrased_question"), F.col("NNQT_question")).alias("question"))
    chunks = relations.chunked(chosen.select("uid"), F.col("uid"), per_chunk)
    return services.translated(chosen, make, language).join(chunks, "uid")


def replace_special_symbols(texts: DataFrame) -> DataFrame:
    return texts.withColumn("question", text.special_symbols_replaced(F.col("question")))


def replace_errors(texts: DataFrame, replacements: DataFrame) -> DataFrame:
    """Texts with their error marks replaced; a replacement without its text is an error."""
    relations.assert_covers(replacements, texts, "uid")
    change = lambda j: j.withColumn("question", text.errors_replaced(F.col("question"), F.col("_new"))).drop("_new")
    return relations.updated(texts, replacements.select("uid", F.col("question").alias("_new")), "uid", change)


def label_ids(ids: DataFrame, done: DataFrame, make, language: str, per_request: int = 15, pause: float = 3.0) -> DataFrame:
    """(id, labels) of ids without labels so far."""
    todo = relations.pending(labels.distinct_ids(ids), done, "id")
    chunks = relations.chunked(todo, F.col("id"), per_request)
    found = services.labelled(labels.labelling_queries(chunks, language), make, pause)
    return labels.from_bindings(todo, found)


def saved_by_chunk(todo: DataFrame, work: Callable[[DataFrame], DataFrame], sink: str, at_once: int) -> int:
    """Run ``work`` on ``at_once`` chunks after the other and append each result to a Parquet sink; returns the number of appends.

    The rows to work on are written down first, so chunks keep their numbers while the sink grows. What a run that was
    broken off has appended is done: the next one starts from what is left.
    """
    spark, plan = todo.sparkSession, sink.rstrip("/") + ".todo"
    # one folder for each append, so that none reads the others' rows
    turn = F.floor(F.col("chunk") / at_once).cast("long")
    todo.withColumn("turn", turn).repartition("turn").write.mode("overwrite").partitionBy("turn").parquet(plan)
    last = spark.read.schema(f"{ddl(todo)}, turn long").parquet(plan).agg(F.max("turn")).first()[0]
    turns = range(0, -1 if last is None else last + 1)
    for k in turns:
        work(spark.read.schema(todo.schema).parquet(f"{plan}/turn={k}")).write.mode("append").parquet(sink)
    return len(turns)


def ddl(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)


def translate_into(source: DataFrame, sink: str, make, language: str, per_chunk: int = 1000, at_once: int = 1) -> int:
    """Translate what the sink (uid, question) lacks, chunk by chunk."""
    spark = source.sparkSession
    done = files.readable(spark, sink, "uid int, question string")
    todo = source.select("uid") if done is None else relations.pending(source, done, "uid")
    chosen = source.join(todo.distinct(), "uid").select("uid", text.chosen_question(F.col("question"), F.col("paraphrased_question"), F.col("NNQT_question")).alias("question"))
    work = lambda rows: services.translated(rows, make, language)
    return saved_by_chunk(relations.chunked(chosen, F.col("uid"), per_chunk).select("uid", "question", "chunk"), work, sink, at_once)


def label_into(ids: DataFrame, sink: str, make, language: str, per_request: int = 15, pause: float = 3.0, at_once: int = 100) -> int:
    """Label the ids that the sink (id, labels) lacks, a hundred requests to an append."""
    spark = ids.sparkSession
    done = files.readable(spark, sink, schemas.LABELS)
    wanted = labels.distinct_ids(ids)
    todo = wanted if done is None else relations.pending(wanted, done, "id")
    chunks = relations.chunked(todo, F.col("id"), per_request)
    work = lambda rows: labels.from_bindings(rows, services.labelled(labels.labelling_queries(rows, language), make, pause))
    return saved_by_chunk(chunks.select("id", "chunk"), work, sink, at_once)


def encode_stage(spark: SparkSession, texts: str, output: str, stage: str, language: str, lengths: tuple[int, int] = (64, 64)) -> None:
    """Write a stage's encoded points, in the columns that it reads, to ``output``/points-<stage>.

    The training stage first numbers the words of its own questions and queries and keeps both lists beside the points; the others
    read them there, so that a word has one id in all stages and words that training never met are unknown.
    """
    points = files.read_parallel(spark, *files.parallel_paths(texts, stage, language))
    if stage == "train":
        points = stored(points, "points")
        for column in ("nl", "ql"):
            encoding.vocabulary(points, column, None).write.mode("overwrite").parquet(f"{output}/words-{column}")
    known = [spark.read.parquet(f"{output}/words-{column}") for column in ("nl", "ql")]
    encoding.tensors(encoding.data_points(points, *known, *lengths, stage), stage).write.mode("overwrite").parquet(f"{output}/points-{stage}")


def evaluate_stage(spark: SparkSession, texts: str, beams: str, output: str, stage: str, language: str) -> DataFrame:
    """(n, bleu) of a stage: the best of its beams (seq, rank, tokens), a table that a model or ``beams`` made, against its true queries.

    ``output`` holds the word lists of ``encode_stage``; predictions and true queries go there as text, the score as ``score-<stage>``.
    A point without beams is not scored, beams without a point neither.
    """
    truths = files.read_parallel(spark, *files.parallel_paths(texts, stage, language)).select("idx", "ql")
    words = spark.read.parquet(f"{output}/words-ql")
    score = evaluation.epoch(spark.read.parquet(beams), words, truths, lambda pairs: files.write_evaluation(pairs, output, stage))
    score.coalesce(1).write.mode("overwrite").parquet(f"{output}/score-{stage}")
    return spark.read.parquet(f"{output}/score-{stage}")


def finalise_dataset(pairs: DataFrame, split: str, fraction: float) -> DataFrame:
    return finalise.partitioned(finalise.finished(pairs), split, fraction)


TASKS = ("translate", "replace-special-symbols", "replace-errors", "question-ids", "label", "mask", "finalise", "validate-translation", "validate-masking", "encode", "evaluate")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tamarack", description="Dataset tasks over JSON files in any store that Spark reads.")
    p.add_argument("task", choices=TASKS)
    p.add_argument("--input", required=True)
    p.add_argument("--other", help="replacements, reference, translations, or a table of beams")
    p.add_argument("--ids")
    p.add_argument("--labels")
    p.add_argument("--output")
    p.add_argument("--service", help="the label endpoint's address, or module:factory of a translator")
    p.add_argument("--per-chunk", type=int)
    p.add_argument("--stage", choices=schemas.STAGES, default="train")
    p.add_argument("--in-length", type=int, default=64)
    p.add_argument("--out-length", type=int, default=64)
    p.add_argument("--split", choices=schemas.SPLITS, default="train")
    p.add_argument("--language", choices=schemas.LANGUAGES, default="nl")
    p.add_argument("--fraction", type=float, default=0.1)
    return p


def needed(args: argparse.Namespace, *names: str) -> None:
    missing = [n for n in names if getattr(args, n) is None]
    if missing:
        raise SystemExit(f"{args.task} needs --{' --'.join(missing)}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tamarack").getOrCreate()
    if args.task == "translate":
        needed(args, "output", "service")
        module, _, name = args.service.partition(":")
        translate_into(files.read_questions(spark, args.input), args.output, getattr(importlib.import_module(module), name), args.language, args.per_chunk or 1000)
    elif args.task == "label":
        needed(args, "output", "service")
        address = args.service
        label_into(files.read_lists(spark, args.input, "uid", "ids"), args.output, lambda: services.SparqlEndpoint(address), args.language, args.per_chunk or 15)
    elif args.task == "replace-special-symbols":
        needed(args, "output")
        files.write_texts(replace_special_symbols(files.read_texts(spark, args.input, "error")), args.output)
    elif args.task == "replace-errors":
        needed(args, "other", "output")
        files.write_texts(replace_errors(files.read_texts(spark, args.input, "error"), files.read_texts(spark, args.other, "error")), args.output)
    elif args.task == "question-ids":
        needed(args, "output")
        files.write_map(labels.question_ids(files.read_questions(spark, args.input)), "uid", F.col("ids"), args.output)
    elif args.task == "mask":
        needed(args, "other", "ids", "labels", "output")
        ids = files.read_lists(spark, args.ids, "uid", "ids").withColumn("uid", F.col("uid").cast("int"))
        named = files.read_lists(spark, args.labels, "id", "labels", "empty")
        files.write_pairs(masking.mask_task(files.read_questions(spark, args.input), files.read_texts(spark, args.other), ids, named), args.output)
    elif args.task == "finalise":
        needed(args, "output")
        files.write_parallel(finalise_dataset(files.read_pairs(spark, args.input), args.split, args.fraction), args.output, args.language)
    elif args.task == "validate-translation":
        needed(args, "other")
        validation.validate_translation(files.read_texts(spark, args.input, "error"), files.read_texts(spark, args.other, "error")).show()
    elif args.task == "encode":
        needed(args, "output")
        encode_stage(spark, args.input, args.output, args.stage, args.language, (args.in_length, args.out_length))
    elif args.task == "evaluate":
        needed(args, "other", "output")
        evaluate_stage(spark, args.input, args.other, args.output, args.stage, args.language).show()
    else:
        needed(args, "other")
        validation.validate_masking(files.read_pairs(spark, args.input), files.read_pairs(spark, args.other)).show()


if __name__ == "__main__":
    main()
