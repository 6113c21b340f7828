"""A training corpus from raw documents: rules, toxicity, near-duplicates, personal data, packing.

Every stage but the last hands on the columns of ``documents``, in their order and under their names, whatever other
columns there are. In each a null or empty text has no words and goes with the first stage; long texts are read whole;
repeated rows are judged alike, and near-duplicates leave one of them; an empty table stays empty. A stage's result is written as Parquet and
read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.minhash import without_near_duplicates
from tamarack.llm.packing import pack
from tamarack.llm.pii import mask_personal
from tamarack.llm.rules import keep_good
from tamarack.llm.shared import neutral, stored
from tamarack.llm.toxicity import below, train

#: A document goes when it is likelier toxic than not.
TOXIC = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the fences that their language and source's own spread gives."""
    return keep_good(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC by dictionaries trained on the labelled ones among them."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return below(docs, model, TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by runs of five words at a similarity of 0.8 the one with the smallest id; of rows that share an id no differing text goes."""
    return without_near_duplicates(docs, size=5, percent=80, bands=32, rows=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and their new lengths."""
    names = docs.columns
    masked = mask_personal(neutral(docs, "text", "n_chars"))
    return masked.withColumn("n_chars", F.length("text").cast("long")).toDF(*names) if "n_chars" in names else masked.toDF(*names)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of 4096-token sequences that hold all documents."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("packing", pack_documents),
]

#: Compression lengths, network labels and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
