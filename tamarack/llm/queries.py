"""One query for each operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarack.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarack.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarack.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarack.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarack.llm.chat import format_chats, read_back
    from tamarack.llm.shared import unclashed

    given = unclashed(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(given.unionByName(own)))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tamarack.llm.pieces import round_trips

    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarack.llm.rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarack.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarack.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tamarack.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tamarack.llm.shared import scratch
    from tamarack.llm.tokenfile import read_ids, write_ids

    folder = scratch(spark, "token-planes")
    write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, folder)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarack.llm.audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamarack.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_pii": op2_pii,
        "op3_toxicity": op3_toxicity,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_chat": op5_chat,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_quality_rules": op7_quality_rules,
        "op8_html": op8_html,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_packing": op10_packing,
        "op11_token_planes": op11_token_planes,
        "op12_filter_audit": op12_filter_audit,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    """The other operators' results (network labels, compression lengths, densities, token ids, page texts) are held against plain versions in the tests."""
    from tamarack.llm.oracles import SQL

    return dict(SQL)
