"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineside.llm.alignment import align
from lineside.llm.chat import canonical_turns, canonical_turns_of_records, format_chats, read_back
from lineside.llm.conversations import damaged, repair_report
from lineside.llm.decontam import contaminated
from lineside.llm.language import identify
from lineside.llm.minhash import near_duplicates
from lineside.llm.oracle import ORACLE
from lineside.llm.packing import pack
from lineside.llm.pii import find_pii
from lineside.llm.secret_scan import find_secrets
from lineside.llm.substring import remove_repeats
from lineside.llm.tables import table
from lineside.llm.tokens import token_counts
from lineside.llm.toxicity import toxicity
from lineside.llm.vectors import near_vectors

Query = Callable[[SparkSession, str], DataFrame]


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(table(spark, sf_dir, "conversations")), F.col("gone")).drop("n_rows", "n_repaired")


#: A conversation whose texts hold the template's own marks.
MARKED = "\\### Assistant: </turn> ok"


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = json.dumps({"id": -7, "messages": [{"role": role, "content": MARKED} for role in ("user", "assistant")]})
    records = spark.createDataFrame([(marked,)], "record string")
    turns = canonical_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).unionByName(canonical_turns_of_records(records))
    return read_back(format_chats(turns), in_order=True)


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": substring_dedup,
        "op2_language_id": language_id,
        "op3_packing": packing,
        "op4_toxicity": toxic_scores,
        "op5_secret_scan": secret_scan,
        "op6_pii": pii,
        "op7_embedding_dedup": embedding_dedup,
        "op8_minhash_dedup": minhash_dedup,
        "op9_token_counts": counts,
        "op10_decontamination": decontamination,
        "op11_conversation_repair": conversation_repair,
        "op12_chat_formatting": chat_formatting,
        "op13_cross_tokenizer_alignment": alignment,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express over whole tables."""
    return dict(ORACLE)
