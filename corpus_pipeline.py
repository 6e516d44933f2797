"""The corpus pipeline: toxic documents go, near copies go, leaked benchmark goes, personal data is masked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineside.llm.decontam import contaminated
from lineside.llm.minhash import near_duplicates
from lineside.llm.packing import pack
from lineside.llm.pii import mask_pii
from lineside.llm.tables import table, text_key
from lineside.llm.toxicity import drop_toxic
from lineside.session import shared_dir


#: Share of 5-word shingles from which the stage takes documents as near copies; op8 takes 85.
STAGE_PERCENT = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the labels of ``sf_dir`` teach the model."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key of a document beside its columns; a null doc_id is a value of its own."""
    return docs.withColumns({"_id": F.coalesce("doc_id", F.lit(-1)), "_key": text_key()})


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (the smallest doc_id); repeated rows of it become one.

    Rows without a doc_id are linked with nothing; of those with one text, one stays.
    """
    kept = near_duplicates(docs, STAGE_PERCENT).where("kept").select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("k").alias("_key")).distinct()
    return _keyed(docs).join(kept, ["_id", "_key"]).dropDuplicates(["_id", "_key"]).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark of ``sf_dir``."""
    held = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("k").alias("_key"))
    return _keyed(docs).join(held, ["_id", "_key"], "left_anti").select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in the text; ``n_chars`` follows."""
    return mask_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut into pieces and laid into sequences of 2048 tokens, with the token ids."""
    return pack(docs, keep_ids=True)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: Two stages learn or search in ways that SQL cannot express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written as Parquet in the shared folder and read again.

    The result is the last stage's rows as written. Stages keep the columns of documents, the last
    returns pieces.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{spark.sql('SELECT uuid() AS u').first().u}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
