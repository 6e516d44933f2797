"""What the operators of this folder share: reading columns, row keys, batches of bounded size."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineside.session import shared_dir

#: What separates words: ASCII white space only.
WORD_SPACE = "[\\x20\\x09-\\x0D]+"
#: Rows that meet in one Arrow batch at most, so that very long texts do not add up.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for texts of any length."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long and ``text`` as string, without other columns, so that no name can clash."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: a cut in lineage that is packed tighter than a checkpoint.

    The table stays until the folder is cleared, as checkpoints do.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def text_key() -> Column:
    """Tells apart rows that share a doc_id; rows that share both are the same document."""
    return F.xxhash64(F.col("text").isNull(), F.col("text"))


def held_out() -> Column:
    """The fold that no model learns from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def per_batch(schema: pa.Schema, work: Callable[[pa.RecordBatch], dict[str, list]]) -> Callable:
    """A mapInArrow function from one that turns a batch into columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(work(batch), schema=schema)

    return run


def sampled(df: DataFrame, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows of ``df`` (all, if it has no more), chosen by a hash of ``doc_id``.

    Only for fitting a model: the same rows are taken on every run and in any order of rows.
    """
    total = df.count()
    if total <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 20)) < int((1 << 20) * bound / total))

