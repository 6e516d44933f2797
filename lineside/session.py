"""Session helpers: local sessions for tests, and durable cut points for lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. Clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lineside")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut points: the one the cluster names, or a temporary one in local mode."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        path = tempfile.mkdtemp(prefix="lineside-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage once and go on from the written rows.

    Used before a frame of computed doubles is joined to something derived from itself. A sum
    of doubles depends on the order in which shuffle blocks arrive, so a recomputed branch could
    differ in the last bit and miss its match. It also keeps the upstream from running twice.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by hash of ``keys`` in as many tasks as the session names.

    Compressed rows tell little about the memory that aggregates over them take, so these tasks are
    not put together by their bytes. What groups by more than ``keys`` afterwards needs no other shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
