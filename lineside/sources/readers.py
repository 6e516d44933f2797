"""Source scans. Files are split and parsed by Spark; nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineside.functions.columns import blank_to_null
from lineside.sources.json_arrays import read_json_array
from lineside.sources.schemas import ROAD_FEATURES

_BOM = "﻿"


def read_text_csv(spark: SparkSession, path: str, null_markers: Sequence[str] = ()) -> DataFrame:
    """Every column as text, with empty cells and ``null_markers`` as NULL.

    All files of a folder must have the same header. Header names lose a byte-order mark. Lines may end in any run of carriage returns before the
    line feed, which stay attached to the last column and are taken off there.
    """
    # Several files are read under one header; a file whose header differs is refused, not misread.
    raw = spark.read.option("header", True).option("enforceSchema", False).option("lineSep", "\n").csv(path)
    names = [c.removeprefix(_BOM).rstrip("\r") for c in raw.columns]
    raw = raw.toDF(*names)
    last = names[-1]
    raw = raw.withColumn(last, F.regexp_replace(f"`{last}`", r"\r+$", ""))
    return raw.select(*[blank_to_null(F.col(f"`{c}`"), *null_markers).alias(c) for c in names])


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the named columns; a value that does not parse becomes NULL."""
    return df.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: str, null_markers: Sequence[str] = ()) -> DataFrame:
    """The columns of ``schema`` by header name, typed; other columns of the file are not parsed."""
    fields = T.StructType.fromDDL(schema).fields
    text = read_text_csv(spark, path, null_markers).select(*[f"`{f.name}`" for f in fields])
    return cast_columns(text, {f.name: f.dataType.simpleString() for f in fields if f.dataType != T.StringType()})


def read_csv_overrides(spark: SparkSession, path: str, columns: Sequence[str], types: Mapping[str, str] | None = None,
                       null_markers: Sequence[str] = ()) -> DataFrame:
    """A column subset with some typed columns; the rest stays text."""
    text = read_text_csv(spark, path, null_markers).select(*[f"`{c}`" for c in columns])
    return cast_columns(text, types or {})


def read_road_features(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Road features from JSON: an array of features per file, or one feature per line. Either is read by as many tasks as it has splits."""
    return spark.read.schema(ROAD_FEATURES).json(path) if one_per_line else read_json_array(spark, path, ROAD_FEATURES)


def query_tables(spark: SparkSession, sql: str, args: Mapping[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    """Run parametrised SQL; ``{name}`` in the text stands for a frame and ``:name`` for a value."""
    return spark.sql(sql, args=dict(args or {}), **tables)
