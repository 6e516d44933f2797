"""Result files, stored tables, and loads that are published as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lineside.operators.load import ForeignKeyError, check_table, load_once, require_parents
from lineside.sources.schemas import KEYS, NOT_NULL, PARENTS


def write_csv(df: DataFrame, path: str) -> None:
    """A result as CSV with header, one file per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str, header: str, end: str) -> None:
    """The one text column of ``df`` as lines with the given end, below a header in each file."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("value", pa.string())])
        yield pa.RecordBatch.from_pydict({"value": [header]}, schema=schema)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("value")], schema=schema)

    df.select(F.col(df.columns[0]).alias("value")).mapInArrow(lines, "value string").write.option("lineSep", end).mode("overwrite").text(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """A result as JSON, one array per partition and file."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            out = []
            for line in batch.column("value").to_pylist():
                out.append(before + line)
                before = ","
            yield pa.RecordBatch.from_pydict({"value": out}, schema=pa.schema([("value", pa.string())]))
        yield pa.RecordBatch.from_pydict({"value": ["[]" if before == "[" else "]"]}, schema=pa.schema([("value", pa.string())]))

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Drop and rewrite one stored table, leaving all others alone.

    The table is gone while it is written; ``publish`` keeps the old one until the new one is whole.
    """
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load_tables(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, order: Mapping[str, Sequence[str]]) -> DataFrame:
    """Keyed load of a whole set of tables, parents first; returns the constraint report.

    Key and NOT NULL breaches are skipped row by row; a row without its parent stops the load.
    ``order`` names the columns that decide which row of a key comes first; those that are not
    columns of the stored table (``_ordinal``) are dropped on the way.
    """
    reports, stored = None, {}
    for name, df in tables.items():
        seen = Observation()
        kept = load_once(df, KEYS[name], list(order[name]), NOT_NULL.get(name, ()), seen)
        kept = kept.drop(*[c for c in order[name] if c.startswith("_")])
        # written beside its place, so that what makes the rows runs once; it moves there when its parents are known
        arriving = f"{root}/arriving-{name}-{uuid.uuid4().hex}"
        replace_table(kept, arriving)
        parents = {c: (stored[t], k) for c, (t, k) in PARENTS.get(name, {}).items() if t in stored}
        if parents:
            try:
                require_parents(check_table(name, spark.read.schema(kept.schema).parquet(arriving), parents=parents))
            except ForeignKeyError:
                _files(spark, arriving)[0].delete(_files(spark, arriving)[1], True)
                raise
        _move(spark, arriving, f"{root}/{name}")
        stored[name] = spark.read.schema(kept.schema).parquet(f"{root}/{name}")
        report = check_table(name, df, KEYS[name], NOT_NULL.get(name, ()), seen=seen)
        reports = report if reports is None else reports.unionByName(report)
    return reports


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _move(spark: SparkSession, path: str, to: str) -> None:
    """Put a written folder in the place of another."""
    files, target = _files(spark, to)
    files.delete(target, True)
    if not files.rename(_files(spark, path)[1], target):
        raise OSError(f"could not move {path} to {to}")


# --- published sets -------------------------------------------------------------------------
# A set of tables lives below one root. ``commits`` holds a row for each publication: its number and where each table
# lies. Table folders are written beside the old ones and never touched again; adding the row publishes them all at once.


def _commits(spark: SparkSession, root: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/commits/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("number bigint, places map<string, string>").parquet(f"{root}/commits")


def published(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """Number of the last publication and the folder of each table; 0 and nothing before the first."""
    commits = _commits(spark, root)
    last = commits.orderBy(F.desc("number")).first() if commits is not None else None
    return (last.number, dict(last.places)) if last else (0, {})


def publish(spark: SparkSession, root: str, places: Mapping[str, str]) -> int:
    """Make ``places`` (folders below ``root``) the tables of the set, beside those that it has already; returns the number.

    One small file is added by a job commit: readers see all of it or none. One load at a time may publish.
    """
    number, held = published(spark, root)
    row = spark.createDataFrame([(number + 1, {**held, **places})], "number bigint, places map<string, string>")
    row.coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return number + 1


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the set as it was last published."""
    number, places = published(spark, root)
    if name not in places:
        raise KeyError(f"{name} is not among the {len(places)} tables of publication {number}")
    return spark.read.parquet(f"{root}/{places[name]}")


def publish_table(df: DataFrame, root: str, name: str, partition_by: Sequence[str] = ()) -> int:
    """Replace one table of a published set, leaving all others alone. Until the new one is whole, readers get the old one."""
    place = f"tables/{name}-{uuid.uuid4().hex}"
    replace_table(df, f"{root}/{place}", partition_by)
    return publish(df.sparkSession, root, {name: place})


def publish_load(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, order: Mapping[str, Sequence[str]]) -> DataFrame:
    """A keyed load of several tables that is published whole or not at all; returns the constraint report.

    See ``load_tables``. A breach in any table leaves the published set as it was; what was staged
    until then is in no publication.
    """
    stage = f"tables/load-{uuid.uuid4().hex}"
    report = load_tables(spark, tables, f"{root}/{stage}", order)
    publish(spark, root, {name: f"{stage}/{name}" for name in tables})
    return report


def unpublished(spark: SparkSession, root: str) -> list[str]:
    """Folders below ``tables`` that no publication names: left by loads that failed."""
    commits = _commits(spark, root)
    named = set() if commits is None else {p for r in commits.select(F.explode(F.map_values("places")).alias("p")).distinct().collect() for p in (r.p, r.p.rsplit("/", 1)[0])}
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/tables")
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())
    held = [f"tables/{s.getPath().getName()}" for s in files.listStatus(base)] if files.exists(base) else []
    return sorted(p for p in held if p not in named)
