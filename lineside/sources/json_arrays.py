"""Scan of JSON files that hold one large array, cut by byte ranges.

Spark splits a text file anywhere; whether a brace is inside a text, and how deep it lies, depends on all
that comes before. So every split is first reduced to what it does to that state, for either way it may begin
(inside a text or not). These few numbers for each split are put together in order; then each split knows how it begins
and cuts out the elements on its own. Only elements that cross a border are put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What matters to the state: quotes, backslash with what it escapes, brackets.
_MARK = re.compile(r'\\.|["{}\[\]]', re.DOTALL)
_ENDS = "}"  # fragments end at this character, which no escape can begin with


def walk(text: str, inside: bool, depth: int) -> tuple[bool, int]:
    """State after ``text``: within a quoted text or not, and how deep."""
    for mark in _MARK.findall(text):
        if mark == '"':
            inside = not inside
        elif not inside and mark in "{[":
            depth += 1
        elif not inside and mark in "}]":
            depth -= 1
    return inside, depth


def cut(text: str, inside: bool, depth: int) -> Iterator[tuple[int, int]]:
    """Borders of the elements within ``text``: positions with +1 where an element (at depth 1) opens and -1 behind its end."""
    for found in _MARK.finditer(text):
        mark = found.group()
        if mark == '"':
            inside = not inside
        elif not inside and mark in "{[":
            if depth == 1:
                yield found.start(), 1
            depth += 1
        elif not inside and mark in "}]":
            depth -= 1
            if depth == 1:
                yield found.end(), -1


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of one array per file, typed by ``schema``; ``path`` may name several files.

    Rows equal those of Spark's multi-line reader for valid files whose arrays hold objects, but a file is read by as many
    tasks as it has splits. Files must be UTF-8. An element that crosses splits is put together in the
    task of its number; an element itself must fit in memory.
    """
    lines = spark.read.option("lineSep", _ENDS).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    states = pa.schema([("file", pa.string()), ("start", pa.int64()), ("quoted_out", pa.bool_()), ("quoted_by", pa.int64()), ("plain_out", pa.bool_()), ("plain_by", pa.int64())])

    def effect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, quoted, plain, out = None, (True, 0), (False, 0), []
        for batch in batches:
            for value, file, start in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start"))):
                if now != (file, start):
                    if now:
                        out.append((*now, *quoted, *plain))
                    now, quoted, plain = (file, start), (True, 0), (False, 0)
                quoted, plain = walk(value + _ENDS, *quoted), walk(value + _ENDS, *plain)
        if now:
            out.append((*now, *quoted, *plain))
        yield pa.RecordBatch.from_pydict(dict(zip(states.names, map(list, zip(*out)))) if out else {c: [] for c in states.names}, schema=states)

    splits = lines.mapInArrow(effect, "file string, start long, quoted_out boolean, quoted_by long, plain_out boolean, plain_by long")
    known, state = {}, (None, False, 0)
    # One row for each split, as the scan's own list of splits has it.
    for r in splits.orderBy("file", "start").collect():
        inside, depth = state[1:] if state[0] == r.file else (False, 0)
        known[r.file, r.start] = inside, depth
        state = (r.file, *((r.quoted_out, depth + r.quoted_by) if inside else (r.plain_out, depth + r.plain_by)))
    shared = spark.sparkContext.broadcast(known)
    parts = pa.schema([("file", pa.string()), ("start", pa.int64()), ("head", pa.bool_()), ("open", pa.bool_()), ("text", pa.string())])

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole elements (no head, not open), the rest of one that began earlier (head), and the beginning of one that goes on (open)."""
        now, inside, depth, held, head, out = None, False, 0, [], False, []

        def close() -> None:
            if now and held:
                out.append((*now, head, True, "".join(held)))

        for batch in batches:
            for value, file, start in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start"))):
                if now != (file, start):
                    close()
                    now, (inside, depth) = (file, start), shared.value[file, start]
                    held, head = [], depth > 1
                text, at = value + _ENDS, 0
                taken = depth > 1
                for place, step in cut(text, inside, depth):
                    if step > 0:
                        at, taken = place, True
                    else:
                        out.append((file, start, head, False, "".join([*held, text[at:place]])))
                        held, head, taken = [], False, False
                if taken:
                    held.append(text[at:])
                inside, depth = walk(text, inside, depth)
            yield pa.RecordBatch.from_pydict(dict(zip(parts.names, map(list, zip(*out)))) if out else {c: [] for c in parts.names}, schema=parts)
            out = []
        close()
        yield pa.RecordBatch.from_pydict(dict(zip(parts.names, map(list, zip(*out)))) if out else {c: [] for c in parts.names}, schema=parts)

    found = lines.mapInArrow(elements, "file string, start long, head boolean, open boolean, text string")
    whole = found.where("NOT head AND NOT open").select("text")
    # A piece belongs to the element that opened last before it; there is at most one of each kind for a split.
    before = Window.partitionBy("file").orderBy("start", F.col("head").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = found.where("head OR open").withColumn("element", F.max(F.when(~F.col("head"), F.col("start"))).over(before))
    joined = crossing.groupBy("file", "element").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"))
    return whole.unionByName(joined.select("text")).select(F.from_json("text", schema).alias("x")).select("x.*")
