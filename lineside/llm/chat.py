"""Chat formatting: layouts are told by a hash of their field paths, brought to canonical turns, and written by a reversible template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineside.llm.tables import bounded_batches

TURN = "array<struct<role:string,text:string>>"
#: Characters of a formatted part, beyond which the next turn begins a new one.
PART_CHARS = 1 << 20

# --- layouts --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """A way to write conversations down: its field paths, its id, and how its turns are taken from a record.

    ``turns`` gives an array of (role, text). With ``order`` a record is one turn, and that column is its place.
    """

    name: str
    paths: tuple[str, ...]
    id: str
    turns: Callable[[Callable[[str], Column]], Column]
    order: str | None = None


def _said(*turns: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(role).alias("role"), text.alias("text")) for role, text in turns))


def _if_told(role: str, text: Column) -> Column:
    """A turn, or none where the text is null or empty."""
    return F.when(F.coalesce(text, F.lit("")) != "", _said((role, text))).otherwise(F.from_json(F.lit("[]"), TURN))


def _listed(items: Column, role: str, text: str, names: dict[str, str] | None = None) -> Column:
    def one(item: Column) -> Column:
        said = item[role]
        for old, new in (names or {}).items():
            said = F.when(item[role] == old, new).otherwise(said)
        return F.struct(said.alias("role"), item[text].alias("text"))

    return F.coalesce(F.transform(items, one), F.from_json(F.lit("[]"), TURN))


def _instructed(get: Callable[[str], Column]) -> Column:
    asked = F.concat_ws("\n\n", get("instruction"), F.when(F.coalesce(get("input"), F.lit("")) != "", get("input")))
    return _said(("user", asked), ("assistant", get("output")))


#: Other names of roles.
SPEAKERS = {"human": "user", "gpt": "assistant"}
LAYOUTS = (
    Layout("turn rows", ("conv_id", "role", "text", "turn"), "conv_id", lambda get: F.array(F.struct(get("role").alias("role"), get("text").alias("text"))), "turn"),
    Layout("messages", ("id", "messages[].content", "messages[].role"), "id", lambda get: _listed(get("messages"), "role", "content")),
    Layout("speakers", ("conversations[].from", "conversations[].value", "id"), "id", lambda get: _listed(get("conversations"), "from", "value", SPEAKERS)),
    Layout("speakers with system", ("conversations[].from", "conversations[].value", "id", "system"), "id",
           lambda get: F.concat(_if_told("system", get("system")), _listed(get("conversations"), "from", "value", SPEAKERS))),
    Layout("prompt and completion", ("completion", "id", "prompt"), "id", lambda get: _said(("user", get("prompt")), ("assistant", get("completion")))),
    Layout("prompt and response", ("id", "prompt", "response"), "id", lambda get: _said(("user", get("prompt")), ("assistant", get("response")))),
    Layout("system, prompt and response", ("id", "prompt", "response", "system"), "id",
           lambda get: F.concat(_if_told("system", get("system")), _said(("user", get("prompt")), ("assistant", get("response"))))),
    Layout("instruction", ("id", "instruction", "output"), "id", lambda get: _said(("user", get("instruction")), ("assistant", get("output")))),
    Layout("instruction with input", ("id", "input", "instruction", "output"), "id", _instructed),
)
#: Every field that a layout may name; others say nothing about the layout.
FIELDS = ("conv_id long, turn long, role string, text string, id long, messages array<struct<role:string,content:string>>, "
          "conversations array<struct<from:string,value:string>>, system string, prompt string, completion string, response string, "
          "instruction string, input string, output string")
VOCABULARY = sorted({p for layout in LAYOUTS for p in layout.paths})


def fingerprint(paths: list[str]) -> str:
    """A hash of those nested field paths that any layout knows."""
    return hashlib.sha256(",".join(sorted(set(paths) & set(VOCABULARY))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(list(layout.paths)): layout for layout in LAYOUTS}


def schema_paths(kind: T.DataType, above: str = "") -> list[str]:
    """Nested field paths of a schema: ``messages[].role``."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, above + "[]")
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{above}.{f.name}" if above else f.name)]
    return [above]


def layout_of(df: DataFrame) -> Layout:
    """The layout of a typed table, by the fingerprint of its schema; columns that no layout knows are passed over."""
    found = BY_FINGERPRINT.get(fingerprint(schema_paths(df.schema)))
    if found is None:
        raise ValueError(f"no layout has the fields {schema_paths(df.schema)}")
    return found


def _turn_rows(df: DataFrame, conv: Column, place: Column, turns: Column) -> DataFrame:
    exploded = df.select(conv.cast("long").alias("conv_id"), place.cast("long").alias("place"), F.posexplode(turns).alias("position", "said"))
    return exploded.select("conv_id", "place", "position", F.coalesce("said.role", F.lit("")).alias("role"), F.coalesce("said.text", F.lit("")).alias("text"))


def canonical_turns(df: DataFrame) -> DataFrame:
    """Turns of a typed table in any known layout: ``conv_id, place, position, role, text``.

    Turns of a conversation are ordered by ``place`` (nulls first) and ``position``. Null roles and texts
    count as empty; a null id is a conversation of its own; an empty table gives no rows. A table whose
    fields no layout has is refused.
    """
    layout = layout_of(df)
    return _turn_rows(df, F.col(layout.id), F.col(layout.order) if layout.order else F.lit(0), layout.turns(lambda c: F.col(c).cast(_kind(c))))


def _kind(field: str) -> T.DataType:
    return T.StructType.fromDDL(FIELDS)[field].dataType


def with_layouts(records: DataFrame, column: str = "record") -> DataFrame:
    """JSON records with the ``layout`` each is written in (null if unknown) and ``fields``, its known fields parsed.

    A record's paths are the keys at its top and those of the first element of each list of turns, so records of one table
    may differ. A field that is null still counts as present.
    """
    text = F.col(column).cast("string")
    lists = [f.name for f in T.StructType.fromDDL(FIELDS).fields if isinstance(f.dataType, T.ArrayType)]

    def keys(json: Column, above: str) -> Column:
        found = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
        return F.transform(found, lambda key: F.concat(F.lit(above), key))

    inner = [keys(F.get_json_object(text, f"$.{c}[0]"), f"{c}[].") for c in lists]
    top = keys(text, "")
    known = F.array(*map(F.lit, VOCABULARY))
    paths = F.array_sort(F.array_distinct(F.array_intersect(F.concat(top, *inner), known)))
    print_ = F.sha2(F.encode(F.concat_ws(",", paths), "UTF-8"), 256)
    name = F.lit(None).cast("string")
    for key, layout in BY_FINGERPRINT.items():
        name = F.when(F.col("_print") == key, layout.name).otherwise(name)
    return records.select(F.col(column)).withColumn("_print", print_).select(
        column, name.alias("layout"), F.from_json(text, FIELDS).alias("fields"))


def canonical_turns_of_records(records: DataFrame, column: str = "record") -> DataFrame:
    """Turns of JSON records, each in any known layout; like ``canonical_turns``.

    Records in no known layout (null, broken or strange ones) have no turns; ``with_layouts`` shows them, with a null layout.
    """
    got = with_layouts(records, column)
    turns, conv, place = F.from_json(F.lit("[]"), TURN), F.lit(None).cast("long"), F.lit(0).cast("long")
    for layout in LAYOUTS:
        here = F.col("layout") == layout.name
        turns = F.when(here, layout.turns(lambda c: F.col(f"fields.{c}"))).otherwise(turns)
        conv = F.when(here, F.col(f"fields.{layout.id}")).otherwise(conv)
        if layout.order:
            place = F.when(here, F.col(f"fields.{layout.order}")).otherwise(place)
    return _turn_rows(got, conv, place, turns)


# --- template -------------------------------------------------------------------------------

#: A turn is written ``### role: text</turn>`` and a line feed.
HEAD, MIDDLE, CLOSE = "### ", ": ", "</turn>"
#: What a backslash is put before in texts; in roles also the colon that ends them.
CONTROLS = (r"\\", HEAD, CLOSE)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def _escaped(text: Column, *more: str) -> Column:
    return F.regexp_replace(text, f"({'|'.join((*CONTROLS, *more))})", r"\\$1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_chats(turns: DataFrame, part_chars: int = PART_CHARS, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Conversations as text, with the spans that a loss is taken over.

    ``turns`` as ``canonical_turns`` gives them. Returns ``conv_id, part, formatted, loss`` (an array of ``start`` and ``end`` in
    code points of ``formatted``, a span for each text by a role in ``learn``)``, n_turns``. A conversation is one
    part; one that grows beyond ``part_chars`` goes on in further parts, cut between turns, so the memory needed is that of
    a part, whatever the conversation. Rows with the same place and position are taken by role and text. An empty table gives no rows.
    """
    bounded_batches(turns.sparkSession)
    pieces = (turns.select("conv_id", "place", "position", "role", "text")
              .repartition("conv_id").sortWithinPartitions(*(F.asc_nulls_first(c) for c in ("conv_id", "place", "position", "role", "text")))
              .select("conv_id", F.col("role").isin(*learn).alias("learnt"),
                      F.concat(F.lit(HEAD), _escaped(F.col("role"), ":"), F.lit(MIDDLE)).alias("head"), _escaped(F.col("text")).alias("body")))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", span), ("n_turns", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, text, size, loss, n, out = (), 0, [], 0, [], 0, []

        def close() -> None:
            out.append((now[0], part, "".join(text), loss, n))

        for batch in batches:
            for conv, learnt, head, body in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "learnt", "head", "body"))):
                if n and (now != (conv,) or size > part_chars):
                    close()
                    part = part + 1 if now == (conv,) else 0
                    text, size, loss, n = [], 0, [], 0
                now = (conv,)
                if learnt:
                    loss.append({"start": size + len(head), "end": size + len(head) + len(body)})
                piece = f"{head}{body}{CLOSE}\n"
                text.append(piece)
                size, n = size + len(piece), n + 1
            yield _batch(out, schema)
            out = []
        if n:
            close()
        yield _batch(out, schema)

    return pieces.mapInArrow(run, "conv_id long, part long, formatted string, loss array<struct<start:long,end:long>>, n_turns long")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows)))) if rows else {c: [] for c in schema.names}, schema=schema)


def _unescaped_at(text: str, mark: str, at: int) -> int:
    """Where ``mark`` next stands without a backslash of its own before it."""
    while True:
        found = text.find(mark, at)
        if found < 0:
            raise ValueError(f"no {mark!r} ends the turn")
        slash = found
        while slash > at and text[slash - 1] == "\\":
            slash -= 1
        if (found - slash) % 2 == 0:
            return found
        at = found + 1


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of a formatted part: role and text as they were."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise ValueError(f"no turn begins at {at}")
        middle = _unescaped_at(formatted, ":", at + len(HEAD))
        body = middle + len(MIDDLE)
        end = _unescaped_at(formatted, CLOSE, body)
        yield unescape(formatted[at + len(HEAD):middle]), unescape(formatted[body:end])
        at = end + len(CLOSE) + 1


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """What formatted conversations say, read from their text and spans alone: a row per conversation.

    Returns ``conv_id, n_turns, turns_sha256`` (role and text of each turn, a line feed after each)``, loss_chars`` (code points
    under the loss spans, escapes undone)``, loss_sha256, formatted_chars``. ``in_order`` is for rows that come straight
    from ``format_chats``; others are brought together by conversation and sorted by part.
    """
    bounded_batches(formatted.sparkSession)
    rows = formatted.select("conv_id", "part", "formatted", "loss")
    if not in_order:
        rows = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema([(c, pa.string() if c.endswith("sha256") else pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = (), []

        def close() -> None:
            out.append((now[0], n, turns.hexdigest(), chars, learnt.hexdigest(), size))

        for batch in batches:
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if now != (conv,):
                    if now:
                        close()
                    now, n, chars, size, turns, learnt = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for span in spans:
                    said = unescape(text[span["start"]:span["end"]])
                    learnt.update(said.encode("utf-8", "surrogatepass"))
                    chars += len(said)
                size += len(text)
            yield _batch(out, schema)
            out = []
        if now:
            close()
        yield _batch(out, schema)

    return rows.mapInArrow(run, ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in names))
