"""Substring deduplication: windows of words that occur anywhere else are taken out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineside.llm.fm_index import FmIndex
from lineside.llm.minhash import WordHashes, mix
from lineside.llm.tables import texts, written
from lineside.session import settle

WINDOW = 35
#: Words of an anchor. A window's anchor is the one of smallest hash in it, so equal windows have equal anchors.
ANCHOR = 6
#: Words of one index at most, before the last anchor's stretches are added.
SHARD_WORDS = 300_000
#: An anchor with more different stretches than this is dealt by windows.
HOT = 500

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of a factor modulo 2^64, as many as asked for."""

    def __init__(self, factor: int):
        self.factor, self.made = factor, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.made) < n:
            self.made = np.concatenate([self.made, self.made * np.uint64(pow(self.factor, len(self.made), 1 << 64))])
        return self.made[:n]


def words_of(text: str | None) -> list[bytes]:
    """bytes.split knows ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def hashed(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return mix(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))


def stretches(w: np.ndarray, up: Powers, down: Powers) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor: first window, number of windows, anchor hash, hash of all their words."""
    n = len(w) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    grams = np.zeros(len(w) - ANCHOR + 1, np.uint64)
    for i in range(ANCHOR):
        grams += w[i:len(grams) + i] * np.uint64(pow(_BASE, i + 1, 1 << 64))
    grams = mix(grams)
    best, width, goal = np.arange(len(grams)), 1, WINDOW - ANCHOR + 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[b] <= grams[a], b, a)  # of equal ones the later

    while 2 * width <= goal:
        best, width = better(best[:-width], best[width:]), 2 * width
    best = better(best[:n], best[goal - width:goal - width + n])
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up(len(w)), dtype=np.uint64)])
    whole = (sums[first + count + WINDOW - 1] - sums[first]) * down(len(w))[first]
    return first, count, grams[best[first]], mix(whole + count.astype(np.uint64))


def _key(doc: Column | str = "doc_id") -> Column:
    return F.coalesce(doc, F.lit(-1)).alias("id")


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows)))) if rows else {c: [] for c in schema.names}, schema=schema)


def anchors(rows: DataFrame) -> DataFrame:
    """Stretches of all documents: ``id, k, place`` (first window x 32 + number of windows)``, anchor, whole``."""
    schema = pa.schema([("id", pa.int64()), ("k", pa.int32()), ("place", pa.int64()), ("anchor", pa.int64()), ("whole", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, up, down = WordHashes(), Powers(_BASE), Powers(_BACK)
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in schema.names]
            for doc, k, text in zip(*(batch.column(c).to_pylist() for c in ("id", "k", "text"))):
                first, count, anchor, whole = stretches(hashed(words_of(text), hashes), up, down)
                for part, values in zip(parts, (np.full(len(first), doc), np.full(len(first), k, np.int32), first * 32 + count,
                                                anchor.view(np.int64), whole.view(np.int64))):
                    part.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p) if p else [], f.type) for p, f in zip(parts, schema)], schema=schema)

    return rows.select("id", "k", "text").mapInArrow(run, "id long, k int, place long, anchor long, whole long")


def fetched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words of wanted stretches: ``anchor, whole, n, at`` (-1: the stretch itself, else one window of it)``, route, body``."""
    per_doc = wanted.groupBy("id", "k").agg(F.collect_list(F.struct("place", "anchor", "whole", "n", "hot")).alias("list"))
    schema = pa.schema([("anchor", pa.int64()), ("whole", pa.int64()), ("n", pa.int64()), ("at", pa.int32()), ("route", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, up = WordHashes(), Powers(_BASE)
        for batch in batches:
            out: list[tuple] = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("list").to_pylist()):
                words = words_of(text)
                for s in found:
                    first, count = divmod(s["place"], 32)
                    own = words[first:first + count + WINDOW - 1]
                    if not s["hot"]:
                        out.append((s["anchor"], s["whole"], s["n"], -1, s["anchor"], b" ".join(own)))
                        continue
                    w = hashed(own, hashes)
                    for i in range(count):
                        route = int(mix((w[i:i + WINDOW] * up(WINDOW)).sum(keepdims=True)).view(np.int64)[0])
                        out.append((s["anchor"], s["whole"], s["n"], i, route, b" ".join(own[i:i + WINDOW])))
                if len(out) > 20_000:
                    yield _table(schema, out)
                    out = []
            yield _table(schema, out)

    # A document that stands in the table twice is read twice; its stretches are told apart later.
    return (rows.select("id", "k", "text").join(per_doc, ["id", "k"])
            .mapInArrow(run, "anchor long, whole long, n long, at int, route long, body binary"))


def repeated_windows(pieces: DataFrame) -> DataFrame:
    """Which windows of ``anchor, whole, route, n, body`` occur twice, as a bit mask: ``anchor, whole, route, mask``.

    Rows are dealt by ``route``, so all copies of a window meet. A task takes them in that order and
    cuts them into shards at changes of the route; each shard is indexed and its own pieces are
    streamed through the index. A piece that occurs more than once is indexed twice, which is all
    that the question needs.
    """
    schema = pa.schema([("anchor", pa.int64()), ("whole", pa.int64()), ("route", pa.int64()), ("mask", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        keys: list[tuple] = []
        pieces: list[np.ndarray] = []
        twice: list[np.ndarray] = []
        held = 0

        def searched() -> pa.RecordBatch:
            masks = FmIndex(pieces + twice).repeated(pieces, WINDOW).tolist() if pieces else []
            return _table(schema, [(*k, m) for k, m in zip(keys, masks) if m])

        for batch in batches:
            for anchor, whole, route, n, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "whole", "route", "n", "body"))):
                if held > SHARD_WORDS and route != keys[-1][2]:
                    yield searched()
                    keys, pieces, twice, held = [], [], [], 0
                keys.append((anchor, whole, route))
                pieces.append(hashed(body.split(), hashes))
                held += len(pieces[-1])
                if n > 1:
                    twice.append(pieces[-1])
        yield searched()

    return (pieces.select("anchor", "whole", "route", "n", "body").repartition("route").sortWithinPartitions("route", "whole")
            .mapInArrow(run, "anchor long, whole long, route long, mask long"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Take out each word that a window of 35 words covers which also starts anywhere else.

    Returns a row for each row of ``docs``: ``doc_id, n_words, n_removed, kept_text`` (kept words
    joined by a space). Windows are judged on the input. Every window has an anchor, its six-word
    run of smallest hash; windows in a row with one anchor form a stretch. Only stretches whose
    anchor occurs again can hold a repeated window; equal ones are counted before they are moved,
    so thousands of copies are one piece. Pieces are dealt to shards by anchor, each shard gets a
    compressed FM-index (a wavelet matrix over the transform), and backward search extends matches
    to the left while they occur twice. So each piece visits the one shard that can hold its
    matches. An anchor with more than 500 different stretches is dealt by whole windows instead.

    A null text has no words. A row that repeats doc_id and text repeats all its windows. Other
    columns are not read; an empty table gives no rows.
    """
    rows = texts(docs).select("doc_id", _key(), F.hash(F.col("text").isNull(), F.col("text")).alias("k"), "text")
    light = written(anchors(rows))
    # Counts are written apart: a join with a plain table may split a common anchor over tasks.
    again = written(light.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    found = written(light.join(again, "anchor", "left_semi").select("id", "k", "place", "anchor", "whole"))
    pieces = settle(found.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(F.struct("id", "k", "place")).alias("x"))
                    .select("anchor", "whole", "n", "x.*"))
    crowded = written(pieces.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("anchor", F.lit(True).alias("hot")))
    wanted = pieces.join(crowded, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    bodies = written(fetched(rows, wanted))
    plain = bodies.where("at < 0").dropDuplicates(["anchor", "whole"])
    single = bodies.where("at >= 0").groupBy("route").agg(F.sum("n").alias("n"), F.first("body").alias("body"))
    none = F.lit(None).cast("long")
    masks = settle(repeated_windows(
        plain.select("anchor", "whole", "route", "n", "body").union(single.select(none, none, "route", "n", "body"))))
    joined = (bodies.where("at >= 0").select("anchor", "whole", "at", "route")
              .join(masks.where("anchor IS NULL").select("route"), "route", "left_semi")
              .groupBy("anchor", "whole").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask")))
    known = masks.where("anchor IS NOT NULL").select("anchor", "whole", "mask").unionByName(joined.select("anchor", "whole", "mask"))
    cuts = (found.join(known, ["anchor", "whole"]).groupBy("id", "k")
            .agg(F.collect_list(F.struct("place", "mask")).alias("cuts")))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "cuts"))):
                words = words_of(text)
                edge = np.zeros(len(words) + 1, np.int64)
                for cut in cuts or []:
                    at, mask = cut["place"] // 32, cut["mask"]
                    for i in range(mask.bit_length()):
                        if mask >> i & 1:
                            edge[at + i] += 1
                            edge[at + i + WINDOW] -= 1
                kept = np.cumsum(edge[:-1]) == 0
                text = b" ".join([w for w, keep in zip(words, kept.tolist()) if keep] if cuts else words)
                out.append((doc, len(words), len(words) - int(kept.sum()), text.decode("utf-8", "surrogatepass")))
            yield _table(schema, out)

    return (rows.join(cuts, ["id", "k"], "left").select("doc_id", "text", "cuts")
            .mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string"))
