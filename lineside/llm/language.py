"""Language identification: words first, then shorter and shorter character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineside.llm.tables import held_out, per_batch, sampled, texts
from lineside.session import settle

_LETTERS = regex.compile(r"\p{L}+")
LONGEST = 4


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between marks for its two ends."""
    marked = f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def gram_counts(train: DataFrame, flush: int = 200_000) -> DataFrame:
    """Per language, how often each word (``n`` = 0) and n-gram occurs: ``lang, n, gram, c``."""
    schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("gram", pa.string()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def flushed() -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for (lang, word), c in words.items():
                found[lang, 0, word] += c
                for n in range(1, LONGEST + 1):
                    for gram in grams(word, n):
                        found[lang, n, gram] += c
            words.clear()
            rows = list(found)
            yield pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "n": [r[1] for r in rows], "gram": [r[2] for r in rows],
                                              "c": list(found.values())}, schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words.update((lang, w) for w in _LETTERS.findall(text.lower()))
            if len(words) > flush:
                yield from flushed()
        yield from flushed()

    return train.mapInArrow(run, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))


class Model:
    """Per-language log frequencies: a row of ``matrix`` for each known word (``tables[0]``) and n-gram."""

    def __init__(self, langs: list[str], tables: list[dict[str, int]], matrix: np.ndarray):
        self.langs, self.tables, self.matrix = langs, tables, matrix

    def rows(self, word: str) -> list[int]:
        """The word's own row, or those of its longest n-grams of which any is known."""
        if word in self.tables[0]:
            return [self.tables[0][word]]
        for n in range(LONGEST, 0, -1):
            table = self.tables[n]
            known = [table[g] for g in grams(word, n) if g in table]
            if known:
                return known
        return []

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for each word: its own, or the mean over its n-grams; zeros if none is known."""
        found = [self.rows(w) for w in words]
        counts = np.array([len(f) for f in found], np.int64)
        out = np.zeros((len(words), len(self.langs)))
        at = np.cumsum(counts) - counts
        some = counts > 0
        if some.any():
            flat = self.matrix[np.fromiter((i for f in found for i in f), np.int64, int(counts.sum()))]
            out[some] = np.add.reduceat(flat, at[some], axis=0) / counts[some, None]
        return out


def fit(train: DataFrame, words: int = 60_000, per_n: int = 20_000) -> Model:
    """A model of at most ``words`` words and ``per_n`` n-grams of each length, the most frequent ones."""
    counts = settle(gram_counts(train))
    totals = {(r.lang, r.n): r.s for r in counts.groupBy("lang", "n").agg(F.sum("c").alias("s")).collect()}
    langs = sorted({lang for lang, _ in totals})
    rows = counts.groupBy("n", "gram").agg(F.sum("c").alias("all"), F.collect_list(F.struct("lang", "c")).alias("by"))
    tables: list[dict[str, int]] = []
    parts: list[np.ndarray] = []
    for n in range(LONGEST + 1):
        top = rows.where(F.col("n") == n).orderBy(F.desc("all"), "gram").limit(per_n if n else words)
        table = {r.gram: {lang: c for lang, c in r.by} for r in top.collect()}
        base = np.array([totals.get((lang, n), 0) + 0.5 * len(table) for lang in langs])
        first = sum(map(len, tables))
        tables.append({g: first + i for i, g in enumerate(table)})
        parts.append(np.log((np.array([[by.get(lang, 0) for lang in langs] for by in table.values()]).reshape(len(table), len(langs)) + 0.5) / base))
    return Model(langs, tables, np.concatenate(parts))


class _Rows(dict):
    """Word between white space -> row of ``matrix`` with its log frequencies; row 0 has no letter."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.matrix, self.used = np.zeros((1024, len(self.model.langs))), 1

    def load(self, words: set[str]) -> None:
        """Score what is new, all at once."""
        if len(self) > self.most:
            self._reset()
        fresh = {w: _LETTERS.findall(w) for w in words if w not in self}
        lettered = {w: found for w, found in fresh.items() if found}
        self.update(dict.fromkeys(fresh, 0))
        if not lettered:
            return
        flat = self.model.scores([w for found in lettered.values() for w in found])
        counts = np.array([len(found) for found in lettered.values()])
        while self.used + len(lettered) > len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[self.used:self.used + len(lettered)] = np.add.reduceat(flat, np.cumsum(counts) - counts, axis=0)
        self.update(zip(lettered, range(self.used, self.used + len(lettered))))
        self.used += len(lettered)


def identify(docs: DataFrame, sample: int = 6_000) -> DataFrame:
    """The language of every whole text: ``doc_id, held_out, lang_pred, score``.

    Learns from about ``sample`` rows with a text and a ``lang`` that are not held out (all of them,
    if there are no more), chosen by a hash of doc_id. A known word scores by its log frequency in
    each language; an unseen one by the longest n-grams of it, from four characters down to one, of
    which any is known. ``score`` is the posterior of the best language under equal priors.

    ``und`` with score 0 for a null text, a text without a letter, or when nothing could be learned.
    Equal scores go to the first language by name. Repeated rows are each returned, and learned
    from as often as they occur; an empty table gives no rows; other columns are not read.
    """
    rows = texts(docs, F.col("lang").cast("string").alias("lang"))
    train = rows.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = fit(settle(sampled(train, sample, 2)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    state: dict[str, _Rows] = {}

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        model = shared.value
        known = state.setdefault("rows", _Rows(model)) if model.langs else None
        preds, scores = [], []
        split = [(text or "").lower().split() for text in batch.column("text").to_pylist()]
        if known is not None:
            known.load(set().union(*split))
        for words in split:
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words)) if known is not None else np.zeros(0, int)
            if not at.any():
                preds.append("und")
                scores.append(0.0)
                continue
            total = known.matrix[at].sum(axis=0)
            best = int(np.argmax(total))
            preds.append(model.langs[best])
            scores.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
        return {"doc_id": batch.column("doc_id").to_pylist(), "held_out": batch.column("held_out").to_pylist(),
                "lang_pred": preds, "score": scores}

    return (rows.select("doc_id", "text", held_out().alias("held_out"))
            .mapInArrow(per_batch(schema, work), "doc_id long, held_out boolean, lang_pred string, score double"))
