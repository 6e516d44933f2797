"""Toxicity: a logistic model that is held to the same score when identity terms are swapped."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineside.llm.tables import held_out, per_batch, sampled, texts
from lineside.session import settle

THRESHOLD = 0.3
#: Words count by themselves and by their first letters, so that inflected forms share a feature.
PREFIXES = (4, 5)

# Groups of people; a term is swapped for another of its set.
IDENTITY_SETS = tuple(tuple(x.split()) for x in (
    "women men girls boys", "woman man girl boy", "muslim christian jewish hindu buddhist atheist",
    "muslims christians jews hindus buddhists atheists", "black white asian latino african european",
    "gay straight lesbian bisexual transgender", "immigrant refugee foreigner native",
    "immigrants refugees foreigners natives", "mujeres hombres", "musulmanes cristianos judíos",
    "femmes hommes", "musulmans chrétiens juifs", "frauen männer", "muslime christen juden", "homosexuell heterosexuell",
    "disabled deaf blind autistic"))
SWAPS = {term: tuple(t for t in terms if t != term) for terms in IDENTITY_SETS for term in terms}

_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """Features of what stands between white space: its words and their beginnings."""
    found = []
    for w in _LETTERS.findall(word):
        found.append(w)
        found += [f"{w[:n]}*" for n in PREFIXES if len(w) > n]
    return found


def features(text: str) -> set[str]:
    return {f for word in set(text.lower().split()) for f in word_features(word)}


def swapped(found: set[str], pick: int) -> set[str]:
    """The features after every identity term has been replaced by another of its set."""
    terms = [t for t in found if t in SWAPS]
    new = {f for t in terms for f in word_features(SWAPS[t][pick % len(SWAPS[t])])}
    return (found - {f for t in terms for f in word_features(t)}) | new


def feature_counts(train: DataFrame, flush: int = 400_000) -> DataFrame:
    """In how many toxic and other documents each feature occurs: ``feature, toxic, clean``."""
    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def flushed() -> Iterator[pa.RecordBatch]:
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_pydict({"feature": names, "toxic": [seen[1][f] for f in names],
                                              "clean": [seen[0][f] for f in names]}, schema=schema)
            for c in seen:
                c.clear()

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[toxic].update(features(text))
            if len(seen[0]) + len(seen[1]) > flush:
                yield from flushed()
        yield from flushed()

    return (train.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long")
            .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def fit_weights(rows: list[np.ndarray], twins: list[tuple[int, np.ndarray]], labels: np.ndarray, size: int,
                ridge: float = 1.0, fairness: float = 4.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept: logistic loss + ``ridge`` + ``fairness`` x squared change of a swapped twin's logit."""
    n = len(rows)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    cols = np.concatenate(rows) if n else np.zeros(0, np.int64)
    own = [rows[i] for i, _ in twins]
    t_at = np.repeat(np.arange(len(twins)), [len(a) + len(b) for a, (_, b) in zip(own, twins)]).astype(np.int64)
    t_cols = np.concatenate([np.concatenate([a, b]) for a, (_, b) in zip(own, twins)]) if twins else np.zeros(0, np.int64)
    t_sign = np.concatenate([np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, (_, b) in zip(own, twins)]) if twins else np.zeros(0)
    share = (labels.sum() + 0.5) / (n + 1)
    w, bias = np.zeros(size), math.log(share / (1 - share))
    speed, bias_speed = np.full(size, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[cols], n) + bias, -30, 30)))
        gap = p - labels
        grad = np.bincount(cols, gap[at], size) + ridge * w
        if twins:
            change = np.bincount(t_at, t_sign * w[t_cols], len(twins))
            grad += 2 * fairness * np.bincount(t_cols, t_sign * change[t_at], size)
        speed += grad * grad
        bias_speed += gap.sum() ** 2
        w -= 0.3 * grad / np.sqrt(speed)
        bias -= 0.3 * gap.sum() / math.sqrt(bias_speed)
    return w, bias


class Model:
    """The features with a weight, and the intercept."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, found: set[str]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + math.fsum(sorted(self.weights[f] for f in found))))))


def fit(train: DataFrame, vocabulary: int) -> Model:
    """Choose features by their counts, then fit their weights in one task over the bounded sample."""
    train = settle(train)
    counts = settle(feature_counts(train))
    sizes = train.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    toxic, clean = sizes.t or 0, sizes.c or 0
    if not toxic:  # nothing to learn from
        return Model({}, -3.0)
    share = (toxic + 1) / (toxic + clean + 2)
    seen = F.col("toxic") + F.col("clean")
    # How far the count in toxic documents is from its share, in deviations.
    far = (F.col("toxic") - share * seen) / F.sqrt(share * (1 - share) * seen)
    top = [r.feature for r in counts.where(seen >= 3).orderBy(F.desc(F.abs(far)), "feature").limit(vocabulary).collect()]
    names = sorted({*top, *(f for t in SWAPS for f in word_features(t))})
    shared = train.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    laid_schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("own", pa.list_(pa.int32())), ("twins", pa.list_(pa.list_(pa.int32())))])

    def lay(batch: pa.RecordBatch) -> dict[str, list]:
        index, own, twins = shared.value, [], []
        for text in batch.column("text").to_pylist():
            found = features(text)
            own.append(sorted(index[f] for f in found if f in index))
            named = any(f in SWAPS for f in found)
            twins.append([sorted(index[f] for f in swapped(found, i) if f in index) for i in range(2)] if named else [])
        return {"doc_id": batch.column("doc_id").to_pylist(), "toxic": batch.column("toxic").to_pylist(), "own": own, "twins": twins}

    model_schema = pa.schema([("weights", pa.list_(pa.float64())), ("bias", pa.float64())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "own", "twins")))),
                      key=lambda r: (r[0], r[1], r[2]))
        rows = [np.array(r[2], np.int64) for r in data]
        twins = [(i, np.array(t, np.int64)) for i, r in enumerate(data) for t in r[3]]
        w, bias = fit_weights(rows, twins, np.array([r[1] for r in data], float), len(shared.value))
        yield pa.RecordBatch.from_pydict({"weights": [w.tolist()], "bias": [float(bias)]}, schema=model_schema)

    laid = train.select("doc_id", "text", "toxic").mapInArrow(
        per_batch(laid_schema, lay), "doc_id long, toxic int, own array<int>, twins array<array<int>>")
    got = laid.repartition(1).mapInArrow(solve, "weights array<double>, bias double").first()
    weights = got.weights if got else [0.0] * len(names)
    return Model({f: w for f, w in zip(names, weights) if abs(w) > 1e-6}, got.bias if got else -3.0)


class _Known(dict):
    """What stands between white space -> its features that have a weight."""

    def __init__(self, weights: dict[str, float], most: int = 200_000):
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > self.most:
            self.clear()
        self[word] = found = tuple(f for f in word_features(word) if f in self.weights)
        return found


def learn(docs: DataFrame, labels: DataFrame, sample: int = 8_000, vocabulary: int = 3_000) -> Model:
    """A model from about ``sample`` labelled documents that are not held out, chosen by a hash of doc_id.

    Several labels of one document count as toxic if any does. The chosen ids and labels (at most
    twice the sample) are broadcast, so texts are not shuffled.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    chosen = sampled(settle(known), sample, 4)
    train = texts(docs).join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    return fit(train.select("doc_id", "text", "toxic"), vocabulary)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 8_000, vocabulary: int = 3_000) -> DataFrame:
    """The toxicity of every whole text: ``doc_id, held_out, score, predicted`` (1 from 0.3 on).

    Features are the words of a text and their first four and five letters, each counted once. The
    ``vocabulary`` with the clearest counts gets weights by logistic regression; for each training
    text that names a group of people, twins with the terms swapped are made, and a change of the
    score between a text and its twin is penalised, so that a neutral mention of a group does not
    by itself make a text toxic.

    A null or empty text has the score of no features. Repeated rows are each scored. Without any
    label nothing is toxic; an empty table gives no rows; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample, vocabulary))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    state: dict[str, _Known] = {}

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        known = state.setdefault("known", _Known(model.value.weights))
        scores = [model.value.score({f for found in map(known.__getitem__, set((t or "").lower().split())) for f in found})
                  for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id").to_pylist(), "held_out": batch.column("held_out").to_pylist(),
                "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}

    return (texts(docs).select("doc_id", "text", held_out().alias("held_out"))
            .mapInArrow(per_batch(schema, work), "doc_id long, held_out boolean, score double, predicted int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; nothing is shuffled."""
    texts(docs)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(model.value.weights)
        for batch in batches:
            keep = [model.value.score({f for found in map(known.__getitem__, set((t or "").lower().split())) for f in found}) < THRESHOLD
                    for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
