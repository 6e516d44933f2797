"""Near-duplicate documents: MinHash signatures in an LSH forest, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineside.llm.components import components, grown
from lineside.llm.tables import text_key, texts, written

SHINGLE = 5
#: Hash functions, trees of the forest, and hashes in a tree's label.
HASHES, TREES, DEPTH = 64, 12, 8
#: Labels agree on so many hashes at least before two documents are compared.
LEAST_DEPTH = 4
#: A run of so many labels at the least depth is compared in full; in a longer one each document
#: meets its nearest labels and the first of each deeper run.
FULL_RUN, NEAREST = 8, 2
#: A run of more than ``FULL_RUN`` labels that still spans several components is compared in full, in
#: pairs of blocks of about so many documents and shingles. A document meets every block of its run once, so
#: large blocks move few texts; two of them take some tens of megabytes.
BLOCK, BLOCK_SHINGLES = 2048, 500_000
#: Trees for thresholds below 85 percent: at 0.80 a pair is missed by all with probability 0.0002.
MORE_TREES = 16
#: Compact signatures that agree on a smaller share are not confirmed: 5 deviations below 0.85.
LEAST_ESTIMATE = 0.62

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(SHINGLE)], np.uint64)
_FACTORS = (np.random.default_rng(8).integers(0, 1 << 63, HASHES, np.uint64) << np.uint64(1)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; of bounded size."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; bytes.lower and bytes.split know ASCII only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = mix(np.fromiter(map(hashes.__getitem__, words), np.uint64, n))
    if n < SHINGLE:
        return mix((w * _WEIGHTS[:n]).sum(keepdims=True) + np.uint64(n))
    total = np.zeros(n - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        total += w[i:n - SHINGLE + 1 + i] * _WEIGHTS[i]
    return np.unique(mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest high halves under ``HASHES`` multiplications."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        made = (_FACTORS[:, None] * shingles[None, at:at + 4096]) >> np.uint64(32)
        low = np.minimum(low, made.min(axis=1).astype(np.uint32))
    return low


def tuned(percent: int) -> tuple[int, float]:
    """Trees and the least estimate for a threshold."""
    share = percent / 100
    return (TREES, LEAST_ESTIMATE) if percent >= 85 else (MORE_TREES, share - 5 * (share * (1 - share) / HASHES) ** 0.5)


def tree_order(tree: int) -> list[int]:
    """The hashes of a tree's label: four that no other tree begins with, then others' in turn."""
    own = [LEAST_DEPTH * tree + i for i in range(LEAST_DEPTH)]
    return own + [(own[-1] + 1 + 7 * i) % HASHES for i in range(DEPTH - LEAST_DEPTH)]


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, k, n_shingles, h1, h2`` (a 128-bit print of the set), ``sig``."""
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("n_shingles", pa.int64()),
                        ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, k, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k", "text"))):
                found = shingle_set(text, hashes)
                prints = [int(mix(found + np.uint64(i)).sum(dtype=np.uint64).astype(np.int64)) for i in (1, 2)]
                rows.append((doc, k, len(found), *prints, signature(found).astype(">u4").tobytes() if len(found) else None))
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows)))) if rows else {c: [] for c in schema.names}, schema=schema)

    return docs.mapInArrow(run, "doc_id long, k long, n_shingles long, h1 long, h2 long, sig binary")


def forest_candidates(classes: DataFrame, percent: int = 85) -> DataFrame:
    """Pairs ``a < b`` of class ids that stand close together in one of the sorted orders, with an estimate.

    Each tree sorts the labels; the sorted rows are split by range on label and id, so equal labels
    may fall in several tasks. A task reads its stretch once: a document meets the documents before
    it whose label begins with the same four hashes. While such a run is short all of it is met;
    in a crowded region only the longest common prefixes (the nearest labels) and the first of each
    run at every depth, so the depth in effect grows with the crowd and the pairs stay linear.
    """
    trees, least = tuned(percent)

    def label(tree: int):
        return F.concat(*(F.substring("sig", 4 * i + 1, 4) for i in tree_order(tree)))

    short = F.concat(*(F.substring("sig", 4 * i + 4, 1) for i in range(HASHES)))
    laid = (classes.select("cid", short.alias("short"), F.explode(F.array(*(
        F.struct(F.lit(t).alias("tree"), label(t).alias("label")) for t in range(trees)))).alias("x"))
        .select("x.tree", "x.label", "cid", "short")
        .repartitionByRange("tree", "label", "cid").sortWithinPartitions("tree", "label", "cid"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("est", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, recent, length, first, seen = None, [], 0, [None] * (DEPTH + 1), set()
        for batch in batches:
            pairs: list[tuple] = []
            for t, lab, cid, short in zip(*(batch.column(c).to_pylist() for c in ("tree", "label", "cid", "short"))):
                entry = (lab, cid, np.frombuffer(short, np.uint8))
                if t != tree or not recent or lab[:4 * LEAST_DEPTH] != recent[-1][0][:4 * LEAST_DEPTH]:
                    tree, recent, length = t, [entry], 1
                    first = [entry] * (DEPTH + 1)
                    continue
                for depth in range(LEAST_DEPTH, DEPTH + 1):
                    if first[depth][0][:4 * depth] != lab[:4 * depth]:
                        first[depth] = entry
                near = recent if length <= FULL_RUN else recent[-NEAREST:] + first[LEAST_DEPTH:]
                for _, other, print_ in {e[1]: e for e in near}.values():
                    if other != cid:
                        pair = (cid, other) if cid < other else (other, cid)
                        if pair not in seen:
                            seen.add(pair)
                            est = (float(np.count_nonzero(entry[2] == print_)) / HASHES - 1 / 256) * 256 / 255
                            if est >= least:
                                pairs.append((*pair, est))
                recent = [*recent[-FULL_RUN:], entry]
                length += 1
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*pairs)))) if pairs else {c: [] for c in schema.names}, schema=schema)

    return laid.mapInArrow(run, "a long, b long, est double").groupBy("a", "b").agg(F.max("est").alias("est"))


def confirmed(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets meet the threshold, as ``va`` and ``vb`` of ``pairs`` under the names ``a`` and ``b``."""
    both = (pairs.select("a", "b", "va", "vb").join(bodies.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
            .join(bodies.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b").select("va", "vb", "text_a", "text_b"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("va", "vb", "text_a", "text_b"))):
                one, two = shingle_set(x, hashes), shingle_set(y, hashes)
                common = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * common >= percent * (len(one) + len(two) - common):
                    rows.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": [r[0] for r in rows], "b": [r[1] for r in rows]}, schema=schema)

    return both.mapInArrow(run, "a long, b long")


def common_shingles(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``."""
    seen, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    bounds = np.searchsorted(at, np.arange(0, len(seen) + width, width))
    total = np.zeros((len(left), len(right)), np.float32)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        held = np.zeros((len(left) + len(right), width), np.float32)
        held[owner[a:b], at[a:b] - i * width] = 1
        total += held[:len(left)] @ held[len(left):].T
    return total.astype(np.int64)


def block_links(block: pa.Table, percent: int) -> pa.Table:
    """Links between two blocks of a crowded run (or within one), as a spanning forest over the components so far.

    A pair that also begins alike in an earlier tree's crowded run is left to that tree.
    """
    get = {c: block.column(c).to_pylist() for c in block.column_names}
    tree, p, q = get["tree"][0], get["p"][0], get["q"][0]
    sigs = np.frombuffer(b"".join(get["sig"]), ">u4").reshape(-1, HASHES).astype(np.uint32)
    own, root, crowds = (np.array(get[c]) for c in ("own", "root", "crowds"))
    left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
    want = np.zeros((len(left), len(right)), bool)
    for i, x in enumerate(left):
        alike = sigs[x] == sigs[right]
        want[i] = (root[x] != root[right]) & (alike.mean(axis=1) >= tuned(percent)[1])
        for t in range(tree):
            if crowds[x] >> t & 1:
                want[i] &= ~alike[:, LEAST_DEPTH * t:LEAST_DEPTH * (t + 1)].all(axis=1)
    if p == q:
        want = np.triu(want, 1)
    rows, columns = np.flatnonzero(want.any(axis=1)), np.flatnonzero(want.any(axis=0))
    links: list[tuple[int, int]] = []
    if len(rows):
        hashes, parent = WordHashes(), {}
        sets = {x: shingle_set(get["text"][x], hashes) for x in {*left[rows].tolist(), *right[columns].tolist()}}
        one, two = [sets[x] for x in left[rows].tolist()], [sets[x] for x in right[columns].tolist()]
        common = common_shingles(one, two)
        total = np.array([len(s) for s in one])[:, None] + np.array([len(s) for s in two])[None] - common

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, j in np.argwhere(want[np.ix_(rows, columns)] & (100 * common >= percent * total)).tolist():
            a, b = left[rows[i]], right[columns[j]]
            if find(root[a]) != find(root[b]):
                parent[find(root[a])] = find(root[b])
                links.append((get["root"][a], get["root"][b]))
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def crowded_links(classes: DataFrame, rows: DataFrame, reach: DataFrame, percent: int) -> DataFrame:
    """The links that are missing between components within crowded runs, as pairs of roots ``a`` and ``b``.

    Runs are counted by component, so a run that is one component costs
    nothing more. The documents of the others are dealt by hash to blocks, those of the run's largest
    component apart, as these need not meet one another; each other pair of blocks of a run is one
    small group, whatever the size of the run.
    """
    of = written(classes.join(reach, F.col("rep") == F.col("v"), "left")
                .select("cid", "rep", "k", "n_shingles", "sig", F.coalesce("root", "rep").alias("root")))
    laid = of.select("cid", "root", "n_shingles", F.posexplode(F.array(*(
        F.substring("sig", 4 * LEAST_DEPTH * t + 1, 4 * LEAST_DEPTH) for t in range(tuned(percent)[0])))).alias("tree", "label"))
    parts = (laid.groupBy("tree", "label", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
             .groupBy("tree", "label").agg(F.max(F.struct("n", "m", "root")).alias("main"), F.sum("n").alias("n"), F.sum("m").alias("m")))

    def blocks(n, m):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(m / BLOCK_SHINGLES)).cast("int")

    runs = (parts.where((F.col("n") > FULL_RUN) & (F.col("main.n") < F.col("n")))
            .select("tree", "label", F.col("main.root").alias("main"), blocks(F.col("main.n"), F.col("main.m")).alias("mains"),
                    blocks(F.col("n") - F.col("main.n"), F.col("m") - F.col("main.m")).alias("others")))
    crowds = (laid.select("cid", "tree", "label").join(runs, ["tree", "label"]).groupBy("cid")
              .agg(F.collect_list(F.struct("tree", "label", "main", "mains", "others")).alias("runs"), F.sum(F.expr("shiftleft(1L, tree)")).alias("crowds")))
    members = written(rows.withColumnRenamed("doc_id", "rep").join(of.join(crowds, "cid"), ["rep", "k"]).dropDuplicates(["cid"])
                      .select("cid", "root", "sig", "text", "crowds", "runs"))
    dealt = (members.select("cid", "root", "sig", "text", "crowds", F.inline("runs"))
             .withColumn("of_main", F.col("root") == F.col("main"))
             .withColumn("own", F.pmod(F.xxhash64("cid"), F.when(F.col("of_main"), F.col("mains")).otherwise(F.col("others")))
                         + F.when(F.col("of_main"), F.col("others")).otherwise(0))
             .withColumn("met", F.explode(F.sequence(F.lit(0), F.when(F.col("of_main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
             .select("tree", "label", F.least("own", "met").alias("p"), F.greatest("own", "met").alias("q"), "own", "root", "sig", "text", "crowds"))
    return dealt.groupBy("tree", "label", "p", "q").applyInArrow(lambda block: block_links(block, percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Components of documents whose 5-word shingle sets have at least ``percent`` % in common.

    Returns a row for each row of ``docs``: ``doc_id, k`` (a key of the text)``, n_shingles,
    component_id, kept``. Equal sets are one class from the start, so thousands of exact copies
    are one entry in every later step. Classes are compared where the forest brings them together
    (a pair at 0.85 begins alike in one of twelve trees with probability 0.9998, one at 0.80 in one of
    sixteen, which thresholds below 85 use); links are confirmed
    on the full sets: first the best candidate below each class, then every candidate whose ends
    are still in different components, which from then on are single vertices. No pair within a component needs confirming after that. Runs
    of equal labels that are too long to be met in full and still hold several components are then
    compared in full, pair of blocks by pair of blocks.

    A text without words, or a null one, has no shingles and is linked with nothing; a text of
    fewer than five words is one shingle. Rows that share a doc_id are one vertex. A null doc_id is
    linked with nothing, has no component and is kept. An empty table gives no rows.
    """
    rows = texts(docs).select("doc_id", "text", text_key().alias("k"))
    made = written(signatures(rows))
    classes = written(made.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2")
                      .agg(F.min(F.struct("doc_id", "k")).alias("least"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
                      .select(F.col("h1").alias("cid"), "h1", "h2", F.col("least.doc_id").alias("rep"), F.col("least.k").alias("k"), "sig", "n_shingles"))
    pairs = written(forest_candidates(classes.select("cid", "sig"), percent))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "rep", "k"), "cid")
    bodies = written(rows.withColumnRenamed("doc_id", "rep").join(wanted, ["rep", "k"]).dropDuplicates(["cid"]).select("cid", "rep", "text"))

    def between(chosen: DataFrame, vertex: DataFrame) -> DataFrame:
        """Pairs of classes with the vertices that stand for them, where these differ."""
        return (chosen.select("a", "b").join(vertex.select(F.col("cid").alias("a"), F.col("v").alias("va")), "a")
                .join(vertex.select(F.col("cid").alias("b"), F.col("v").alias("vb")), "b").where("va <> vb"))

    best = pairs.groupBy("b").agg(F.max(F.struct("est", "a")).alias("x")).select("x.a", "b")
    reach = components(confirmed(between(best, bodies.select("cid", F.col("rep").alias("v"))), bodies, percent))
    roots = (bodies.select("cid", "rep").join(reach, F.col("rep") == F.col("v"), "left")
             .select("cid", F.coalesce("root", "rep").alias("v")))
    reach = grown(reach, confirmed(between(pairs, roots), bodies, percent))
    reach = grown(reach, crowded_links(classes, rows, reach, percent))
    found = (classes.select("h1", "h2", "rep").join(reach, F.col("rep") == F.col("v"), "left")
             .select("h1", "h2", F.coalesce("root", "rep").alias("component_id")))
    # A null or empty set has prints 0 and meets no class.
    out = made.select("doc_id", "k", "n_shingles", "h1", "h2").join(found, ["h1", "h2"], "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return (out.select("doc_id", "k", "n_shingles", alone.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
