"""Near-duplicate embeddings: a navigable small-world graph per shard, every shard queried, links verified."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineside.llm.components import components
from lineside.session import settle

#: Distinct vectors in a shard at most (a hash deals them out, so about); links per vector and layer.
SHARD, DEGREE = 8192, 12
#: Beam while building, first beam of a query, and the widest: a query that needs more scans its shard,
#: which costs less than such a walk.
BUILD_BEAM, FIRST_BEAM, WIDEST_BEAM = 32, 32, 64
#: Queries that each audit compares with a full scan, and the recall of links that it asks for.
AUDITED, RECALL = 128, 0.995
BLOCK = 256


class Graph:
    """Layers of neighbour lists over unit vectors. All steps work on blocks of queries at once."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit.astype(np.float32)
        n = len(unit)
        draw = np.random.default_rng(7).random(n)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(DEGREE)).astype(int), 6)
        self.nodes = [np.flatnonzero(level >= at) for at in range(level.max() + 1)] if n else []
        self.near = [np.full((n, 2 * DEGREE), -1, np.int32) for _ in self.nodes]
        for at in range(len(self.nodes) - 1, -1, -1):
            self._build(at)

    def beam(self, at: int, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes of layer ``at`` for each query, from ``start`` nodes: ids and cosines."""
        rows = np.arange(len(queries))[:, None]
        ids = np.full((len(queries), width), -1, np.int32)
        sims = np.full((len(queries), width), -np.inf, np.float32)
        ids[:, :start.shape[1]] = start[:, :width]
        sims[:, :start.shape[1]] = np.where(start >= 0, np.einsum("bd,bkd->bk", queries, self.unit[start]), -np.inf)[:, :width]
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = ids[rows, order], sims[rows, order]
        done = ids < 0
        while not done.all():
            live = np.flatnonzero(~done.all(axis=1))
            pick = np.argsort(done[live], axis=1, kind="stable")[:, :4]  # the best that are not yet expanded
            fresh = ~done[live[:, None], pick]
            done[live[:, None], pick] = True
            found = np.where(fresh[:, :, None], self.near[at][ids[live[:, None], pick]], -1).reshape(len(live), -1)
            found = np.sort(found, axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[(found[:, :, None] == ids[live][:, None, :]).any(axis=2)] = -1
            cos = np.where(found >= 0, np.einsum("bd,bkd->bk", queries[live], self.unit[found]), -np.inf)
            all_sims = np.concatenate([sims[live], cos], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            at_rows = np.arange(len(live))[:, None]
            ids[live] = np.concatenate([ids[live], found], axis=1)[at_rows, best]
            done[live] = np.concatenate([done[live], found < 0], axis=1)[at_rows, best]
            sims[live] = all_sims[at_rows, best]
            ids[live] = np.where(np.isfinite(sims[live]), ids[live], -1)
            done[live] |= ids[live] < 0
        return ids, sims

    def entry(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        """Start nodes in layer ``down_to``: the best of a short beam through each layer above."""
        top = self.nodes[-1][:8]
        start = np.repeat(top[None, :], len(queries), axis=0)
        for at in range(len(self.nodes) - 1, down_to, -1):
            start = self.beam(at, queries, start, 8)[0]
        return start

    def _build(self, at: int) -> None:
        nodes, near = self.nodes[at], self.near[at]
        placed = 0
        while placed < len(nodes):
            take = nodes[placed:placed + max(16, min(BLOCK, placed))]
            q = self.unit[take]
            if placed:
                start = self.entry(q, at) if at + 1 < len(self.nodes) else np.repeat(nodes[None, :1], len(take), axis=0)
                ids, _ = self.beam(at, q, start, BUILD_BEAM)
            else:
                ids = np.zeros((len(take), 0), np.int32)
            # Those inserted together see each other too.
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            among = take[np.argsort(-own, axis=1, kind="stable")[:, :min(8, len(take) - 1)]] if len(take) > 1 else np.zeros((1, 0), int)
            self._link(near, take, np.concatenate([ids, among], axis=1))
            placed += len(take)

    def _link(self, near: np.ndarray, take: np.ndarray, found: np.ndarray) -> None:
        near[take, :DEGREE] = self._spread(take, found, DEGREE)
        back: dict[int, list[int]] = {}
        for node, row in zip(take.tolist(), near[take, :DEGREE].tolist()):
            for other in row:
                if other >= 0:
                    back.setdefault(other, []).append(node)
        if not back:
            return
        most = max(map(len, back.values()))
        others = np.array(list(back), np.int64)
        more = np.array([v + [-1] * (most - len(v)) for v in back.values()], np.int64)
        near[others] = self._spread(others, np.concatenate([near[others], more], axis=1), 2 * DEGREE)

    def _spread(self, at: np.ndarray, found: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of ``found`` for each node: first those closer to it than to any chosen before, then the nearest."""
        found = np.sort(np.where(found == at[:, None], -1, found), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        cos = np.where(found >= 0, np.einsum("bd,bkd->bk", self.unit[at], self.unit[found]), -np.inf)
        order = np.argsort(-cos, axis=1, kind="stable")[:, :4 * DEGREE]
        rows = np.arange(len(at))[:, None]
        found, cos = found[rows, order], cos[rows, order]
        vecs = self.unit[found]
        each = np.einsum("bkd,bjd->bkj", vecs, vecs)
        chosen = np.zeros(found.shape, bool)
        for k in range(found.shape[1]):
            clash = (np.where(chosen, each[:, k, :], -np.inf).max(axis=1) > cos[:, k]) | (chosen.sum(axis=1) >= most)
            chosen[:, k] = (found[:, k] >= 0) & ~clash
        # Diverse ones first; whatever room is left goes to the nearest.
        order = np.argsort(np.where(found < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :most]
        out = np.full((len(at), most), -1, np.int32)
        out[:, :order.shape[1]] = found[rows, order]
        return out

    def links(self, queries: np.ndarray, least: float, width: int) -> np.ndarray:
        """For each query which nodes are at ``least`` cosine, as far as the beams see; full beams are widened."""
        hit = np.zeros((len(queries), len(self.unit)), bool)
        for low in range(0, len(queries), BLOCK):
            todo, wide = np.arange(low, min(low + BLOCK, len(queries))), width
            while len(todo):
                if wide > WIDEST_BEAM or wide >= len(self.unit):
                    hit[todo] = queries[todo] @ self.unit.T >= least
                    break
                ids, sims = self.beam(0, queries[todo], self.entry(queries[todo], 0), wide)
                good = sims >= least
                hit[np.repeat(todo, wide)[good.ravel()], ids[good]] = True
                todo, wide = todo[good.all(axis=1)], 2 * wide
        return hit


def audited_links(graph: Graph, queries: np.ndarray, least: float) -> np.ndarray:
    """Links of all queries; the first beam is doubled until audited queries find what a full scan finds."""
    audit = np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int)
    truth = queries[audit] @ graph.unit.T >= least
    width = FIRST_BEAM
    while width <= WIDEST_BEAM:
        if (graph.links(queries[audit], least, width) & truth).sum() >= RECALL * truth.sum():
            break
        width *= 2
    return graph.links(queries, least, width)


def _forest(found: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the block joins: each vertex with the first of its part."""
    edges, new_rows, new_cols = [], found.any(axis=1), found.any(axis=0)
    for row in np.flatnonzero(new_rows):
        if not new_rows[row]:
            continue
        edge_rows = np.array([row])
        new_rows[row] = False
        while len(edge_rows):
            cols = np.flatnonzero(found[edge_rows].any(axis=0) & new_cols)
            new_cols[cols] = False
            edges += [(int(left[row]), int(right[c])) for c in cols]
            edge_rows = np.flatnonzero(found[:, cols].any(axis=1) & new_rows) if len(cols) else cols
            new_rows[edge_rows] = False
            edges += [(int(left[row]), int(left[r])) for r in edge_rows]
    return edges


def _confirm(hit: np.ndarray, one: np.ndarray, two: np.ndarray, least: float) -> np.ndarray:
    """Only pairs whose cosine in double precision is at ``least``."""
    norm_one, norm_two = np.linalg.norm(one, axis=1), np.linalg.norm(two, axis=1)
    for low in range(0, len(one), BLOCK):
        rows = np.flatnonzero(hit[low:low + BLOCK].any(axis=1)) + low
        if len(rows):
            hit[rows] &= (one[rows] @ two.T) / (norm_one[rows, None] * norm_two[None, :]) >= least
    return hit


def _weighted(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``found @ weights`` in blocks, exact below 2^53."""
    own = weights.astype(float)
    return np.concatenate([found[low:low + BLOCK] @ own for low in range(0, len(found), BLOCK)]).astype(np.int64)


def near_vectors(embeddings: DataFrame, least: float = 0.93) -> DataFrame:
    """Links between vectors of one label with a cosine of at least ``least``, and their components.

    Returns a row for each row of ``embeddings``: ``vec_id, n_links, component_id, kept``. Equal
    vectors of a label are one class with a count. Classes are dealt to shards of about 8,192 by a
    hash; each shard builds its graph once; each pair of shards of a label is one task that queries
    both graphs with the other's vectors (a shard its own graph). The beam of a query that is full of
    links is doubled, beyond 64 the query scans the shard; an audit against a full scan doubles the
    first beam until recall is 0.995. Candidates are verified in double precision. A task returns
    counts for its vectors and the links that join what it joins, never all pairs.

    A vector that is null, empty, zero or has null or non-finite parts, a null label or a null vec_id
    links with nothing (component: its own id). Vectors of different length do not link. Rows that
    repeat vec_id and vector count as further vectors; rows that share a vec_id are one vertex.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                             F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0).alias("v"))
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
              & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("label", F.when(usable, F.concat_ws("/", "label", F.size("v").cast("string"))))
    rows = rows.withColumn("h1", F.when(usable, F.xxhash64("label", "v"))).withColumn("h2", F.when(usable, F.xxhash64("v", "label")))
    classes = settle(rows.where("h1 IS NOT NULL").groupBy("label", "h1", "h2")
                     .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")))
    shards = classes.groupBy("label").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    dealt = classes.join(shards, "label").withColumn("shard", F.pmod("h1", "shards").cast("int"))

    kind = pa.schema([("label", pa.string()), ("shards", pa.int32()), ("shard", pa.int32()), ("body", pa.binary())])

    def build(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("h1", "h2", "rep", "n", "v"))))
        v = np.array([r[4] for r in rows])
        unit = v / np.abs(v).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        ids = [np.array([r[i] for r in rows], np.int64) for i in range(4)]
        return pa.Table.from_pydict({"label": [group.column("label")[0].as_py()], "shards": [group.column("shards")[0].as_py()],
                                     "shard": [group.column("shard")[0].as_py()], "body": [pickle.dumps((ids, unit, Graph(unit)))]}, schema=kind)

    graphs = settle(dealt.groupBy("label", "shard").applyInArrow(build, "label string, shards int, shard int, body binary"))
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    tasks = graphs.select("label", "shard", "body", other.alias("with")).select(
        "label", F.least("shard", "with").alias("i"), F.greatest("shard", "with").alias("j"), "shard", "body")

    out_kind = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def link(group: pa.Table) -> pa.Table:
        bodies = [pickle.loads(b) for _, b in sorted(zip(group.column("shard").to_pylist(), group.column("body").to_pylist()))]
        (ids, unit, graph), (ids2, unit2, graph2) = bodies[0], bodies[-1]
        close = least - 1e-4  # the graph works in single precision
        found = audited_links(graph2, graph.unit, close)
        if len(bodies) == 1:
            found |= found.T
            np.fill_diagonal(found, False)
        else:
            found |= audited_links(graph, graph2.unit, close).T
        found = _confirm(found, unit, unit2, least)
        edges = _forest(found, ids[2], ids2[2])
        links = _weighted(found, ids2[3])
        sides = [(ids, links + ids[3] - 1)] if len(bodies) == 1 else [(ids, links), (ids2, _weighted(found.T, ids[3]))]
        h1, h2, n = ([int(x) for side in part for x in side] for part in zip(*((i[0], i[1], c) for i, c in sides)))
        none, gap = [None] * len(edges), [None] * len(h1)
        return pa.Table.from_pydict({"h1": h1 + none, "h2": h2 + none, "links": n + none,
                                     "a": gap + [e[0] for e in edges], "b": gap + [e[1] for e in edges]}, schema=out_kind)

    made = settle(tasks.groupBy("label", "i", "j").applyInArrow(link, "h1 long, h2 long, links long, a long, b long"))
    counts = made.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    reach = components(made.where("a IS NOT NULL").select("a", "b"))
    found = (classes.drop("v").join(counts, ["h1", "h2"]).join(reach, F.col("rep") == F.col("v"), "left")
             .select("h1", "h2", "links", F.coalesce("root", "rep").alias("root")))
    return (rows.select("vec_id", "h1", "h2").join(found, ["h1", "h2"], "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
