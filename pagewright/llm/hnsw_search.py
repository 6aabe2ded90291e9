"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Rows are dealt to shards of bounded size by a hash of their id. Each shard is built into a graph
stored as flat neighbour arrays (one integer matrix per layer), in batches: the batch searches
the graph so far, sees its own members too, and links by the diversity rule. Every query block
searches every shard, and the shards' best are merged. Nearness is the largest inner product;
vectors of unequal length are given one more component that makes their norms equal, so that
the graph's order is that of the inner product. Scores are recomputed on the original vectors in
double precision.

Equal vectors of a shard are one node with several ids, so copies cannot cut the graph.

Defined results for odd input: vectors that are null, empty, zero, of another dimension than
most, or hold null or non-finite components take no part, nor do null ids; rows with an equal id
and vector count once; an empty table gives an empty table; fewer candidates than k give all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 96, 240
SHARD_ROWS, QUERY_ROWS, BATCH = 16_384, 8_192, 256
#: Candidates expanded at once in each step of a search.
EXPAND = 3


class Graph:
    """Layers of flat neighbour arrays over the rows of x (float32, equal norms)."""

    def __init__(self, x: np.ndarray, links: int = LINKS):
        self.x, self.links = x, links
        self.layers: list[np.ndarray] = []  # [rows, width], -1 for none
        self.entry = -1

    def _width(self, layer: int) -> int:
        return 2 * self.links if layer == 0 else self.links

    def build(self, seed: int = 1, width: int = BUILD_WIDTH) -> Graph:
        n = len(self.x)
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(self.links)).astype(int), 8)
        # higher nodes first: a batch then finds every layer it needs already there
        order = np.argsort(-level, kind="stable")
        self.layers = [np.full((n, self._width(k)), -1, np.int32) for k in range(level.max(initial=0) + 1)]
        self.entry = int(order[0])
        at = 1
        while at < n:
            batch = order[at : at + min(BATCH, max(1, at))]
            self._insert(batch, level, order[:at], width)
            at += len(batch)
        return self

    def _insert(self, batch: np.ndarray, level: np.ndarray, earlier: np.ndarray, width: int) -> None:
        top = len(self.layers) - 1
        start = np.full((len(batch), 1), self.entry)
        for layer in range(top, -1, -1):
            here = level[batch] >= layer
            found, near = self.search_layer(self.x[batch], start, layer, width if here.any() else 1)
            start = found[:, : max(1, min(8, found.shape[1]))]
            if not here.any():
                continue
            nodes, found, near = batch[here], found[here], near[here]
            own = self.x[nodes] @ self.x[nodes].T
            np.fill_diagonal(own, -np.inf)
            most = min(len(nodes), width // 2)
            peers = np.argpartition(-own, most - 1, axis=1)[:, :most] if len(nodes) > 1 else np.zeros((len(nodes), 0), int)
            cand = np.concatenate([found, nodes[peers]], axis=1)
            sim = np.concatenate([near, np.take_along_axis(own, peers, 1)], axis=1)
            cand = np.where(np.isfinite(sim), cand, -1)
            chosen = self._choose(cand, sim, self.links)
            self.layers[layer][nodes, : self.links] = chosen
            self._link_back(nodes, chosen, layer)

    def _choose(self, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each row's candidates: diverse ones first, then the nearest others."""
        keep = min(cand.shape[1], 2 * self.links + 32)
        order = np.argsort(-np.where(cand >= 0, sim, -np.inf), axis=1)[:, :keep]
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(np.where(cand >= 0, sim, -np.inf), order, 1)
        out = np.full((len(cand), most), -1, np.int32)
        for lo in range(0, len(cand), 512):
            c, s = cand[lo : lo + 512], sim[lo : lo + 512]
            v = self.x[np.maximum(c, 0)]
            pair = v @ v.transpose(0, 2, 1)
            taken = np.zeros(c.shape, bool)
            closest = np.full(c.shape, -np.inf, np.float32)  # similarity to the nearest chosen one
            for j in range(c.shape[1]):
                ok = (c[:, j] >= 0) & (s[:, j] > closest[:, j]) & (taken.sum(1) < most)
                taken[:, j] = ok
                closest = np.where(ok[:, None], np.maximum(closest, pair[:, :, j]), closest)
            rank = np.argsort(np.where(c < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :most]
            out[lo : lo + 512, : rank.shape[1]] = np.take_along_axis(c, rank, 1)
        return out

    def _link_back(self, nodes: np.ndarray, chosen: np.ndarray, layer: int) -> None:
        g, width = self.layers[layer], self._width(layer)
        to, of = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        to, of = to[to >= 0], of[to >= 0]
        known = (g[to] == of[:, None]).any(axis=1)
        to, of = to[~known], of[~known]
        if not len(to):
            return
        near = np.einsum("ij,ij->i", self.x[to], self.x[of])
        order = np.lexsort((-near, to))
        to, of, near = to[order], of[order], near[order]
        first = np.r_[True, to[1:] != to[:-1]]
        group = np.cumsum(first) - 1
        place = np.arange(len(to)) - np.flatnonzero(first)[group]
        stays = place < width  # nearest new links of each target
        targets, group, place, of, near = to[first], group[stays], place[stays], of[stays], near[stays]
        extra = int(place.max()) + 1
        cand = np.full((len(targets), width + extra), -1, np.int32)
        cand[:, :width] = g[targets]
        cand[group, width + place] = of
        sim = np.einsum("ijk,ik->ij", self.x[np.maximum(cand, 0)], self.x[targets])
        roomy = (cand >= 0).sum(1) <= width
        if roomy.any():
            packed = np.sort(-cand[roomy].astype(np.int64), axis=1)[:, :width]  # filled places first
            g[targets[roomy]] = -packed
        if (~roomy).any():
            g[targets[~roomy]] = self._choose(cand[~roomy], sim[~roomy], width)

    def search_layer(self, q: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, inner products) of the best ``width`` found from start nodes, best first."""
        g, n, b = self.layers[layer], len(self.x), len(q)
        seen = np.zeros((b, n + 1), bool)
        rows = np.arange(b)[:, None]
        cand = np.full((b, width), n, np.int64)
        sim = np.full((b, width), -np.inf, np.float32)
        start = start[:, :width]
        m = start.shape[1]
        cand[:, :m] = np.where(start >= 0, start, n)
        dup = np.zeros(start.shape, bool)
        for j in range(1, m):
            dup[:, j] = (cand[:, :j] == cand[:, j : j + 1]).any(axis=1)
        cand[:, :m] = np.where(dup, n, cand[:, :m])
        s0 = np.einsum("ijk,ik->ij", self.x[np.minimum(cand[:, :m], n - 1)], q)
        sim[:, :m] = np.where(cand[:, :m] < n, s0, -np.inf)
        seen[rows, cand[:, :m]] = True
        seen[:, n] = True
        done = sim == -np.inf
        live = np.arange(b)
        while len(live):
            open_sim = np.where(done[live], -np.inf, sim[live])
            e = min(EXPAND, width)
            pick = np.argpartition(-open_sim, e - 1, axis=1)[:, :e] if e < width else np.arange(width)[None, :].repeat(len(live), 0)
            best = np.take_along_axis(open_sim, pick, 1)
            going = (best > -np.inf).any(axis=1)
            live, pick, best = live[going], pick[going], best[going]
            if not len(live):
                break
            r = live[:, None]
            chosen = np.where(best > -np.inf, cand[r, pick], n)
            done[r, pick] = True
            nb = np.where((chosen < n)[:, :, None], g[np.minimum(chosen, n - 1)], -1).reshape(len(live), -1).astype(np.int64)
            nb = np.where(nb < 0, n, nb)
            nb.sort(axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = n
            nb = np.where(seen[r, nb], n, nb)
            seen[r, nb] = True
            new = np.einsum("ijk,ik->ij", self.x[np.minimum(nb, n - 1)], q[live])
            new = np.where(nb < n, new, -np.inf).astype(np.float32)
            all_sim, all_cand = np.concatenate([sim[live], new], axis=1), np.concatenate([cand[live], nb], axis=1)
            all_done = np.concatenate([done[live], new == -np.inf], axis=1)
            top = np.argpartition(-all_sim, width - 1, axis=1)[:, :width]
            sim[live], cand[live], done[live] = (np.take_along_axis(z, top, 1) for z in (all_sim, all_cand, all_done))
        order = np.argsort(-sim, axis=1)
        sim, cand = np.take_along_axis(sim, order, 1), np.take_along_axis(cand, order, 1)
        return np.where(np.isfinite(sim), cand, -1), sim

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        """Nodes of the best ``width`` on the ground layer, -1 for none."""
        start = np.full((len(q), 1), self.entry)
        for layer in range(len(self.layers) - 1, 0, -1):
            start = self.search_layer(q, start, layer, 4)[0]
        return self.search_layer(q, start, 0, width)[0]

    def flat(self) -> bytes:
        """All layers as one integer array behind a header."""
        head = [self.entry, len(self.layers), len(self.x)]
        return b"".join([np.array(head, np.int32).tobytes(), *(np.array([g.shape[1]], np.int32).tobytes() + g.tobytes() for g in self.layers)])

    @classmethod
    def from_flat(cls, x: np.ndarray, flat: bytes) -> Graph:
        out, (entry, layers, n) = cls(x), np.frombuffer(flat, np.int32, 3)
        out.entry, at = int(entry), 12
        for _ in range(layers):
            width = int(np.frombuffer(flat, np.int32, 1, at)[0])
            out.layers.append(np.frombuffer(flat, np.int32, n * width, at + 4).reshape(n, width))
            at += 4 + 4 * n * width
        return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _equal_norms(x: np.ndarray, norm: float) -> np.ndarray:
    """One more component that gives every row the same norm."""
    more = np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))
    return np.concatenate([x, more[:, None]], axis=1).astype(np.float32)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("v") == (common["n"] if common else 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, width: int = SEARCH_WIDTH, exclude_self: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest candidates found."""
    rows = materialise(usable(vectors, id_col, vector_col), "hnsw-vectors")
    asked = usable(queries, id_col, vector_col).join(rows.select(F.size("v").alias("n")).limit(1), F.size("v") == F.col("n"), "left_semi")
    n, norm = rows.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    n_asked = asked.count()
    shards, chunks = max(1, -(-n // shard_rows)), max(1, -(-n_asked // QUERY_ROWS))
    norm = float(norm or 1.0)

    def build(key: tuple, t: pa.Table) -> pa.Table:
        x, ids = _matrix(t.column("v")), t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        distinct, node = np.unique(x, axis=0, return_inverse=True)
        graph = Graph(_equal_norms(distinct, norm)).build(seed=1 + key[0].as_py())
        by_node = np.argsort(node.ravel(), kind="stable")
        ends = np.cumsum(np.bincount(node.ravel(), minlength=len(distinct)))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "ids": [ids[by_node].tobytes()], "ends": [ends.astype(np.int64).tobytes()], "vectors": [distinct.tobytes()], "graph": [graph.flat()]})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    index = materialise(dealt.groupBy("shard").applyInArrow(build, "shard int, ids binary, ends binary, vectors binary, graph binary"), "hnsw-index")

    def look(key: tuple, shard: pa.Table, block: pa.Table) -> pa.Table:
        qs, found, scores = [], [], []
        if shard.num_rows and block.num_rows:
            row = shard.to_pylist()[0]
            ids, ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)
            x = np.frombuffer(row["vectors"], np.float64).reshape(len(ends), -1)
            graph = Graph.from_flat(_equal_norms(x, norm), row["graph"])
            starts = np.r_[0, ends[:-1]]
            q, q_ids = _matrix(block.column("v")), block.column("id").to_numpy()
            for lo in range(0, len(q), BATCH):
                part = q[lo : lo + BATCH]
                nodes = graph.search(np.concatenate([part, np.zeros((len(part), 1))], axis=1).astype(np.float32), max(width, k + 1))
                for i, hit in enumerate(nodes):
                    hit = hit[hit >= 0]
                    score = (x[hit] * part[i]).sum(axis=1)
                    # all ids of the nodes, best k (and the query's own) of this shard; ties to the smaller id
                    count = ends[hit] - starts[hit]
                    every = np.concatenate([ids[starts[h] : ends[h]] for h in hit]) if len(hit) else np.zeros(0, np.int64)
                    score = np.repeat(score, count)
                    if exclude_self:
                        other = every != q_ids[lo + i]
                        every, score = every[other], score[other]
                    best = np.lexsort((every, -score))[:k]
                    qs.append(np.full(len(best), q_ids[lo + i]))
                    found.append(every[best])
                    scores.append(score[best])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"query_id": join(qs, np.int64), "vec_id": join(found, np.int64), "score": join(scores, np.float64)})

    spread = asked.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    copies = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    hits = copies.groupBy("shard", "chunk").cogroup(spread.groupBy("shard", "chunk")).applyInArrow(look, "query_id long, vec_id long, score double").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.filter(F.col("vec_id") % 20 == 0), k=20)
