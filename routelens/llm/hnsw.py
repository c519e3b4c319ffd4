"""Nearest neighbours by a hierarchical navigable small-world graph for each shard, with the shards' results merged.

Rows are dealt to shards of about ``SHARD_ROWS`` by a hash of their id. Each shard builds one graph over its different
vectors: nodes are ordered by level, so layer l is a flat array with ``width`` neighbour numbers for each of its first
nodes, and a shard's index is one row of a few binary columns. The index is written to the shared folder before it is
searched. Queries travel in blocks of at most ``BLOCK``; a task holds one shard's index and one block of queries, finds
the nearest of that shard, measures them exactly on the original vectors, and the best of all shards are merged.

Equal vectors are one node with the sorted list of its ids: a vector that a third of all rows share is spread over the
shards like any other rows, costs one node in each, and can not fill the neighbour lists of the graph.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take
no part; equal (id, vector) rows count once; a query is compared with vectors of its own length only, never with rows
of its own id; fewer candidates than ``k`` are all returned; ties go to the smaller id; extra columns are ignored.
"""

from __future__ import annotations

import math
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routelens.llm.tables import table, written

SHARD_ROWS = 8192
BLOCK = 4096
LINKS = 14
EF_BUILD = 72
EF_SEARCH = 128
NEAREST = 10
QUERY_EVERY = 100
SPREAD = 4  # tasks for each shard, so that few shards share one by chance


class Graph:
    """A graph over distinct vectors; ``layers[l][i]`` are the neighbours of node i on layer l, -1 where there are fewer."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.norms = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.layers = layers
        self.seen = np.zeros(len(vectors), np.int64)
        self.turn = 0

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 17) -> tuple[Graph, np.ndarray]:
        """The graph and the order of ``vectors`` that its nodes have."""
        n = len(vectors)
        levels = (-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(links)).astype(int)
        order = np.argsort(-levels, kind="stable")
        levels = levels[order]
        top = int(levels[0]) if n else 0
        layers = [np.full((int((levels >= l).sum()), links * (2 if l == 0 else 1)), -1, np.int32) for l in range(top + 1)]
        graph = cls(vectors[order], layers)
        for i in range(1, n):
            graph._insert(i, int(levels[i]), ef)
        return graph, order

    def _distances(self, q: np.ndarray, q_norm: float, nodes: np.ndarray) -> np.ndarray:
        return self.norms[nodes] - 2 * (self.vectors[nodes] @ q) + q_norm

    def _layer(self, q: np.ndarray, q_norm: float, start: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest nodes that a best-first walk from ``start`` finds, nearest first."""
        self.turn += 1
        seen, turn, links = self.seen, self.turn, self.layers[layer]
        for _, node in start:
            seen[node] = turn
        todo = list(start)
        heapify(todo)
        best = [(-d, node) for d, node in start]
        heapify(best)
        while todo:
            d, node = heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            near = links[node]
            near = near[near >= 0]
            near = near[seen[near] != turn]
            if not len(near):
                continue
            seen[near] = turn
            for d, other in zip(self._distances(q, q_norm, near).tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heappush(best, (-d, other))
                elif d < -best[0][0]:
                    heapreplace(best, (-d, other))
                else:
                    continue
                heappush(todo, (d, other))
        return sorted((-d, node) for d, node in best)

    def _diverse(self, nodes: np.ndarray, distance: np.ndarray, most: int) -> np.ndarray:
        """Of ``nodes``, nearest first, those that are nearer to the centre than to any node taken before; then the nearest others."""
        if len(nodes) <= most:
            return nodes
        vectors = self.vectors[nodes]
        norms = self.norms[nodes]
        between = norms[:, None] + norms[None, :] - 2 * (vectors @ vectors.T)
        open_, taken = np.ones(len(nodes), bool), []
        while len(taken) < most:
            i = int(open_.argmax())
            if not open_[i]:
                break
            taken.append(i)
            open_ &= between[i] >= distance
            open_[i] = False
        if len(taken) < most:
            others = np.setdiff1d(np.arange(len(nodes)), taken)
            taken += others[: most - len(taken)].tolist()
        return nodes[taken]

    def _insert(self, i: int, level: int, ef: int) -> None:
        q, q_norm = self.vectors[i], float(self.norms[i])
        start = [(float(self._distances(q, q_norm, np.array([0]))[0]), 0)]
        top = len(self.layers) - 1
        for layer in range(top, -1, -1):
            if layer > level:
                start = self._layer(q, q_norm, start, 1, layer)
                continue
            found = self._layer(q, q_norm, start, ef, layer)
            links = self.layers[layer]
            width = links.shape[1]
            nodes = np.array([n for _, n in found], np.int32)
            chosen = self._diverse(nodes, np.array([d for d, _ in found], np.float32), LINKS if layer == 0 else width)
            links[i, : len(chosen)] = chosen
            for other in chosen.tolist():
                row = links[other]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = i
                    continue
                both = np.append(row, np.int32(i))
                distance = self._distances(self.vectors[other], float(self.norms[other]), both)
                by = np.argsort(distance, kind="stable")
                kept = self._diverse(both[by], distance[by], width)
                row[:] = -1
                row[: len(kept)] = kept
            start = found

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        """About the ``ef`` nearest nodes."""
        if not len(self.vectors):
            return np.zeros(0, np.int64)
        q = q.astype(np.float32)
        q_norm = float(q @ q)
        start = [(float(self._distances(q, q_norm, np.array([0]))[0]), 0)]
        for layer in range(len(self.layers) - 1, 0, -1):
            start = self._layer(q, q_norm, start, 1, layer)
        return np.array([n for _, n in self._layer(q, q_norm, start, ef, 0)], np.int64)


INDEX = "dim int, shard int, vectors binary, links binary, layer_sizes array<int>, ids binary, id_ends binary"


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """The index of one shard as one row."""
    dim = int(rows["dim"].iloc[0])
    raw = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    ids = rows["vec_id"].to_numpy(np.int64)
    by = np.lexsort((ids, *raw.T))
    raw, ids = raw[by], ids[by]
    new = np.append(True, (raw[1:] != raw[:-1]).any(axis=1))
    first = np.flatnonzero(new)
    graph, order = Graph.build(raw[first])
    end = np.append(first[1:], len(ids))
    groups = [ids[first[k] : end[k]] for k in order]
    row = {
        "dim": dim, "shard": int(rows["shard"].iloc[0]), "vectors": raw[first][order].tobytes(),
        "links": b"".join(x.tobytes() for x in graph.layers), "layer_sizes": [len(x) for x in graph.layers],
        "ids": np.concatenate(groups).tobytes(), "id_ends": np.cumsum([len(g) for g in groups]).astype(np.int64).tobytes(),
    }
    return pd.DataFrame([row])


def _load(row: pd.Series) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, int(row["dim"]))
    links, layers, at = np.frombuffer(row["links"], np.int32), [], 0
    for l, size in enumerate(row["layer_sizes"]):
        width = LINKS * (2 if l == 0 else 1)
        layers.append(links[at : at + size * width].reshape(size, width))
        at += size * width
    return Graph(vectors, layers), vectors, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_ends"], np.int64)


def _searcher(k: int, ef: int):
    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The ``k`` nearest rows of one shard for each query of one block."""
        out = []
        if len(index) and len(queries):
            graph, vectors, ids, ends = _load(index.iloc[0])
            starts = np.append(0, ends[:-1])
            for own, q in zip(queries["query_id"].to_numpy(), queries["embedding"], strict=True):
                q = np.asarray(q, np.float64)
                nodes = graph.search(q, max(ef, k + 1))
                distance = np.sqrt(((vectors[nodes] - q) ** 2).sum(axis=1))
                found = []
                for node, d in zip(nodes, distance, strict=True):
                    group = ids[starts[node] : min(ends[node], starts[node] + k + 1)]  # ids are sorted: later ones can not be among k
                    found += [(float(d), int(i)) for i in group if i != own]
                out += [(int(own), i, d) for d, i in sorted(found)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return search


def usable(vectors: DataFrame) -> DataFrame:
    """The different (vec_id, embedding, dim) rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    return rows.where(finite & F.exists("embedding", lambda x: x != 0)).distinct().withColumn("dim", F.size("embedding"))


def nearest(vectors: DataFrame, every: int = QUERY_EVERY, k: int = NEAREST, shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``, against all rows."""
    rows = written(usable(vectors), "vectors")
    is_query = F.col("vec_id") % every == 0
    n, n_queries = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(is_query.cast("long")), F.lit(0))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // BLOCK))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"))
    index = written(dealt.repartition(SPREAD * shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(_build_shard, INDEX), "index")
    asked = rows.where(is_query).select("dim", F.col("vec_id").alias("query_id"), "embedding")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    tasks = SPREAD * shards * blocks
    found = held.repartition(tasks, *keys).groupBy(*keys).cogroup(asked.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(_searcher(k, ef), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_hnsw_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth vector."""
    return nearest(table(spark, sf_dir, "embeddings"))
