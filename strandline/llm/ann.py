"""Approximate nearest neighbours by cosine: one hierarchical navigable small-world graph per shard.

A shard's graph is built in one task and stored as flat arrays: the vectors, and for each layer its nodes and a matrix
of their neighbours. Queries travel in blocks to every shard, and the shards' results are merged: a shard and a block of
queries meet by the key (shard, block), one task's work at any size, so that no key holds more than one of each. A search moves
many queries through the graph at once and expands several nodes of each, so that a step is a few numpy operations.

Equal vectors are one node with the least of their ids, as many as a result can need: copies, however many, neither
swell a shard nor cut its graph apart, and ties still go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import scratch_table, table

#: Neighbours of a node (twice as many in the lowest layer), candidates on insertion, width of the search, nodes expanded at a time.
LINKS, BUILD_WIDTH, WIDTH, EXPAND = 16, 64, 128, 4
#: Distinct vectors of a shard, and queries of a block.
SHARD, QUERIES = 16_384, 8_192
#: Queries that move through a graph together.
TOGETHER = 512


def search_layer(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for all queries together: (similarities, nodes), best first, -1 where there are fewer.

    ``neighbours`` has a row per vector, -1 where there is none; ``entries`` a node per query. The best ``width`` nodes are held in no
    order until the end; the best of those not yet expanded go on.
    """
    n = len(queries)
    out = np.full((n, width), -np.inf, np.float32), np.full((n, width), -1, np.int32)
    which = np.arange(n)  # the queries that the arrays below are of; those that are done leave when half are
    best, nodes = (x.copy() for x in out)
    ready = best.copy()  # similarities of nodes not yet expanded
    seen = np.zeros((n, len(vectors)), bool)
    best[:, 0] = ready[:, 0] = np.einsum("ij,ij->i", queries, vectors[entries])
    nodes[:, 0] = entries
    seen[which, entries] = True
    few = min(EXPAND, width)
    while len(which):
        rows = np.arange(len(which))[:, None]
        at = np.argpartition(-ready, few - 1, axis=1)[:, :few] if few < width else np.broadcast_to(np.arange(width), ready.shape)
        near = np.where((ready[rows, at] > -np.inf)[:, :, None], neighbours[nodes[rows, at]], -1).reshape(len(which), -1)
        ready[rows, at] = -np.inf
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        row, place = np.nonzero(near >= 0)
        node = near[row, place]
        fresh = ~seen[row, node]
        row, node = row[fresh], node[fresh]
        seen[row, node] = True
        if len(row):
            close = np.einsum("ij,ij->i", queries[row], vectors[node])
            count = np.bincount(row, minlength=len(which))
            slot = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            # nodes no better than the worst held go at once
            good = close > best.min(axis=1)[row]
            more = np.full((len(which), int(count.max())), -np.inf, np.float32)
            new = np.full(more.shape, -1, np.int32)
            more[row[good], slot[good]], new[row[good], slot[good]] = close[good], node[good]
            every, names, open_ = np.concatenate([best, more], axis=1), np.concatenate([nodes, new], axis=1), np.concatenate([ready, more], axis=1)
            order = np.argpartition(-every, width - 1, axis=1)[:, :width] if every.shape[1] > width else np.broadcast_to(np.arange(width), ready.shape)
            best, nodes, ready = every[rows, order], names[rows, order], open_[rows, order]
        going = (ready > -np.inf).any(axis=1)
        if 2 * np.count_nonzero(going) <= len(which):
            out[0][which[~going]], out[1][which[~going]] = best[~going], nodes[~going]
            which, best, nodes, ready, queries, seen = (x[going] for x in (which, best, nodes, ready, queries, seen))
    order = np.argsort(-out[0], axis=1, kind="stable")
    return np.take_along_axis(out[0], order, axis=1), np.take_along_axis(out[1], order, axis=1)


def chosen(vectors: np.ndarray, close: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first) those that are nearer to the row than to one already chosen; filled up with the best."""
    n, width = nodes.shape
    near = vectors[np.maximum(nodes, 0)]
    among = near @ near.transpose(0, 2, 1)
    taken = np.zeros((n, width), bool)
    count = np.zeros(n, np.int64)
    for k in range(width):
        blocked = (taken & (among[:, k, :] > close[:, k, None])).any(axis=1)
        ok = (nodes[:, k] >= 0) & ~blocked & (count < most)
        taken[:, k] = ok
        count += ok
    rank = np.where(taken, 0, np.where(nodes >= 0, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :most]
    return np.take_along_axis(nodes, order, axis=1)


class Graph:
    """Layers from the lowest: (nodes, neighbours), neighbours numbered over all vectors."""

    def __init__(self, unit: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, batch: int = 512):
        self.unit = unit
        n = len(unit)
        # a fixed sequence of layers: layer l holds about n / links ** l nodes, and depends on the place alone
        draw = ((np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        level = np.minimum((-np.log(np.maximum(draw, 1e-18)) / np.log(links)).astype(np.int64), 6)
        self.layers = []
        for l in range(int(level.max(initial=0)) + 1):
            self.layers.append((np.flatnonzero(level >= l), np.full((n, links * (2 if l == 0 else 1)), -1, np.int32)))
        for l, (members, neighbours) in reversed(list(enumerate(self.layers))):
            self._fill(l, members, neighbours, width, batch)

    def _fill(self, l: int, members: np.ndarray, neighbours: np.ndarray, width: int, batch: int) -> None:
        """Insert a layer's nodes, ``batch`` at a time.

        A shard is bounded, so the nearest nodes already inserted are found exactly, by one matrix product for a batch; a search
        of the unfinished graph would take longer and find less.
        """
        most = neighbours.shape[1]
        for at in range(0, len(members), batch):
            new = members[at : at + batch]
            before = members[: at + len(new)]  # nodes of the same batch are candidates too
            every = self.unit[new] @ self.unit[before].T
            every[np.arange(len(new)), at + np.arange(len(new))] = -np.inf
            keep = min(width, len(before))
            near = np.argpartition(-every, keep - 1, axis=1)[:, :keep]
            close = np.take_along_axis(every, near, axis=1)
            order = np.argsort(-close, axis=1, kind="stable")
            close, nodes = np.take_along_axis(close, order, axis=1), before[np.take_along_axis(near, order, axis=1)].astype(np.int32)
            nodes[~np.isfinite(close)] = -1
            picked = chosen(self.unit, close, nodes, most // 2 if l == 0 else most)
            neighbours[new, : picked.shape[1]] = picked
            self._back(neighbours, new, picked)

    def _back(self, neighbours: np.ndarray, new: np.ndarray, picked: np.ndarray) -> None:
        """Link the chosen nodes back; those with too many links choose again."""
        most = neighbours.shape[1]
        target = picked.ravel()
        source = np.repeat(new, picked.shape[1])[target >= 0].astype(np.int32)
        target = target[target >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        unique, first, count = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(unique), most + int(count.max(initial=0))), -1, np.int32)
        wide[:, :most] = neighbours[unique]
        rank = np.arange(len(target)) - np.repeat(first, count)
        wide[np.repeat(np.arange(len(unique)), count), most + rank] = source
        close = np.where(wide >= 0, np.einsum("ij,ikj->ik", self.unit[unique], self.unit[np.maximum(wide, 0)]), -np.inf)
        order = np.argsort(-close, axis=1, kind="stable")
        close, wide = np.take_along_axis(close, order, axis=1), np.take_along_axis(wide, order, axis=1)
        wide[:, 1:][(wide[:, 1:] == wide[:, :-1]) & (wide[:, 1:] >= 0)] = -1  # both sides may have chosen each other
        full = (wide >= 0).sum(axis=1) > most
        out = np.full((len(unique), most), -1, np.int32)
        if (~full).any():
            few = wide[~full]
            few = np.take_along_axis(few, np.argsort(few < 0, axis=1, kind="stable"), axis=1)
            out[~full] = few[:, :most]
        if full.any():
            out[full] = chosen(self.unit, close[full][:, : 2 * most], wide[full][:, : 2 * most], most)
        neighbours[unique] = out

    def descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """Nearest node found in the layers above ``to``, for each query."""
        entry = np.full(len(queries), self.layers[-1][0][0])
        for _, neighbours in self.layers[: to : -1]:
            entry = search_layer(self.unit, neighbours, queries, entry, 4)[1][:, 0]
        return entry

    def search(self, queries: np.ndarray, width: int = WIDTH) -> np.ndarray:
        """Nodes by similarity, -1 where there are fewer than ``width``."""
        parts = [queries[k : k + TOGETHER] for k in range(0, len(queries), TOGETHER)]
        return np.concatenate([search_layer(self.unit, self.layers[0][1], q, self.descend(q, 0), width)[1] for q in parts])

    def flat(self) -> list[bytes]:
        return [part.tobytes() for nodes, near in self.layers for part in (nodes.astype(np.int32), near[nodes])]

    @staticmethod
    def of(unit: np.ndarray, parts: list[bytes], links: int) -> "Graph":
        """A graph from its flat arrays."""
        out = Graph.__new__(Graph)
        out.unit, out.layers = unit, []
        for l in range(0, len(parts), 2):
            nodes = np.frombuffer(parts[l], np.int32)
            near = np.full((len(unit), links * (2 if l == 0 else 1)), -1, np.int32)
            near[nodes] = np.frombuffer(parts[l + 1], np.int32).reshape(len(nodes), -1)
            out.layers.append((nodes, near))
        return out


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and v (double), without vectors that are null, empty, zero, or hold null or non-finite components."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    return rows.filter(~bad).filter(F.exists("v", lambda x: x != 0.0))


def build_index(vectors: DataFrame, k: int, shard_size: int = SHARD, links: int = LINKS) -> DataFrame:
    """One row per shard: dim, shard, ids (of each node, up to k + 1), vectors (float64), parts (flat arrays of the graph)."""
    spark = vectors.sparkSession
    one = Window.partitionBy("v").orderBy("vec_id")
    least = vectors.withColumn("n", F.row_number().over(one)).filter(F.col("n") <= k + 1)
    distinct = scratch_table(least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("v")), "vectors")
    count = distinct.count()
    shards = max(1, -(-count // shard_size))
    placed = distinct.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(first=[i[0] for i in group.ids]).sort_values("first")
        v = np.stack(group.v.to_numpy()).astype(np.float64)
        unit = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
        ids = np.full((len(v), k + 1), -1, np.int64)
        for row, own in zip(ids, group.ids):
            row[: len(own)] = own
        held = np.array([len(i) for i in group.ids], np.int32)
        return pd.DataFrame([{"dim": int(group.dim.iloc[0]), "shard": int(group.shard.iloc[0]), "ids": ids.tobytes(), "held": held.tobytes(), "vectors": v.tobytes(), "parts": Graph(unit, links).flat()}])

    return scratch_table(placed.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, ids binary, held binary, vectors binary, parts array<binary>"), "graphs")


def search(index: DataFrame, queries: DataFrame, k: int, width: int = WIDTH, links: int = LINKS, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found, by cosine in double precision, ties to the smaller id; never itself."""
    spark = queries.sparkSession
    count = queries.count()
    blocks = max(1, -(-count // block))
    shards = index.agg(F.max("shard")).first()[0]
    if shards is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    keyed = queries.withColumns({"dim": F.size("v"), "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")})
    # every query goes to every shard once, every shard to every block once; a key holds one shard and one block
    asked = keyed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards)))).select("dim", "shard", "block", "vec_id", "v")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = min((shards + 1) * blocks, 2**20)
    keys = [F.col("dim"), F.col("shard"), F.col("block")]

    def find(shard: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if shard.empty or group.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        row = shard.iloc[0]
        v = np.frombuffer(row.vectors, np.float64).reshape(-1, int(row.dim))
        norm = np.linalg.norm(v, axis=1)
        graph = Graph.of((v / norm[:, None]).astype(np.float32), list(row.parts), links)
        held = np.frombuffer(row.held, np.int32)
        ids = np.frombuffer(row.ids, np.int64).reshape(len(v), -1)
        asked = group.vec_id.to_numpy(np.int64)
        q = np.stack(group.v.to_numpy()).astype(np.float64)
        length = np.linalg.norm(q, axis=1)
        nodes = graph.search((q / length[:, None]).astype(np.float32), min(width, len(v)))
        # single precision orders the nodes found; those near the top are scored in double precision
        nodes = nodes[:, : 4 * (k + 1)]
        score = np.einsum("ij,ikj->ik", q, v[np.maximum(nodes, 0)]) / (length[:, None] * norm[np.maximum(nodes, 0)])
        score = np.where(nodes >= 0, score, -np.inf)
        order = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
        nodes, score = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(score, order, axis=1)
        owner, place = np.nonzero(nodes >= 0)
        node = nodes[owner, place]
        n = held[node]
        which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out = pd.DataFrame({"query_id": asked[np.repeat(owner, n)], "vec_id": ids[np.repeat(node, n), which], "score": np.repeat(score[owner, place], n)})
        return out[out.query_id != out.vec_id]

    pairs = held.repartition(parts, *keys).groupBy("dim", "shard", "block").cogroup(asked.repartition(parts, *keys).groupBy("dim", "shard", "block"))
    found = pairs.applyInPandas(find, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_size: int = SHARD, width: int = WIDTH, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` nearest of ``vectors`` for each of ``queries`` (tables with the same columns).

    Vectors null, zero or with null or non-finite components take no part on either side, nor do null ids. Vectors of
    different length are never compared. With fewer than ``k`` candidates all are returned; empty tables give no rows.
    Further columns are ignored. Ids are taken to be unique; a repeated id counts as one candidate per row.
    """
    index = build_index(usable(vectors, vec_id, embedding), k, shard_size)
    return search(index, usable(queries, vec_id, embedding), k, width)


def op1_nearest(spark, sf_dir):
    """Every 50th vector against all."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))
