"""Approximate nearest neighbours: a hierarchical navigable small-world graph a shard, results merged.

Vectors are normalised (cosine) and hashed by key to shards of about ``shard_rows``. In a shard equal vectors are one node.
Nodes draw their levels from the hash of their key; in order of level, those of level l are the first n_l, so a level's
graph is one flat array (n_l, width) of node numbers, -1 where there is no neighbour. Levels are built from the top
down; nodes go in by blocks: every node of a block looks for its neighbours by beam search from the place that the levels above
lead to, and among the block itself, keeps those that no kept one is closer to than itself, and is linked back from
them; lists that overflow are cut by the same rule. Searches are those of the usual algorithm, for a block of queries at once
in numpy.

Every row is a query, or every row of a stated set, and searches every shard: a shard's graph and, after it, the queries in blocks go
to one task, whose memory is one graph and one block. Graphs are sent once, queries once a shard, results as k a query and shard. The best of
each shard are merged exactly by (distance, key). The work is queries x shards: set ``shard_rows`` to what a task can hold.

Defined cases: a null, empty or zero vector, one with a null or a value that isn't finite, or of another length than most has
no neighbours and is none; rows with a null key are left out; a repeated key counts once for each row that differs, and
a row isn't its own neighbour (rows that share its key aren't, either); equal distances go by key; fewer than k
others give fewer rows; an empty table gives an empty result; other columns don't take part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, mix

#: Queries of one numpy pass.
BLOCK = 1024


def _top(dist: np.ndarray, node: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of each row in order; equal distances by node."""
    order = np.lexsort((node, dist), axis=1)[:, :k]
    return np.take_along_axis(dist, order, 1), np.take_along_axis(node, order, 1)


class Graph:
    """Flat arrays: ``vec`` (n, d); ``links[l]`` (n_l, width). ``group``: the first place of each node's keys in ``keys``."""

    def __init__(self, vec: np.ndarray, links: list[np.ndarray]):
        self.vec, self.links = vec, links

    @classmethod
    def build(cls, vec: np.ndarray, draw: np.ndarray, m: int = 16, beam: int = 64) -> tuple[Graph, np.ndarray]:
        """A graph of distinct unit vectors, and the order that its nodes have. ``draw``: a random uint64 of each."""
        u = (draw.astype(np.float64) + 1) / 2.0**64
        level = np.floor(-np.log(u) / math.log(m)).astype(int)
        order = np.lexsort((draw, -level))
        graph = cls(vec[order], [])
        high = int(level.max()) if len(level) else 0
        links: dict[int, np.ndarray] = {}
        for lv in range(high, -1, -1):
            n = int((level >= lv).sum())
            graph._level(n, 2 * m if lv == 0 else m, m, beam, [links[x] for x in range(lv + 1, high + 1)][::-1], links, lv)
        graph.links = [links[x] for x in range(high + 1)]
        return graph, order

    def _level(self, n: int, width: int, m: int, beam: int, above: list[np.ndarray], links: dict[int, np.ndarray], lv: int) -> None:
        link = np.full((n, width), -1, dtype=np.int32)
        first = min(n, 2 * BLOCK)
        done = 0
        while done < n:
            to = min(n, first if not done else done + min(2 * BLOCK, max(64, done)))
            block = np.arange(done, to, dtype=np.int32)
            # the block among itself, exactly
            near = min(len(block) - 1, beam if not done else m)
            dist = 1 - self.vec[block] @ self.vec[block].T
            np.fill_diagonal(dist, np.inf)
            if near > 0:
                at = np.argpartition(dist, near - 1, axis=1)[:, :near]
                node, d = block[at], np.take_along_axis(dist, at, 1)
            else:
                node, d = np.zeros((len(block), 0), dtype=np.int32), np.zeros((len(block), 0), dtype=np.float32)
            if done:
                for a in range(0, len(block), BLOCK):
                    part = block[a : a + BLOCK]
                    fd, fn = self._beam(self.vec[part], self._descend(self.vec[part], above), link, beam)
                    if a == 0:
                        more_d, more_n = [fd], [fn]
                    else:
                        more_d.append(fd)
                        more_n.append(fn)
                node, d = np.concatenate([node, np.concatenate(more_n)], 1), np.concatenate([d, np.concatenate(more_d)], 1)
            chosen = self._choose(d, node, m)
            link[block, :m] = chosen
            # links back, the nearest first where they are many
            src, dst = np.repeat(block, m), chosen.ravel()
            ok = dst >= 0
            self._back(link, src[ok], dst[ok], width)
            done = to
        links[lv] = link

    def _choose(self, dist: np.ndarray, node: np.ndarray, m: int) -> np.ndarray:
        """Up to m of each row's candidates: from the nearest on, each that is nearer to the row's node than to any chosen one; then the nearest of the rest."""
        out = np.full((len(node), m), -1, dtype=np.int32)
        for a in range(0, len(node), 256):
            d, c = _top(np.where(node[a : a + 256] >= 0, dist[a : a + 256], np.inf), node[a : a + 256], min(node.shape[1], 4 * m))
            rows, width = c.shape
            if not width:
                continue
            v = self.vec[np.maximum(c, 0)]
            between = 1 - v @ v.transpose(0, 2, 1)
            there = np.isfinite(d)
            taken = np.zeros((rows, width), dtype=bool)
            closest = np.full((rows, width), np.inf, dtype=np.float32)  # to a chosen one
            for j in range(width):
                pick = there[:, j] & (d[:, j] < closest[:, j]) & (taken.sum(1) < m)
                taken[:, j] = pick
                closest = np.where(pick[:, None], np.minimum(closest, between[:, j]), closest)
            rank = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :m]
            got = np.take_along_axis(np.where(there, c, -1), rank, 1)
            out[a : a + 256, : got.shape[1]] = got
        return out

    def _back(self, link: np.ndarray, src: np.ndarray, dst: np.ndarray, width: int) -> None:
        if not len(src):
            return
        d = 1 - np.einsum("ij,ij->i", self.vec[src], self.vec[dst])
        order = np.lexsort((src, d, dst))
        src, dst, d = src[order], dst[order], d[order]
        head = np.flatnonzero(np.concatenate(([True], dst[1:] != dst[:-1])))
        place = np.arange(len(dst)) - np.repeat(head, np.diff(np.concatenate([head, [len(dst)]])))
        keep = place < width
        src, dst, place = src[keep], dst[keep], place[keep]
        target = dst[np.concatenate(([True], dst[1:] != dst[:-1]))]
        new = np.full((len(target), width), -1, dtype=np.int32)
        new[np.searchsorted(target, dst), place] = src
        for a in range(0, len(target), BLOCK):
            t = target[a : a + BLOCK]
            both = np.concatenate([link[t], new[a : a + BLOCK]], 1)
            both = np.sort(both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1  # a link that is there already
            count = (both >= 0).sum(1)
            fits = count <= width
            packed = -np.sort(-both, axis=1)
            link[t[fits]] = packed[fits, :width]
            over = np.flatnonzero(~fits)
            if len(over):
                c = packed[over]
                dist = 1 - np.einsum("ij,ikj->ik", self.vec[t[over]], self.vec[np.maximum(c, 0)])
                link[t[over]] = self._choose(np.where(c >= 0, dist, np.inf), c, width)

    def _descend(self, query: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """The nearest node that greedy walks through the given levels, from the top down, come to."""
        at = np.zeros(len(query), dtype=np.int32)
        best = 1 - query @ self.vec[0] if len(query) else np.zeros(0)
        for link in levels:
            moving = np.arange(len(query))
            while len(moving):
                near = link[at[moving]]
                d = 1 - np.einsum("ij,ikj->ik", query[moving], self.vec[np.maximum(near, 0)])
                d = np.where(near >= 0, d, np.inf)
                k = d.argmin(1)
                d, near = d[np.arange(len(k)), k], near[np.arange(len(k)), k]
                better = d < best[moving] - 1e-9
                moving = moving[better]
                at[moving], best[moving] = near[better], d[better]
        return at

    def _beam(self, query: np.ndarray, entry: np.ndarray, link: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(distances, nodes), nearest first, of a beam search from each query's entry; -1 and inf where fewer were found."""
        q = len(query)
        seen = np.zeros((q, -(-len(link) // 8)), dtype=np.uint8)
        dist = np.full((q, beam), np.inf, dtype=np.float32)
        node = np.full((q, beam), -1, dtype=np.int32)
        open_ = np.zeros((q, beam), dtype=bool)
        node[:, 0], open_[:, 0] = entry, True
        dist[:, 0] = 1 - np.einsum("ij,ij->i", query, self.vec[entry])
        rows = np.arange(q)
        seen[rows, entry >> 3] |= (1 << (entry & 7)).astype(np.uint8)
        live = rows
        while len(live):
            # the nearest few that weren't looked at yet
            rank = np.argsort(~open_[live], axis=1, kind="stable")[:, :expand]
            is_open = np.take_along_axis(open_[live], rank, 1)
            open_[live[:, None], rank] = False
            from_ = np.where(is_open, np.take_along_axis(node[live], rank, 1), -1)
            near = np.where((from_ >= 0)[:, :, None], link[np.maximum(from_, 0)], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            safe = np.maximum(near, 0)
            known = (seen[live[:, None], safe >> 3] >> (safe & 7).astype(np.uint8)) & 1
            r, c = np.nonzero((near >= 0) & (known == 0))
            got = near[r, c]
            np.bitwise_or.at(seen, (live[r], got >> 3), (1 << (got & 7)).astype(np.uint8))
            d = np.full(near.shape, np.inf, dtype=np.float32)
            d[r, c] = 1 - np.einsum("ij,ij->i", query[live[r]], self.vec[got])
            all_d = np.concatenate([dist[live], d], 1)
            all_n = np.concatenate([node[live], np.where(np.isfinite(d), near, -1)], 1)
            all_o = np.concatenate([open_[live], np.isfinite(d)], 1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[live] = np.take_along_axis(all_d, order, 1)
            node[live] = np.take_along_axis(all_n, order, 1)
            open_[live] = np.take_along_axis(all_o, order, 1)
            live = live[open_[live].any(1)]
        return dist, node

    def search(self, query: np.ndarray, beam: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first query, distances, nodes) block by block."""
        for a in range(0, len(query), BLOCK):
            part = query[a : a + BLOCK]
            yield a, *self._beam(part, self._descend(part, self.links[:0:-1]), self.links[0], beam)


def _units(vectors: list | pd.Series, dim: int) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float32) for v in vectors], dtype=np.float32).reshape(-1, dim)


class Search:
    """Shards' graphs as a written table (shard, n, dim, keys, first, vec, sizes, links), and the queries against them."""

    def __init__(self, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", shard_rows: int = 16_384, m: int = 16, build_beam: int = 64):
        x = F.col(vector).cast("array<double>")
        fine = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
        base = rows.filter(fine).select(F.col(key).alias("id"), x.alias("x"), norm.alias("norm")).filter((F.col("norm") > 0) & (F.size("x") > 0))
        sizes = base.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
        self.id_type = rows.schema[key].dataType.simpleString()
        self.dim, self.n = (sizes[0]["d"], sizes[0]["n"]) if sizes else (1, 0)
        self.shards = max(1, math.ceil(self.n / shard_rows))
        dim = self.dim
        self.rows = base.filter(F.size("x") == dim).select("id", F.transform("x", lambda v: (v / F.col("norm")).cast("float")).alias("v"))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            order = np.argsort(pdf["id"].to_numpy(), kind="stable")
            ids, vec = pdf["id"].to_numpy()[order], _units(pdf["v"], dim)[order]
            one, inverse = np.unique(vec, axis=0, return_inverse=True)
            inverse = inverse.ravel()
            by = np.argsort(inverse, kind="stable")  # distinct keys of each node in order
            by = by[np.concatenate(([True], (inverse[by][1:] != inverse[by][:-1]) | (ids[by][1:] != ids[by][:-1])))]
            first = np.concatenate(([0], np.cumsum(np.bincount(inverse[by], minlength=len(one)))))
            draw = mix(mix(pd.util.hash_array(ids[by[first[:-1]]])) + np.uint64(1))
            graph, place = Graph.build(one, draw, m, build_beam)
            count = np.diff(first)[place]
            keys = [ids[by[first[p] : first[p + 1]]] for p in place]
            return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "keys": [np.concatenate(keys)], "many": [count.astype(np.int32).tobytes()], "vec": [graph.vec.tobytes()], "sizes": [[len(x) for x in graph.links]], "links": [[x.tobytes() for x in graph.links]]})

        sharded = self.rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(self.shards)).cast("int"))
        built = sharded.groupBy("shard").applyInPandas(build, f"shard int, keys array<{self.id_type}>, many binary, vec binary, sizes array<int>, links array<binary>")
        #: one row a shard
        self.graphs = materialise(built)

    def neighbours(self, k: int = 10, beam: int = 96, of: Callable[[Column], Column] | None = None, block_rows: int = 8192) -> DataFrame:
        """(id, rank, neighbour, distance): the k nearest others of every row, or of those whose id passes ``of``.

        Queries go to each shard in blocks, a row a block; a shard's graph is sent once, ahead of them.
        """
        t, dim = self.id_type, self.dim
        asked = self.rows if of is None else self.rows.filter(of(F.col("id")))

        @lean
        def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), block_rows):
                    part = pdf.iloc[at : at + block_rows]
                    yield pd.DataFrame({"ids": [part["id"].to_numpy()], "q": [_units(part["v"], dim).tobytes()]})

        queries = asked.mapInPandas(blocks, f"ids array<{t}>, q binary").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))))
        parts = {"ids": f"array<{t}>", "q": "binary", "keys": f"array<{t}>", "many": "binary", "vec": "binary", "sizes": "array<int>", "links": "array<binary>"}
        row = lambda kind, there: ["shard", F.lit(kind).alias("kind"), *(F.col(c) if c in there else F.lit(None).cast(x).alias(c) for c, x in parts.items())]
        both = self.graphs.select(row(0, self.graphs.columns)).unionByName(queries.select(row(1, queries.columns)))

        @lean
        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            graph = None
            for pdf in batches:
                for g in pdf.itertuples():
                    if g.kind == 0:
                        links = [np.frombuffer(x, dtype=np.int32).reshape(n, -1) for x, n in zip(g.links, g.sizes)]
                        graph, keys = Graph(np.frombuffer(g.vec, dtype=np.float32).reshape(-1, dim), links), np.asarray(g.keys)
                        count = np.frombuffer(g.many, dtype=np.int32).astype(np.int64)
                        start, shard = np.cumsum(count) - count, g.shard
                    elif graph is not None and shard == g.shard:
                        yield answers(graph, keys, count, start, np.asarray(g.ids), np.frombuffer(g.q, dtype=np.float32).reshape(-1, dim))

        def answers(graph: Graph, keys: np.ndarray, count: np.ndarray, start: np.ndarray, ids: np.ndarray, vec: np.ndarray) -> pd.DataFrame:
            out_n, out_d = [], []
            for a, dist, node in graph.search(vec, max(beam, k + 1)):
                for i in range(len(node)):
                    own = ids[a + i]
                    met: set = set()  # distinct distances and keys
                    far = math.inf
                    for d, x in zip(dist[i].tolist(), node[i].tolist()):
                        d = max(0.0, round(d, 6))
                        if x < 0 or d > far:
                            break
                        for other in keys[start[x] : start[x] + min(count[x], k + 1)].tolist():
                            if other != own:
                                met.add((d, other))
                        if len(met) >= k and far == math.inf:
                            far = d
                    best = sorted(met)[:k]
                    out_n.append([x for _, x in best])
                    out_d.append([x for x, _ in best])
            return pd.DataFrame({"id": ids, "ns": out_n, "ds": out_d})

        found = both.repartitionById(self.shards, "shard").sortWithinPartitions("shard", "kind").mapInPandas(look, f"id {t}, ns array<{t}>, ds array<double>")
        # k a shard and row: the merge sends nothing else
        pair = F.arrays_zip(F.col("ds").alias("d"), F.col("ns").alias("n"))
        merged = found.select("id", pair.alias("p")).groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))), 1, k).alias("best"))
        return merged.select("id", F.posexplode("best").alias("rank", "p")).select("id", (F.col("rank") + 1).alias("rank"), F.col("p.n").alias("neighbour"), F.col("p.d").alias("distance"))


def neighbours(rows: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", beam: int = 96, of: Callable[[Column], Column] | None = None, **options) -> DataFrame:
    """(key, rank, neighbour, distance) of the k nearest others by cosine distance, of every row or of those whose key passes ``of``."""
    return Search(rows, key, vector, **options).neighbours(k, beam, of).withColumnRenamed("id", key)
