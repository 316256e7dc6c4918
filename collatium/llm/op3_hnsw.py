"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, shard results merged.

Rows are dealt to shards of bounded size by a hash of their id, so copies of one vector spread over all shards; in a
shard, equal vectors are one graph node that lists its ids. A node's neighbours are stored as flat arrays: layer 0 in
one (n, 2m) block, upper layers in one (n, m) block each, -1 for none. The index is a table with a row for each shard.
Queries go through every shard in blocks, each block keeps the k nearest, and a ranked window merges the shards. A shard
by hash says nothing of where its vectors lie, so each must be asked; what is shipped is a copy of the index for every
QUERIES queries, in the smallest number type that is exact.

Null, zero, and non-finite vectors take no part, neither do null ids; vectors of another length are searched apart. Ties go to the
smaller id. Distances are computed in double precision on the original vectors, infinite where a square passes its range.
Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatium.llm import vectors
from collatium.llm.common import cut, top_rows

#: Rows of a shard, links of a node, breadth of building and of searching, queries of a block.
SHARD, LINKS, BUILD, SEARCH, QUERIES = 4096, 12, 48, 96, 4096


#: Partitions that the pairs of shards and query blocks are dealt to at most.
TASKS = 100_000


class Graph:
    """The graph of one shard's distinct vectors."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], entry: int):
        self.x, self.layers, self.entry = x, layers, entry

    @staticmethod
    def build(x: np.ndarray, m: int = LINKS, breadth: int = BUILD, seed: int = 7) -> Graph:
        n = len(x)
        levels = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int), 8)
        g = Graph(x, [np.full((n, 2 * m if k == 0 else m), -1, dtype=np.int32) for k in range(int(levels.max(initial=0)) + 1)], 0)
        top = int(levels[0]) if n else 0
        for i in range(1, n):
            at, level = [(float(((x[g.entry] - x[i]) ** 2).sum()), g.entry)], int(levels[i])
            for k in range(top, -1, -1):
                at = g.near(x[i], at, k, breadth if k <= level else 1)
                if k <= level:
                    picked = g.pick(at, m)
                    g.layers[k][i, : len(picked)] = picked
                    for j in picked:
                        g.link(j, i, k)
            if level > top:
                top, g.entry = level, i
        return g

    def pick(self, found: list[tuple[float, int]], m: int) -> list[int]:
        """The nearest first, without those that lie nearer to one already picked; filled up with the nearest left out."""
        ids = np.fromiter((j for _, j in found), np.int64, len(found))
        y = self.x[ids]
        sq = (y * y).sum(1)
        between = sq[:, None] + sq[None, :] - 2 * (y @ y.T)
        out: list[int] = []
        for a, (d, _) in enumerate(found):
            if len(out) < m and (not out or between[a, out].min() > d):
                out.append(a)
        if len(out) < m:
            taken = set(out)
            out += [a for a in range(len(found)) if a not in taken][: m - len(out)]
        return ids[out].tolist()

    def link(self, j: int, i: int, k: int) -> None:
        row = self.layers[k][j]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = i
            return
        ids = np.append(row, i)
        d = ((self.x[ids] - self.x[j]) ** 2).sum(1)
        order = np.argsort(d, kind="stable")
        picked = self.pick(list(zip(d[order].tolist(), ids[order].tolist(), strict=True)), len(row))
        row[:] = -1
        row[: len(picked)] = picked

    def near(self, q: np.ndarray, start: list[tuple[float, int]], k: int, breadth: int) -> list[tuple[float, int]]:
        """The ``breadth`` nearest nodes found from ``start`` in layer k, nearest first."""
        x, links = self.x, self.layers[k]
        seen = {j for _, j in start}
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, -j) for d, j in start]
        heapq.heapify(best)
        while todo:
            d, j = heapq.heappop(todo)
            if len(best) >= breadth and d > -best[0][0]:
                break
            new = [t for t in links[j].tolist() if t >= 0 and t not in seen]
            if not new:
                continue
            seen.update(new)
            gap = x[new] - q
            for e, t in zip(np.einsum("ij,ij->i", gap, gap).tolist(), new, strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (-e, -t))
                    heapq.heappush(todo, (e, t))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, -t))
                    heapq.heappush(todo, (e, t))
        return sorted((-d, -j) for d, j in best)

    def search(self, q: np.ndarray, breadth: int) -> list[tuple[float, int]]:
        at = [(float(((self.x[self.entry] - q) ** 2).sum()), self.entry)]
        for k in range(len(self.layers) - 1, 0, -1):
            at = self.near(q, at, k, 1)
        return self.near(q, at, 0, breadth)


def index(rows: DataFrame, shard: int = SHARD, m: int = LINKS, breadth: int = BUILD) -> DataFrame:
    """A row for each shard: dim, shard, ids, first (node offsets into ids), xs (distinct vectors), links (flat), widths, entry."""
    packed = vectors.pack(vectors.dealt(rows, shard, "shard"), ["dim", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, v = vectors.unpack(row["ids"], row["vs"])
                x, node = np.unique(v, axis=0, return_inverse=True)
                order = np.lexsort((ids, node.ravel()))
                first = np.concatenate(([0], np.cumsum(np.bincount(node.ravel(), minlength=len(x)))))
                mix = np.random.default_rng(len(x)).permutation(len(x))  # sorted vectors would make a poor order of insertion
                x, spans = x[mix], [ids[order[first[j] : first[j + 1]]] for j in mix]
                g = Graph.build(x, m, breadth)
                one = {
                    "dim": [row["dim"]], "shard": [row["shard"]], "ids": [np.concatenate(spans).tobytes()], "first": [np.cumsum([0, *map(len, spans)]).astype(np.int64).tobytes()],
                    "xs": [vectors.narrow(x.ravel())], "links": [b"".join(a.tobytes() for a in g.layers)], "widths": [[a.shape[1] for a in g.layers]], "entry": [g.entry],
                }
                yield pa.RecordBatch.from_pydict(one, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("first", pa.binary()), ("xs", pa.binary()), ("links", pa.binary()), ("widths", pa.list_(pa.int32())), ("entry", pa.int32())]))

    return packed.mapInArrow(run, "dim int, shard int, ids binary, first binary, xs binary, links binary, widths array<int>, entry int")


def nearest(table: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", breadth: int = SEARCH, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, <key>, score): each query's k nearest of all other rows. queries: a condition on the column ``id``."""
    rows = vectors.clean(table, key, vector, zero_ok=False)
    built = cut(index(rows, shard))
    packed = cut(vectors.pack(vectors.dealt(rows.filter(queries), QUERIES, "block", 1), ["dim", "block"]))
    # a stated query set against every shard, block by block, each pair a task of its own
    pairs = built.join(packed.select(F.col("dim"), "block", F.col("ids").alias("qids"), F.col("vs").alias("qvs")), "dim")
    tasks = built.select("dim").join(packed.select("dim"), "dim").count()
    pairs = pairs.repartition(max(1, min(tasks, TASKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids, first, d = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["first"], np.int64), row["dim"]
                x = vectors.wide(row["xs"]).reshape(-1, d)
                layers, flat, at = [], np.frombuffer(row["links"], np.int32), 0
                for w in row["widths"]:
                    layers.append(flat[at : at + w * len(x)].reshape(len(x), w))
                    at += w * len(x)
                g = Graph(x, layers, row["entry"])
                out_q, out_r, out_d = [], [], []
                qids, qv = vectors.unpack(row["qids"], row["qvs"])
                for q, v in zip(qids.tolist(), qv, strict=True):
                    got: list[tuple[float, int]] = []
                    for _, j in g.search(v, max(breadth, k + 1)):
                        gap = x[j] - v
                        dist = float(np.sqrt((gap * gap).sum()))
                        got += [(dist, t) for t in ids[first[j] : min(first[j + 1], first[j] + k + 1)].tolist() if t != q]
                    for dist, t in sorted(got)[:k]:
                        out_q.append(q)
                        out_r.append(t)
                        out_d.append(dist)
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_r, pa.int64()), pa.array(out_d, pa.float64())], names=["query_id", "hit", "score"])

    hits = pairs.mapInArrow(run, "query_id long, hit long, score double")
    return top_rows(hits, "query_id", [F.asc("score"), F.asc("hit")], k).select("query_id", "rank", F.col("hit").alias(key), "score")
