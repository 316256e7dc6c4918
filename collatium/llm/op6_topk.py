"""Exact top-k inner products by a pivot-distance index.

Vectors are quantised to integers. With M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the largest products are the nearest points. Every point is keyed by its nearest
pivot and its distance to it; a pivot's points, sorted by distance, are cut into blocks, which are annuli. By the
triangle inequality no point of an annulus [lo, hi] is nearer to q' than max(0, lo - |q' - p|, |q' - p| - hi). A search
expands from the annulus that holds the query's own distance and stops where that bound rules out the k-th best.
Queries come in blocks of neighbouring pivots. For every pivot a block's queries span intervals of distance, and only the
spans of annuli that meet one of them are sent to the block: that join reads bounds alone, before any vector moves.

A bounded sample (SEEDS rows by hash, fewer of each where vectors have many lengths) comes to the driver: its first rows are the pivots, and each query's k-th best
product with the sample is where its bound starts; neither affects the result. A pivot that owns a third of all rows
has more annuli, no larger ones: rows are dealt to them by a sort over all partitions, and a search task gets SPAN at most.
Null or empty vectors, null ids and vectors with components that are null or not finite (also once scaled) take no part;
zero vectors do. Vectors of different lengths are never paired. Where squares pass a double's range no bound is finite,
and every annulus is read whole. Ties go to the smaller id. Products are computed in integers; where they could pass 2^62, in Python's unbounded ones, and a product
beyond a long's range is returned as the nearest long. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatium.llm import vectors
from collatium.llm.common import cut, keyed_join, runs, top_rows

#: Sampled rows and pivots of a vector length, rows of an annulus, annuli of a task, queries of a block, annuli of a task that compares bounds.
SEEDS, PIVOTS, BLOCK, SPAN, QUERIES, BOUNDS = 1024, 48, 2048, 8, 2048, 4096
LONG = (1 << 63) - 1


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of q and rows of x (whole numbers as doubles)."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if top < 2.0**53:
        return np.rint(q @ x.T).astype(np.int64)
    if top < 2.0**62:
        return q.astype(np.int64) @ x.T.astype(np.int64)
    a, b = (np.array([[int(y) for y in row] for row in z], dtype=object) for z in (q, x))
    return np.array([[max(-LONG - 1, min(LONG, int(y))) for y in row] for row in a @ b.T], dtype=np.int64)


def _lift(x: np.ndarray, m2: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0.0, m2 - (x * x).sum(1)))[:, None]], axis=1)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between rows of a and rows of b."""
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)))


def quantise(rows: DataFrame, scale: float) -> DataFrame:
    """Components as whole numbers, floor(scale * x) in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            whole = pa.ListArray.from_arrays(v.offsets, pa.array(np.floor(scale * v.values.to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), whole, batch.column("dim")], names=["id", "v", "dim"])

    fit = rows.filter(F.forall("v", lambda x: F.abs(x * scale) < float("inf")))
    return fit.select("id", "v", "dim").mapInArrow(run, "id long, v array<double>, dim int")


def sampled(rows: DataFrame, seeds: int) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For every vector length: ids and vectors of a bounded sample by hash, and M^2. Beyond 16 lengths they share 16 * seeds rows, 8 at least for each."""
    norms = {r.dim: r.m2 for r in rows.groupBy("dim").agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m2")).collect()}
    each = min(seeds, max(8, 16 * seeds // max(1, len(norms))))
    picked = top_rows(rows.withColumn("_h", F.xxhash64("id")), "dim", [F.asc("_h"), F.asc("id")], each).select("dim", "rank", "id", "v").collect()
    of: dict[int, list] = {}
    for r in sorted(picked, key=lambda r: (r.dim, r.rank)):
        of.setdefault(r.dim, []).append(r)
    return {d: (np.array([p.id for p in got], dtype=np.int64), np.array([p.v for p in got]), norms[d]) for d, got in of.items()}


def starts(q_ids: np.ndarray, q: np.ndarray, sample: tuple[np.ndarray, np.ndarray, float], pivots: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each query's distances to the pivots, |q|^2, the product its k-th best has at least, and the slack of squared distances."""
    s_ids, s_x, m2 = sample
    far = _gaps(np.concatenate([q, np.zeros((len(q), 1))], axis=1), _lift(s_x[:pivots], m2))
    own = (q * q).sum(1)
    # the k-th best product with the sample, own row left out
    first = np.where(q_ids[:, None] == s_ids[None, :], -LONG - 1, products(q, s_x))
    floor = np.sort(first, axis=1)[:, -k] if len(s_ids) > k else np.full(len(q), -LONG - 1)
    return far, own, floor, 1e-6 * (own + m2 + 1)


def intervals(q_ids: np.ndarray, q: np.ndarray, sample: tuple[np.ndarray, np.ndarray, float], pivots: int, k: int) -> Iterator[tuple[int, float, float]]:
    """(pivot, lo, hi), disjoint for a pivot: the distances at which a point may be among the k best of one of the queries."""
    far, own, floor, slack = starts(q_ids, q, sample, pivots, k)
    reach = np.sqrt(np.maximum(0.0, own + sample[2] - 2.0 * floor + slack)) * (1 + 1e-9)
    for p in range(far.shape[1]):
        lo, hi = far[:, p] - reach, far[:, p] + reach
        if not (np.isfinite(lo).all() and np.isfinite(hi).all()):
            yield p, -np.inf, np.inf
            continue
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], np.maximum.accumulate(hi[order])
        new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
        yield from zip([p] * len(new), lo[new].tolist(), hi[np.append(new[1:], len(lo)) - 1].tolist(), strict=True)


def search(q_ids: np.ndarray, q: np.ndarray, annuli: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], sample: tuple[np.ndarray, np.ndarray, float], pivots: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, id, product) for what may be among each query's k largest. annuli: (pivot, ids, vectors, sorted distances)."""
    m2 = sample[2]
    far, own, floor, slack = starts(q_ids, q, sample, pivots, k)
    best: list[list[tuple[int, int]]] = [[] for _ in q_ids]
    low = np.array([[max(0.0, d[0] - f, f - d[-1]) for p, _, _, d in annuli for f in (far[i, p],)] for i in range(len(q))])
    order = np.argsort(low, axis=1, kind="stable")

    def ruled_out(rows: np.ndarray, gap: np.ndarray) -> np.ndarray:
        return gap * gap > own[rows] + m2 - 2.0 * floor[rows] + slack[rows]

    for step in range(len(annuli)):
        for a, (p, ids, x, dist) in enumerate(annuli):
            rows = np.flatnonzero(order[:, step] == a)
            rows = rows[~ruled_out(rows, low[rows, a])]
            if not len(rows):
                continue
            reach = np.sqrt(np.maximum(0.0, own[rows] + m2 - 2.0 * floor[rows] + slack[rows]))
            start, stop = np.searchsorted(dist, (far[rows, p] - reach).min()), np.searchsorted(dist, (far[rows, p] + reach).max(), side="right")
            if not np.isfinite(reach).all():
                start, stop = 0, len(dist)
            got, names = products(q[rows], x[start:stop]), ids[start:stop]
            for r, line in zip(rows.tolist(), got, strict=True):
                hit = np.flatnonzero((line >= floor[r]) & (names != q_ids[r]))
                if not len(hit):
                    continue
                if len(hit) > 4 * k:  # whatever is under the k-th of these is out; ties stay
                    hit = hit[line[hit] >= np.partition(line[hit], len(hit) - k)[len(hit) - k]]
                best[r] = sorted([*best[r], *((-int(line[h]), int(names[h])) for h in hit)])[:k]
                if len(best[r]) == k:
                    floor[r] = max(floor[r], -best[r][-1][0])
    for r, found in enumerate(best):
        for score, name in found:
            yield int(q_ids[r]), name, -score


def blocks(asked: DataFrame) -> DataFrame:
    """Queries with the int column ``block``: about QUERIES of each vector length and of neighbouring pivots, by a count for each pivot."""
    counts = cut(asked.groupBy("dim", "pivot").agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    before = Window.partitionBy("dim").orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1)
    starts_at = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_slots", F.col("_n"))
    placed = keyed_join(asked.select("id", "v", "dim", "pivot"), starts_at, ["dim", "pivot"], "_n", total)
    return placed.select("id", "v", "dim", F.floor((F.col("_before") + F.pmod(F.xxhash64("id", F.lit(1)), "_slots")) / QUERIES).cast("int").alias("block"))


def largest(table: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, <key>, score): each query's k largest products with all other rows. queries: a condition on ``id``."""
    rows = cut(quantise(vectors.clean(table, key, vector, zero_ok=True), scale))
    known = sampled(rows, SEEDS)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            pivot, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = batch.column("v").take(pa.array(at)).flatten().to_numpy().reshape(-1, d)
                _, s_x, m2 = known[d]
                gaps = _gaps(_lift(x, m2), _lift(s_x[:pivots], m2))
                pivot[at], far[at] = gaps.argmin(1), gaps.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(far)], names=[*batch.schema.names, "pivot", "far"])

    points = cut(rows.mapInArrow(keyed, "id long, v array<double>, dim int, pivot int, far double"))
    total = points.count()
    # annuli are cut by a sort over all partitions, so that a hot pivot or distance fills many of them
    ordered = points.repartitionByRange(max(1, -(-total // (4 * block))), "dim", "pivot", "far", "id").sortWithinPartitions("dim", "pivot", "far", "id")

    def annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for piece, at in runs(batches, ["dim", "pivot"]):
            for a, b in ((i, min(i + block, e)) for s, e in zip(at[:-1], at[1:], strict=True) for i in range(s, e, block)):
                part = piece.slice(a, b - a)
                arrays = [pa.array([x], pa.binary()) for x in (part.column("id").to_numpy().tobytes(), vectors.narrow(part.column("v").flatten().to_numpy()), part.column("far").to_numpy().tobytes())]
                far = part.column("far").to_numpy()
                ends = (far[0], far[-1]) if np.isfinite(far).all() else (-np.inf, np.inf)
                yield pa.RecordBatch.from_arrays([part.column("dim").slice(0, 1), part.column("pivot").slice(0, 1), *arrays, pa.array([made // SPAN], pa.int32()), *(pa.array([x]) for x in ends)], names=["dim", "pivot", "ids", "vs", "fars", "span", "lo", "hi"])
                made += 1

    index = cut(ordered.mapInArrow(annuli, "dim int, pivot int, ids binary, vs binary, fars binary, span int, lo double, hi double").withColumn("part", F.spark_partition_id()))
    packed = cut(vectors.pack(blocks(points.filter(queries)), ["dim", "block"]))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = list(intervals(*vectors.unpack(row["ids"], row["vs"]), known[row["dim"]], pivots, k))
                pivot, lo, hi = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([row["dim"]] * len(found), pa.int32()), pa.array([row["block"]] * len(found), pa.int32()), pa.array(pivot, pa.int32()), pa.array(lo), pa.array(hi)], names=["dim", "block", "pivot", "reach_lo", "reach_hi"])

    # bounds alone decide which block meets which span of annuli; a hot pivot's annuli are dealt to several tasks
    bounds = index.select("dim", "part", "span", "pivot", "lo", "hi")
    deals = max(1, -(-bounds.count() // BOUNDS))
    near = packed.mapInArrow(reached, "dim int, block int, pivot int, reach_lo double, reach_hi double").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    bounds = bounds.withColumn("deal", F.pmod(F.xxhash64("part", "span"), F.lit(deals)).cast("int"))
    meet = cut(bounds.join(near, ["dim", "pivot", "deal"]).filter((F.col("lo") <= F.col("reach_hi")) & (F.col("hi") >= F.col("reach_lo"))).select("dim", "block", "part", "span").distinct())
    keys = ["dim", "block", "part", "span"]
    pairs = index.drop("lo", "hi").join(meet, ["dim", "part", "span"]).join(packed.select("dim", "block", F.col("ids").alias("qids"), F.col("vs").alias("qvs")), ["dim", "block"])
    pairs = pairs.repartition(*keys).sortWithinPartitions(*keys, "pivot")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, at in runs(batches, keys):
            for a, b in zip(at[:-1], at[1:], strict=True):
                got = [{c: piece.column(c)[i].as_py() for c in ("dim", "pivot", "ids", "vs", "fars")} for i in range(a, b)]
                q_ids, q = vectors.unpack(piece.column("qids")[int(a)].as_py(), piece.column("qvs")[int(a)].as_py())
                parts = [(g["pivot"], *vectors.unpack(g["ids"], g["vs"]), np.frombuffer(g["fars"])) for g in got]
                found = list(search(q_ids, q, parts, known[got[0]["dim"]], pivots, k))
                cols = list(zip(*found, strict=True)) if found else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "hit", "score"])

    hits = pairs.mapInArrow(find, "query_id long, hit long, score long")
    return top_rows(hits, "query_id", [F.desc("score"), F.asc("hit")], k).select("query_id", "rank", F.col("hit").alias(key), "score")
