"""SimHash near-duplicates found by pigeonring filtering.

A fingerprint is cut into m segments on a ring. If two fingerprints differ in at most t bits, some chain of consecutive
segments exists whose first l segments differ in at most l * t / m bits for every l. With t < m the chain's first
segment is equal in both, which makes it a join key; the next one differs in few bits, which sharpens the key; the
longer prefixes prune candidates before the full Hamming check.

Equal texts and equal fingerprints are folded before any pairing. A bucket larger than a block is split by hash into
blocks, and every pair of blocks is a unit of its own, so no task holds an unbounded bucket and no candidate is
dropped. A unit returns a spanning forest of its links, not all its pairs, which leaves the components unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatium.llm.common import among, cut, giving_back, keyed_join, runs
from collatium.llm.components import components

#: Rows of a block; a unit holds two blocks at most.
BLOCK = 2048


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of an A-Z lower-cased text, repeats included, as big-endian integers.

    Words are runs without ASCII white space. A text of fewer than ``size`` words is one shingle, one of none has none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=">u8")
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    spans = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)
    return np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in spans]), dtype=">u8")


def spread(h: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself; others are independent mixes of it."""
    if not lane:
        return h
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * lane & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(">u8")


def simhash(h: np.ndarray, lanes: int) -> list[int]:
    """Signed 64-bit words of the fingerprint: a bit is 1 if set in over half of the hashes."""
    out = []
    for lane in range(lanes):
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(h), 32768):
            part = np.ascontiguousarray(spread(h[i : i + 32768], lane))
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h)).view(">i8")[0]) if len(h) else 0)
    return out


def fingerprints(docs: DataFrame, key: str, text: str, size: int, lanes: int = 1, distinct: bool = False) -> DataFrame:
    """(key long, f0 .. long, n long): the fingerprint of each text. distinct: each shingle counts once. n: shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = [], []
            for value in batch.column(1):
                h = shingle_hashes(value.as_py(), size)
                h = np.unique(h) if distinct else h
                words.append(simhash(h, lanes))
                n.append(len(h))
            cols = list(zip(*words, strict=True)) if words else [[] for _ in range(lanes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols], pa.array(n, pa.int64())], names=["key", *[f"f{i}" for i in range(lanes)], "n"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, ", ".join(["key long", *[f"f{i} long" for i in range(lanes)], "n long"]))


def _bits(word: str, at: int, n: int) -> str:
    """SQL for bits at .. at + n - 1 of a long, from the least significant."""
    return f"(shiftrightunsigned({word}, {at}) & {(1 << n) - 1}L)"


def ring_keys(prints: DataFrame, lanes: int, segments: int, deep: bool) -> DataFrame:
    """prints with one row for every key of every chain start: bucket, start and own (false for a probe).

    deep (for t < segments): the key is the start segment and its successor, which may differ in one bit; the side
    whose bit is set probes with the bit cleared, so each pair meets once.
    """
    width = 64 * lanes // segments
    seg = [_bits(f"f{s * width // 64}", s * width % 64, width) for s in range(segments)]
    keys = []
    for s in range(segments):
        if not deep:
            keys.append(f"named_struct('bucket', {s << width}L + {seg[s]}, 'own', true)")
            continue
        follow = seg[(s + 1) % segments]
        base = f"{s << 2 * width}L + shiftleft({seg[s]}, {width}) + {follow}"
        keys.append(f"named_struct('bucket', {base}, 'own', true)")
        keys += [f"if({follow} & {1 << b}L <> 0, named_struct('bucket', {base} - {1 << b}L, 'own', false), null)" for b in range(width)]
    return prints.select("*", F.expr(f"explode(array({', '.join(keys)}))").alias("_k")).filter("_k is not null").select(*prints.columns, "_k.bucket", "_k.own")


def units(rows: DataFrame, block: int) -> DataFrame:
    """rows (node, bucket, own, ...) dealt to units (bucket, lo, hi): buckets of one row or none of its own are left out,
    large ones are split into blocks, and every pair of blocks is a unit."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("own").alias("any")).filter("n > 1 and any").select("bucket", "n", F.ceil(F.col("n") / block).cast("int").alias("nb"))
    return in_blocks(rows, cut(sizes)).drop("own")


def in_blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows (node, bucket, ...) of the buckets in sizes (bucket, n rows, nb blocks), once for each pair of blocks they belong to.

    A bucket larger than a block thus gives each row as many times as it has blocks: all its pairs must be looked at, and
    this is how they are dealt to bounded tasks.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    dealt = keyed_join(rows, sizes, ["bucket"], "n", total).withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    return (
        dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumns({"lo": F.least("b", "x"), "hi": F.greatest("b", "x")})
        .drop("nb", "x", "b")
    )


def pigeonring(a: np.ndarray, b: np.ndarray, segments: int, most: int, chain: int = 3) -> np.ndarray:
    """Which rows of a and b (uint64 words) differ in at most ``most`` bits; chains prune before the whole count."""
    x = a ^ b
    width = 64 * x.shape[-1] // segments
    parts = np.bitwise_count(np.ascontiguousarray(x).view({8: np.uint8, 16: np.uint16, 32: np.uint32}[width]))
    viable = np.zeros(parts.shape[:-1], dtype=bool)
    total = parts
    for length in range(1, chain + 1):
        if length > 1:
            total = total + np.roll(parts, 1 - length, axis=-1)
        fits = total <= length * most // segments
        ok = fits if length == 1 else ok & fits
    viable = ok.any(axis=-1)
    out = np.zeros_like(viable)
    at = np.nonzero(viable)
    out[at] = parts[at].sum(-1, dtype=np.int64) <= most
    return out


def forest(size: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of 0 .. size - 1 under ``linked(i, others) -> mask``, breadth first."""
    left, out = np.arange(size), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            mask = linked(i, left)
            found = left[mask]
            left = left[~mask]
            out.extend((i, int(j)) for j in found)
            queue.extend(found.tolist())
    return out


def pairing(names: list[str], linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    """For mapInArrow: edges (a, b) of each sorted unit (bucket, lo, hi, node, names) that span its links; ``linked`` compares rows of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, at in runs(batches, ["bucket", "lo", "hi"]):
            node = piece.column("node").to_numpy()
            f = np.stack([piece.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
            size = np.diff(at)
            edges_a, edges_b = [], []
            of = np.repeat(np.arange(len(size)), size)
            small = size[of] <= 16
            for step in range(1, 16):
                i = np.flatnonzero((of[step:] == of[:-step]) & small[step:])
                if not len(i):
                    break
                hit = i[linked(f[i], f[i + step])]
                edges_a.append(node[hit])
                edges_b.append(node[hit + step])
            for k in np.flatnonzero(size > 16):
                own, name = f[at[k] : at[k + 1]], node[at[k] : at[k + 1]]
                tree = forest(len(own), lambda i, others: linked(own[i][None, :], own[others]))  # noqa: B023
                if tree:
                    i, j = np.array(tree).T
                    edges_a.append(name[i])
                    edges_b.append(name[j])
            if edges_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(edges_a)), pa.array(np.concatenate(edges_b))], names=["a", "b"])

    return run


def links(prints: DataFrame, lanes: int, segments: int, most: int, deep: bool, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between nodes whose fingerprints differ in at most ``most`` bits, enough to span their components.

    prints: distinct fingerprints as (node long, f0 ..). Complete for most < segments; beyond that it finds the pairs
    that have an equal segment.
    """
    dealt = units(ring_keys(prints, lanes, segments, deep), block)
    names = [f"f{i}" for i in range(lanes)]

    keyed = dealt.select("bucket", "lo", "hi", "node", *names).repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return keyed.mapInArrow(pairing(names, lambda a, b: pigeonring(a, b, segments, most)), "a long, b long").filter("a <> b").distinct()


def fingerprint_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, most: int = 3, segments: int = 4) -> DataFrame:
    """(key, fingerprint, component_id): 64-bit fingerprints linked at ``most`` differing bits or fewer.

    component_id is the smallest key reachable. A null or wordless text has fingerprint 0 and is linked like any other;
    a null key stays null and names no component of its own. Repeated keys each keep their row.
    """
    assert most < segments, "the chain's first segment is equal only if the bits are fewer than the segments"
    rows = cut(fingerprints(docs, key, text, size).drop("n"))
    folded = cut(rows.groupBy("f0").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    # the fingerprint itself is the node: no key is needed, and equal fingerprints are one node
    edges = links(folded.select(F.col("f0").alias("node"), "f0"), 1, segments, most, deep=True)
    comp = components(edges)
    named = cut(folded.join(comp, folded.f0 == comp.node, "left").select("f0", "least", "n", F.coalesce("component", "f0").alias("component")))
    least = cut(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("m"), F.sum("n").alias("rows")))
    total = least.agg(F.sum("rows")).first()[0] or 0
    labels = cut(keyed_join(named, least.drop("rows"), ["component"], "m", total).select("f0", "n", "component_id"))
    return keyed_join(rows, labels, ["f0"], "n", total).select(F.col("key").alias(key), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: Near-duplicate stage: words of a shingle; bands of a signature, minima of a band; bytes kept of a shingle's hash.
NEAR_SHINGLE, BANDS, MINIMA, KEPT = 5, 24, 5, 5
#: Texts are near if they have this share of their shingles in common, or more; bytes of hashes in a block.
NEAR, NEAR_BLOCK = (4, 5), 4 << 20
#: Words of a fingerprint, segments on its ring, bits that may differ. Sets at 0.8 differ in 39 of 256 bits, with a
#: deviation of 6; unrelated ones in 128. The bound lies over six deviations above the first.
NEAR_LANES, NEAR_SEGMENTS, NEAR_BITS = 4, 16, 80
_TIMES, _PLUS = (np.random.default_rng(seed).integers(0, 1 << 64, BANDS * MINIMA, dtype=np.uint64) | np.uint64(1) for seed in (1, 2))


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key for each band of the MinHash signature of distinct hashes. Sets at 0.8 have an equal one at odds of 0.9999."""
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(h), 1024):
            z = h[i : i + 1024, None] * _TIMES + _PLUS
            least = np.minimum(least, ((z ^ (z >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).min(0))
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in least.reshape(BANDS, MINIMA).T:
            key = (key ^ column) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(31)
    return key.view(np.int64)


def prefix_keys(h: np.ndarray) -> np.ndarray:
    """The first hashes of an ascending set: two sets with NEAR in common share one of theirs without exception."""
    low, high = NEAR
    return h[: len(h) - -(-low * len(h) // high) + 1].astype(np.uint64).view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, size: int, exact: bool = False) -> DataFrame:
    """(key long, same binary, bytes long, bands array<long>): a digest of each text's distinct shingles, the bytes that hash_sets
    has of them, and the keys by which candidates meet. A wordless text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, sizes, keys = [], [], []
            for value in batch.column(1):
                h = np.unique(shingle_hashes(value.as_py(), size))
                same.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(KEPT * len(h))
                keys.append((prefix_keys(h) if exact else band_keys(h.astype(np.uint64))) if len(h) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["key", "same", "bytes", "bands"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(giving_back(run), "key long, same binary, bytes long, bands array<long>")


def hash_sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(node long, hashes binary, f0 .. long): the first KEPT bytes of each of a text's distinct shingles, ascending, and their SimHash."""
    names = [f"f{i}" for i in range(NEAR_LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, prints = [], []
            for value in batch.column(1):
                h = np.unique(shingle_hashes(value.as_py(), size))
                hashes.append(np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :KEPT]).tobytes())
                prints.append(simhash(h, NEAR_LANES))
            words = [pa.array([p[i] for p in prints], pa.int64()) for i in range(NEAR_LANES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary()), *words], names=["node", "hashes", *names])

    return docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text")).mapInArrow(giving_back(run), ", ".join(["node long", "hashes binary", *[f"{n} long" for n in names]]))


def alike(sets: list[bytes], prints: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the sets that are near by count, among those that the pigeonring lets pass; no set is empty."""
    size = np.array([len(x) // KEPT for x in sets])
    start = np.cumsum(size) - size
    wide = np.zeros((int(size.sum()), 8), dtype=np.uint8)
    wide[:, :KEPT] = np.frombuffer(b"".join(sets), dtype=np.uint8).reshape(-1, KEPT)
    _, ids = np.unique(wide.reshape(-1).view(np.uint64), return_inverse=True)
    flag = np.zeros(int(ids.max()) + 1, dtype=np.int64)
    low, high = NEAR

    def linked(i: int, others: np.ndarray) -> np.ndarray:
        own, n = ids[start[i] : start[i] + size[i]], size[others]
        # the shorter set is at least that share of the longer one
        fits = (high * np.minimum(n, size[i]) >= low * np.maximum(n, size[i])).nonzero()[0]
        fits = fits[pigeonring(prints[i][None, :], prints[others[fits]], NEAR_SEGMENTS, NEAR_BITS)] if len(fits) else fits
        out = np.zeros(len(others), dtype=bool)
        if len(fits):
            n, first = n[fits], start[others[fits]]
            ends = np.cumsum(n)
            flag[own] = 1
            common = np.add.reduceat(flag[ids[np.arange(ends[-1]) + np.repeat(first - ends + n, n)]], ends - n)
            flag[own] = 0
            out[fits] = high * common >= low * (n + size[i] - common)
        return out

    return forest(len(sets), linked)


def near_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: edges (a, b) of each sorted unit (bucket, lo, hi, node, hashes, f0 ..) that span its near sets."""
    for piece, at in runs(batches, ["bucket", "lo", "hi"]):
        node, hashes = piece.column("node").to_numpy(), piece.column("hashes")
        prints = np.stack([piece.column(f"f{i}").to_numpy() for i in range(NEAR_LANES)], axis=1).view(np.uint64)
        a, b = [], []
        for k, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            for i, j in alike(hashes.slice(k, end - k).to_pylist(), prints[k:end]) if end - k > 1 else ():
                a.append(node[k + i])
                b.append(node[k + j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_labels(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = NEAR_SHINGLE, block: int = NEAR_BLOCK, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): rows (key, same) for every row, same being a digest of its shingles; labels (same, n, node, group) for
    every distinct set, with its rows, the smallest key of them, and the smallest key that near sets reach.

    Two texts are near if NEAR of their distinct shingles are common, which is counted for all that share a band of a
    MinHash signature (exact: that share one of their first shingles by hash, which leaves out no pair) and whose SimHash
    chains stay within their budgets. Equal sets are one node; texts without words are near each other. Buckets of equal
    members are one. Keys must be distinct and not null.
    """
    rows = cut(signatures(docs, key, text, size, exact))
    folded = cut(rows.groupBy("same").agg(F.min("key").alias("node"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.max("bytes").alias("bytes")))
    keys = folded.select("node", "bytes", F.explode("bands").alias("bucket"))
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("mark")).filter("n > 1")
    sizes = cut(sizes.groupBy("n", "bytes", "least", "mark").agg(F.min("bucket").alias("bucket")).select("bucket", "n", F.ceil(F.col("bytes") / block).cast("int").alias("nb")))
    dealt = cut(in_blocks(keys.select("node", "bucket"), sizes))
    # only texts that meet another are hashed again, where they lie
    met = among(docs.select(F.col(key).cast("long").alias("node"), text), dealt.select("node").distinct())
    names = [f"f{i}" for i in range(NEAR_LANES)]
    sets = dealt.join(hash_sets(met, "node", text, size), "node")
    keyed = sets.select("bucket", "lo", "hi", "node", "hashes", *names).repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    comp = components(keyed.mapInArrow(giving_back(near_edges), "a long, b long").distinct())
    labels = folded.select("same", "n", "node").join(comp, "node", "left").select("same", "n", "node", F.coalesce("component", "node").alias("group"))
    return rows.select("key", "same"), labels


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = NEAR_SHINGLE, block: int = NEAR_BLOCK, exact: bool = False) -> DataFrame:
    """(key, group) for every row whose text is near that of another; group is the smallest key reachable. See near_labels."""
    rows, labels = near_labels(docs, key, text, size, block, exact)
    labels = cut(labels)
    groups = cut(labels.groupBy("group").agg(F.sum("n").alias("members"), F.count("*").alias("sets")))
    total = groups.agg(F.sum("members")).first()[0] or 0
    many = cut(keyed_join(labels, groups.filter("members > 1"), ["group"], "sets", total).select("same", "n", "group"))
    return keyed_join(rows, many, ["same"], "n", total).select(F.col("key").alias(key), "group")


def keep_one(docs: DataFrame, order: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest ``order`` (nulls last), then the first read.

    Rows are named by their place in ``docs``, which must read alike each time, as a table does. Of equal sets of shingles
    one row is chosen first, by a grouped minimum, so no row is joined by a key that others share.
    """
    placed = docs.withColumn("_row", F.monotonically_increasing_id())
    rows, labels = near_labels(placed, "_row", text, exact=exact)
    rank = F.struct(F.col("_order").isNull().alias("null"), "_order", "_row")
    known = placed.select("_row", F.col(order).alias("_order")).join(rows.withColumnRenamed("key", "_row"), "_row")
    best = known.groupBy("same").agg(F.min(rank).alias("best"))
    kept = labels.select("same", "group").join(best, "same").groupBy("group").agg(F.min("best")["_row"].alias("_row")).select("_row")
    gone = rows.select(F.col("key").alias("_row")).join(kept, "_row", "left_anti")
    return among(placed, gone, "left_anti").drop("_row")
