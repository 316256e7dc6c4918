"""Stupid-backoff scores of documents, computed relationally.

S(w | context) is c(context w) / c(context) where the n-gram occurs, else 0.4 times the score with a shorter context, at
last c(w) / N. Two scores come from one pass: log_score with the counts of the whole corpus, and held_out_score with
those of the corpus without the document itself, so that a text can't vouch for itself; there a word found nowhere else
scores 0.4 / N.

Texts are packed into blocks of whole documents: their distinct words by 64-bit hash, and the words' places. A block
names its distinct n-grams by as many bits of their hash as the corpus needs, SPARE more than its n-grams would fill (so
one in a million at most shares its name with another, up to a hash's 64 bits), with how often it has them; these are the exploded n-grams, and they are partitioned
by hash. A part sums the counts of its n-grams over all blocks, which is its share of the count table, and joins them to
the blocks' n-grams; its answer to a block is an array in the same order. Blocks and their answers meet by block, and are
summed per document. A common n-gram comes once from each block, and block and part sizes are bounded by constants, so no
key is hot. A part without an n-gram of a block sends it no row, so rows never outnumber the blocks' distinct n-grams.

A null or wordless text has no tokens and null scores. Repeated keys are scored row by row, each as a document of its
own: a copy is evidence for its original. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatium.llm.common import cut, release

#: Longest n-gram, backoff factor, bytes of a block's texts (a longer text is a block of its own), bytes of text for a part.
ORDER, BACKOFF, BLOCK, PART = 3, 0.4, 10 << 20, 8 << 20
#: Bits of an n-gram's name beyond those that number all n-grams of the corpus, and the fewest bits of a name.
SPARE, FEWEST = 20, 50
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 of the words (runs without white space) of a lower-cased text."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in (text or "").lower().encode("utf-8", "replace").split()], dtype=np.uint64)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def ngrams(words: np.ndarray, of: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 .. order: hashes of the n-grams that end at a word, and the words' positions. of: each word's document."""
    h, at = _mix(words), np.arange(len(words), dtype=np.int32)
    yield h, at
    for n in range(2, order + 1):
        inside = at[at >= n - 1]
        inside = inside[of[inside] == of[inside - n + 1]]
        h, at = _mix(h[np.searchsorted(at, inside - 1)] * _GOLD + words[inside]), inside
        yield h, at


def name_bits(tokens: int, order: int) -> int:
    return min(64, max(FEWEST, SPARE + (tokens * order).bit_length()))


def names_of(h: np.ndarray, bits: int) -> np.ndarray:
    """n-gram hashes as they are counted: their upper bits."""
    return h >> np.uint64(64 - bits)


def squeeze(x: np.ndarray, width: int) -> bytes:
    """Integers by byte planes, compressed: high bytes are much alike."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def loosen(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    wide[:, :width] = planes.T
    return wide.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def pack_hashes(h: np.ndarray) -> bytes:
    """Ascending distinct hashes as the first one and the gaps, in as many bytes as the widest gap needs."""
    if not len(h):
        return b""
    gaps = np.diff(h)
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return h[:1].astype("<u8").tobytes() + bytes([width]) + squeeze(gaps, width)


def unpack_hashes(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, dtype=np.uint64)
    return np.cumsum(np.append(np.frombuffer(raw[:8], dtype="<u8"), loosen(raw[9:], raw[8])), dtype=np.uint64)


def pack_counts(c: np.ndarray) -> bytes:
    """Counts as bytes; 255 stands for a larger one, which follows at the end. Compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype("<i8").tobytes())


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    c = np.frombuffer(raw, dtype=np.uint8, count=n).astype(np.int64)
    c[c == 255] = np.frombuffer(raw, dtype="<i8", offset=n)
    return c


def packed_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(block, keys, sizes, words, places, width, tokens): consecutive rows of a partition, BLOCK bytes of text together.

    words: the block's distinct words, the most frequent first; places: for every token its word's rank, in ``width``
    bytes; sizes: tokens of each row. The table is written, so that a block is the same at each of its uses.
    """
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType
    column = pa.list_(_arrow_type(kind))

    def emit(block: int, keys: list, each: list[np.ndarray]) -> pa.RecordBatch:
        names, places, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        width = max(1, (len(names).bit_length() + 7) // 8)
        cols = [pa.array([block], pa.int64()), pa.array([keys], column), pa.array([np.array([len(e) for e in each], np.int64).tobytes()], pa.binary()), pa.array([squeeze(names[order], 8)], pa.binary())]
        cols += [pa.array([squeeze(rank[places], width)], pa.binary()), pa.array([width], pa.int32()), pa.array([len(places)], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["block", "keys", "sizes", "words", "places", "width", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, keys, each = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            for name, value in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                t = value.as_py()
                if each and size + len(t) > BLOCK:
                    yield emit(block, keys, each)
                    block, size, keys, each = block + 1, 0, [], []
                    release()
                keys.append(name)
                each.append(word_hashes(t))
                size += len(t)
        if each:
            yield emit(block, keys, each)
        each.clear()
        release()

    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return cut(slim.mapInArrow(run, f"block long, keys array<{kind.simpleString()}>, sizes binary, words binary, places binary, width int, tokens long"))


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block's tokens, and each token's row."""
    sizes = np.frombuffer(row["sizes"], np.int64)
    return loosen(row["words"], 8)[loosen(row["places"], row["width"]).astype(np.int64)], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def _part_of(names: np.ndarray, bits: int, parts: int) -> np.ndarray:
    return ((names >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)


def requests(blocks: DataFrame, order: int, parts: int, bits: int) -> DataFrame:
    """(part, n, block, hashes, counts, size): each block's distinct n-grams, divided by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                words, of = unpacked(row)
                for n, (h, _) in enumerate(ngrams(words, of, order), 1):
                    names, counts = np.unique(names_of(h, bits), return_counts=True)
                    part = _part_of(names, bits, parts)
                    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(names) else np.empty(0, np.int64)
                    for at in range(0, len(first), 64):
                        a = first[at : at + 64]
                        b = np.append(first[at + 1 : at + 64], first[at + 64] if at + 64 < len(first) else len(names))
                        k, spans = len(a), list(zip(a.tolist(), b.tolist(), strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part[a].astype(np.int32)), pa.array([n] * k, pa.int32()), pa.array([row["block"]] * k, pa.int64()), pa.array([pack_hashes(names[x:y]) for x, y in spans], pa.binary()), pa.array([pack_counts(counts[x:y]) for x, y in spans], pa.binary()), pa.array(b - a)],
                            names=["part", "n", "block", "hashes", "counts", "size"],
                        )
                    del h, names, counts, part
                    release()

    return blocks.select("block", "sizes", "words", "places", "width").mapInArrow(run, "part int, n int, block long, hashes binary, counts binary, size long")


def answer(table: pa.Table) -> pa.Table:
    """All requests of one (part, n), with the counts over all blocks."""
    release()
    sizes = table.column("size").to_numpy()
    h = np.concatenate([unpack_hashes(x.as_py()) for x in table.column("hashes")])
    c = np.concatenate([unpack_counts(x.as_py(), n) for x, n in zip(table.column("counts"), sizes.tolist(), strict=True)])
    _, back = np.unique(h, return_inverse=True)
    sums = np.bincount(back, weights=c).astype(np.int64)[back]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    out = [pack_counts(sums[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "n": table.column("n"), "found": pa.array(out, pa.binary()), "size": table.column("size")})


def scored(words: np.ndarray, of: np.ndarray, known: list[np.ndarray], bits: int, total: int, docs: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of log-scores of each document: with all counts, and without the document's own.

    known: for n = 1, 2 .., corpus counts of the block's distinct n-grams, ascending by name. Two orders' counts are held at a time.
    """
    own = np.bincount(of, minlength=docs)[of]
    sizes = (np.maximum(1, total), np.maximum(1, total - own))
    logs: list[np.ndarray] = []
    before: list[np.ndarray] = []
    for n, (h, at) in enumerate(ngrams(words, of, len(known))):
        _, back = np.unique(names_of(h, bits), return_inverse=True)
        found = known[n][back]
        # what the document itself has of the n-gram
        _, mine, have = np.unique(back.astype(np.int64) * docs + of[at], return_inverse=True, return_counts=True)
        now = []
        for value in (found, found - have[mine]):
            now.append(np.zeros(len(words), dtype=np.int64))
            now[-1][at] = value
        if not n:
            logs = [np.log(np.where(c > 0, c, backoff) / size) for c, size in zip(now, sizes, strict=True)]
        else:
            for c, shorter, out in zip(now, before, logs, strict=True):
                out[at] += np.log(backoff)  # positions without so long a context keep their shorter score
                hit = at[c[at] > 0]
                out[hit] = np.log(c[hit] / shorter[hit - 1])
        before = now
    return tuple(np.bincount(of, weights=out, minlength=docs) for out in logs)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """(key, n_tokens, log_score, mean_score, held_out_score) for every row; logarithms are natural and rounded to six places."""
    blocks = packed_blocks(docs, key, text)
    size, total = (x or 0 for x in (docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0], blocks.agg(F.sum("tokens")).first()[0]))
    bits = name_bits(total, order)
    asked = requests(blocks, order, 1 + size // PART, bits)
    answers = asked.groupBy("part", "n").applyInArrow(answer, "block long, part int, n int, found binary, size long")
    kind = dict(docs.dtypes)[key]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        row = left.slice(0, 1).to_pylist()[0]
        words, of = unpacked(row)
        got = sorted(right.select(["n", "part", "found", "size"]).to_pylist(), key=lambda r: (r["n"], r["part"]))
        known = [np.concatenate([unpack_counts(r["found"], r["size"]) for r in got if r["n"] == n] or [np.empty(0, np.int64)]) for n in range(1, order + 1)]
        docs_ = len(row["keys"])
        plain, held = scored(words, of, known, bits, total, docs_, backoff)
        n = np.bincount(of, minlength=docs_)
        value = lambda x: pa.array(np.round(x, 6), mask=n == 0)
        return pa.table({"key": left.column("keys").combine_chunks().flatten(), "n": pa.array(n, pa.int64()), "s": value(plain), "m": value(plain / np.maximum(n, 1)), "h": value(held)})

    met = blocks.drop("tokens").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, f"key {kind}, n long, s double, m double, h double")
    return met.select(F.col("key").alias(key), F.col("n").alias("n_tokens"), F.col("s").alias("log_score"), F.col("m").alias("mean_score"), F.col("h").alias("held_out_score"))


def oracle(backoff: float = BACKOFF) -> str:
    """DuckDB SQL of the registered query: count tables of one, two and three words, joined to every word's n-grams."""
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[^ \t-\r]+')"
    by = "PARTITION BY doc_id ORDER BY i"
    cascade = lambda c, n, size: f"""ln(CASE WHEN c IS NOT NULL AND {c}3 > 0 THEN {c}3 / {n}2 WHEN b IS NOT NULL AND {c}2 > 0 THEN pow({backoff}, CAST(c IS NOT NULL AS INTEGER)) * {c}2 / {n}1
      ELSE pow({backoff}, CAST(c IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER)) * (CASE WHEN {c}1 > 0 THEN {c}1 ELSE {backoff} END) / greatest({size}, 1) END)"""  # noqa: E731
    return f"""
WITH t AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {words} AS w FROM documents)),
g AS (SELECT doc_id, i, a, lag(a) OVER ({by}) AS b, lag(a, 2) OVER ({by}) AS c FROM t),
k1 AS (SELECT a, count(*) AS n FROM g GROUP BY ALL), k2 AS (SELECT b, a, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY ALL),
k3 AS (SELECT c, b, a, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY ALL),
o1 AS (SELECT doc_id, a, count(*) AS n FROM g GROUP BY ALL), o2 AS (SELECT doc_id, b, a, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY ALL),
o3 AS (SELECT doc_id, c, b, a, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY ALL),
z AS (SELECT count(*) AS total FROM t), s AS (SELECT doc_id, count(*) AS own FROM t GROUP BY doc_id),
x AS (
  SELECT g.doc_id, g.b, g.c, total, own, k1.n AS f1, k2.n AS f2, k3.n AS f3, p1.n AS p1, p2.n AS p2,
    k1.n - o1.n AS h1, k2.n - o2.n AS h2, k3.n - o3.n AS h3, p1.n - q1.n AS r1, p2.n - q2.n AS r2
  FROM g CROSS JOIN z JOIN s USING (doc_id) JOIN k1 USING (a) JOIN o1 ON o1.doc_id = g.doc_id AND o1.a = g.a
  LEFT JOIN k2 ON k2.b = g.b AND k2.a = g.a LEFT JOIN o2 ON o2.doc_id = g.doc_id AND o2.b = g.b AND o2.a = g.a
  LEFT JOIN k3 ON k3.c = g.c AND k3.b = g.b AND k3.a = g.a LEFT JOIN o3 ON o3.doc_id = g.doc_id AND o3.c = g.c AND o3.b = g.b AND o3.a = g.a
  LEFT JOIN k1 p1 ON p1.a = g.b LEFT JOIN o1 q1 ON q1.doc_id = g.doc_id AND q1.a = g.b
  LEFT JOIN k2 p2 ON p2.b = g.c AND p2.a = g.b LEFT JOIN o2 q2 ON q2.doc_id = g.doc_id AND q2.b = g.c AND q2.a = g.b
), v AS (SELECT doc_id, count(*) AS n, sum({cascade('f', 'p', 'total')}) AS s, sum({cascade('h', 'r', 'total - own')}) AS h FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_tokens, round(s, 3) AS log_score, round(s / n, 3) AS mean_score, round(h, 3) AS held_out_score FROM documents LEFT JOIN v USING (doc_id)"""
