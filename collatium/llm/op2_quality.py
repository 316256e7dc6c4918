"""Quality classifier by co-training.

Two logistic classifiers see different views of a document: one its text (shares of character classes, repetition, word
lengths, hashed words), one its page metadata (source, declared language, length). In every round each scores all
unlabelled documents and hands those it is surest of to the other, with its label for them. Both are then calibrated on
labelled rows kept aside, and a logistic combination of the two calibrated log-odds scores every document.

Fitting uses at most LABELLED labelled rows, picked by a hash of the id; every other document is in the pool that
pseudo-labels are taken from, at most GROW for each class, view and round. Scoring covers all rows and whole texts. A
null or empty text has no character classes and the features of zero words. Null metadata are a value of their own.
Labels without a document, repeated ids and null labels are allowed: of labelled rows with one id the one of the least
hash counts, and of several labels the greatest. Without labels of both classes every document has the share of good
labels as its score (1 where there are none). An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatium.llm.common import cut, giving_back, top_rows

#: Labelled rows that are fitted on, rounds, pseudo-labels of a class and round, and how sure they must be.
LABELLED, ROUNDS, GROW, SURE = 4000, 4, 300, 0.95
#: Documents whose score is below are rejected.
THRESHOLD = 0.5
SOURCES, LANGS, WORDS = 32, 8, 64
SYMBOLS = b"#$%&*@^~<>{}[]\\_=+"
CLASSES = {"upper": bytes(range(65, 91)), "shout": b"!", "bar": b"|", "symbol": SYMBOLS, "digit": b"0123456789", "stop": b".,;:?", "line": b"\n", "high": bytes(range(128, 256))}
_MEMBER = np.stack([np.isin(np.arange(256), np.frombuffer(v, dtype=np.uint8)) for v in CLASSES.values()]).astype(float)
TEXT_FEATURES, META_FEATURES = len(CLASSES) + 6 + WORDS, SOURCES + LANGS + 3


def text_view(text: str | None) -> list[float]:
    """Square roots of shares of the bytes, repetition of words, word lengths, and shares of hashed words, over the whole text."""
    raw = (text or "").encode("utf-8", "replace")
    counts = np.zeros(256)
    for i in range(0, len(raw), 1 << 22):
        counts += np.bincount(np.frombuffer(raw, np.uint8, min(1 << 22, len(raw) - i), i), minlength=256)
    shares = np.sqrt(_MEMBER @ counts / max(1, len(raw)))
    words = raw.split()
    n = max(1, len(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    kinds = set(words)
    hashed = np.bincount(np.fromiter((zlib.crc32(w.lower()) % WORDS for w in kinds), np.int64, len(kinds)), minlength=WORDS) / max(1, len(kinds))
    return [1.0, *shares.tolist(), float(np.sqrt(same / n)), len(kinds) / n, float(np.log1p(len(raw) / n)), float(np.log1p(len(words)) / 10), float(not words), *hashed.tolist()]


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """One place for each hashed source and language, and the length."""
    out = [0.0] * META_FEATURES
    out[0] = 1.0
    out[1] = float(np.log1p(max(0, n_chars or 0)) / 10)
    out[2] = float(n_chars is None)
    out[3 + zlib.crc32((source or "").encode()) % SOURCES] = 1.0
    out[3 + SOURCES + zlib.crc32((lang or "").encode()) % LANGS] = 1.0
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Weights by Newton's method; the classes weigh the same, and column 0 is the intercept."""
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * len(y) / 10)
    keep[0] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        g = x.T @ (share * (p - y)) + keep * w
        h = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(keep) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b): calibrated log-odds a z + b, towards the true share of the classes."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = _sigmoid(a * z + b)
        r, s = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * z * z).sum() + 1e-2, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [(r * z).sum() + 1e-2 * (a - 1), r.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -3, 3)
    return float(a), float(b)


@dataclass
class Model:
    """views: weights and calibration (a, b) of text and metadata; mix: intercept and weights of both log-odds."""

    views: list[tuple[np.ndarray, tuple[float, float]]]
    mix: np.ndarray
    constant: float | None = None

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.constant is not None:
            return (np.full(len(text), self.constant),) * 3
        z = [a * (x @ w) + b for x, (w, (a, b)) in zip((text, meta), self.views, strict=True)]
        return _sigmoid(self.mix[0] + self.mix[1] * z[0] + self.mix[2] * z[1]), _sigmoid(z[0]), _sigmoid(z[1])


#: For every (view that is handed a row, label): the rows' features of that view.
Given = dict[tuple[int, int], np.ndarray]


def surest(pool: tuple[np.ndarray, np.ndarray], names: np.ndarray, fitted: list[np.ndarray], taken: list[set[int]], grow: int, sure: float) -> list[tuple[int, int, float, int]]:
    """(view handed to, label, certainty, place in the pool): at most ``grow`` of each, the surest first, then the smaller name."""
    out = []
    for k in (0, 1):
        p, other = _sigmoid(pool[k] @ fitted[k]), 1 - k
        free = ~np.isin(names, np.fromiter(taken[other], np.int64, len(taken[other])))
        for label, certainty in ((1, p), (0, 1 - p)):
            at = np.flatnonzero((certainty >= sure) & free)
            at = at[np.lexsort((names[at], -certainty[at]))][:grow]
            out += [(other, label, float(certainty[i]), int(i)) for i in at]
    return out


def cotrain(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, aside: np.ndarray, hand, rounds: int = ROUNDS) -> Model:
    """views: features of labelled rows; y: 0 or 1; aside: which of them calibrate.

    hand: from both views' weights and the names that each view has been given to new (view, label, name, features), a
    function of the pool, wherever that lies.
    """
    own, said = [[v[~aside]] for v in views], [[y[~aside]] for _ in views]
    taken: list[set[int]] = [set(), set()]
    fitted = [logistic(np.concatenate(own[k]), np.concatenate(said[k])) for k in (0, 1)]
    for _ in range(rounds):
        new = hand(fitted, taken)
        for view, label, name, features in new:
            own[view].append(features[None, :])
            said[view].append(np.array([float(label)]))
            taken[view].add(name)
        if not new:
            break
        fitted = [logistic(np.concatenate(own[k]), np.concatenate(said[k])) for k in (0, 1)]
    t = y[aside]
    calibrated = [platt(v[aside] @ w, t) for v, w in zip(views, fitted, strict=True)]
    z = np.stack([np.ones(len(t)), *[a * (v[aside] @ w) + b for v, w, (a, b) in zip(views, fitted, calibrated, strict=True)]], axis=1)
    mix = np.array([0.0, 1.0, 0.0])
    for _ in range(30):  # towards trust in the text alone, so that a weak view can't undo a strong one
        p = _sigmoid(z @ mix)
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(3)
        mix = mix - np.clip(np.linalg.solve(h, z.T @ (p - t) + 0.5 * (mix - [0.0, 1.0, 0.0])), -1, 1)
    return Model(list(zip(fitted, calibrated, strict=True)), mix)


def in_memory(pool: tuple[np.ndarray, np.ndarray], names: np.ndarray, grow: int = GROW, sure: float = SURE):
    """A pool of arrays, for cotrain."""

    def hand(fitted: list[np.ndarray], taken: list[set[int]]) -> list[tuple[int, int, int, np.ndarray]]:
        return [(view, label, int(names[i]), pool[view][i]) for view, label, _, i in surest(pool, names, fitted, taken, grow, sure)]

    return hand


def in_table(pool: DataFrame, grow: int = GROW, sure: float = SURE):
    """A pool as a table (name, t, m: features as bytes of float32), for cotrain: each task offers its surest, the surest of all come here."""

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(float) for c in ("t", "m"))

    def hand(fitted: list[np.ndarray], taken: list[set[int]]) -> list[tuple[int, int, int, np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    names = batch.column("name").to_numpy()
                    found = surest(arrays(batch), names, fitted, taken, grow, sure)
                    cols = [pa.array([2 * v + y for v, y, _, _ in found], pa.int32()), pa.array([c for _, _, c, _ in found], pa.float64()), pa.array([int(names[i]) for *_, i in found], pa.int64()), pa.array([batch.column("tm"[v == 1])[i].as_py() for v, _, _, i in found], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["slot", "sure", "name", "x"])

        offered = pool.mapInArrow(run, "slot int, sure double, name long, x binary")
        got = top_rows(offered, "slot", [F.desc("sure"), F.asc("name")], grow).select("slot", "rank", "name", "x").collect()  # at most 4 * grow
        return [(r.slot // 2, r.slot % 2, r.name, np.frombuffer(r.x, np.float32).astype(float)) for r in sorted(got, key=lambda r: (r.slot, r.rank))]

    return hand


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_view(x.as_py()) for x in batch.column("text")]).reshape(-1, TEXT_FEATURES)
    meta = [meta_view(*x) for x in zip(*[batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")], strict=True)]
    return text, np.array(meta).reshape(-1, META_FEATURES)


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x.astype(np.float32)], pa.binary())


def features_of(rows: DataFrame) -> DataFrame:
    """rows (with text, source, lang, n_chars) with the features t and m as bytes of float32 in place of the text and metadata."""
    kept = [c for c in rows.columns if c not in ("text", "source", "lang", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = _features(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], _bytes(text), _bytes(meta)], names=[*kept, "t", "m"])

    schema = ", ".join([*[f"`{c}` {dict(rows.dtypes)[c]}" for c in kept], "t binary", "m binary"])
    return rows.mapInArrow(giving_back(run), schema)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", labelled: int = LABELLED) -> Model:
    """docs: key, text, source, lang, n_chars; labels: key, label (0 or 1)."""
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("_y"))
    picked = cut(marks.orderBy(F.xxhash64("_k"), "_k").limit(labelled))  # a bounded sample of labelled rows
    plain = docs.select(F.col(key).alias("_k"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    plain = plain.withColumn("name", F.xxhash64("_k", "text", "source", "lang", "n_chars"))
    known = plain.join(F.broadcast(picked), "_k").groupBy("_k", "_y").agg(F.min_by(F.struct("text", "source", "lang", "n_chars"), "name").alias("r")).select(F.col("_k").cast("string").alias("k"), "_y", "r.*")
    got = sorted(features_of(known).collect(), key=lambda r: r.k)  # at most ``labelled`` rows
    y = np.array([r._y for r in got], dtype=float)
    t, m = (np.array([np.frombuffer(r[c], np.float32) for r in got], dtype=float).reshape(-1, width) for c, width in (("t", TEXT_FEATURES), ("m", META_FEATURES)))
    aside = np.array([zlib.crc32(r.k.encode()) % 4 == 0 for r in got], dtype=bool)
    if len({*y[~aside]}) < 2 or len({*y[aside]}) < 2:
        return Model([], np.zeros(3), float(y.mean()) if len(y) else 1.0)
    pool = cut(features_of(plain.join(F.broadcast(picked.select("_k")), "_k", "left_anti").drop("_k")))
    return cotrain((t, m), y, aside, in_table(pool))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (with text, source, lang, n_chars) and score, text_score, meta_score: the chance that a document is good."""
    names = ["score", "text_score", "meta_score"]
    slim = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(*_features(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.round(x, 6)) for x in found]], names=[*batch.schema.names, *names])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields], *[f"{x} double" for x in names]])
    return slim.mapInArrow(giving_back(run), schema)
