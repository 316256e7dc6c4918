"""What both vector searches share: clean vectors, balanced blocks as binary columns, and query blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatium.llm.common import cut, keyed_join, runs


def clean(table: DataFrame, key: str, vector: str, zero_ok: bool) -> DataFrame:
    """(id long, v array<double>, dim int) without null ids, null or empty vectors, and vectors with null or non-finite components."""
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return (rows if zero_ok else rows.filter(F.exists("v", lambda x: x != 0))).withColumn("dim", F.size("v"))


def pack(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of the integer ``keys``: ids (binary int64, ascending) and vs (binary as of narrow, row by row).

    The caller bounds the group's size by how it chose the keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, at in runs(batches, keys):
            ids = piece.column("id").to_numpy()
            v = piece.column("v").flatten().to_numpy()
            ends = np.concatenate(([0], np.cumsum(piece.column("dim").to_numpy(), dtype=np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*[piece.column(k).take(pa.array(at[:-1])) for k in keys], pa.array([ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([narrow(v[ends[a] : ends[b]]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                names=[*keys, "ids", "vs"],
            )

    types = dict(rows.dtypes)
    extra = [c for c in ("dim",) if c not in keys]
    return rows.select(*keys, *extra, "id", "v").repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(run, ", ".join([*[f"{k} {types[k]}" for k in keys], "ids binary", "vs binary"]))


def wide(raw: bytes) -> np.ndarray:
    """What narrow packed, as float64."""
    return np.frombuffer(raw, dtype=raw[:3].decode(), offset=3).astype(np.float64)


def unpack(ids: bytes, vs: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids_ = np.frombuffer(ids, dtype=np.int64)
    return ids_, wide(vs).reshape(len(ids_), -1)


def dealt(rows: DataFrame, size: int, name: str, salt: int = 0) -> DataFrame:
    """rows with the int column ``name``: the rows of each vector length dealt by a hash of their id to groups of about ``size``.

    The lengths and their numbers of rows are a small table that is joined, however many lengths there are.
    """
    counts = rows.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("int").alias("_groups"), F.count("*").alias("_n"))
    counts = cut(counts)
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return keyed_join(rows, counts, ["dim"], "_n", total).withColumn(name, F.pmod(F.xxhash64("id", F.lit(salt)), "_groups").cast("int")).drop("_groups")


def narrow(x: np.ndarray) -> bytes:
    """Numbers in the smallest of four types that holds every one of them exactly, after the type's name."""
    for kind in ("<i2", "<i4", "<f4"):
        with np.errstate(invalid="ignore", over="ignore"):
            y = x.astype(kind)
        if (y.astype(np.float64) == x).all():
            return kind.encode() + y.tobytes()
    return b"<f8" + x.astype("<f8").tobytes()
