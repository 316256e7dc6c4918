"""Helpers that the corpus operators share: scratch storage, cut lineage, Arrow runs."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset, a temporary one in local mode; a cluster without it raises."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.getCheckpointDir():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="collatium-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so that a lost executor costs no upstream work.

    The tables of a session lie in one folder, named by its application id: whoever ends the session may delete it.
    """
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/cut-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """checkpoint() for the small tables of iterative algorithms."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches as pieces that hold whole runs of equal ``keys`` (non-null integers), each with its run offsets.

    A run that crosses a batch's end is carried into the next piece, so memory is one batch and one run.
    """
    rest: list[pa.RecordBatch] = []

    def offsets(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, dtype=bool)
        new[:1] = True
        for key in keys:
            col = batch.column(key).to_numpy(zero_copy_only=False)
            new[1:] |= col[1:] != col[:-1]
        return np.flatnonzero(new)

    def last_key(batch: pa.RecordBatch) -> tuple:
        return tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)

    def first_key(batch: pa.RecordBatch) -> tuple:
        return tuple(batch.column(k)[0].as_py() for k in keys)

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        if rest and first_key(batch) == last_key(rest[-1]) == last_key(batch):
            rest.append(batch)
            continue
        joined = whole([*rest, batch])
        at = offsets(joined)
        if at[-1]:
            done = joined.slice(0, at[-1])
            yield done, np.append(at[:-1], at[-1])
        rest = [joined.slice(at[-1])]
    if rest:
        joined = whole(rest)
        yield joined, np.append(offsets(joined), joined.num_rows)


def release() -> None:
    """Gives memory that a Python worker has freed back to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for mapInArrow, that starts without what earlier stages left to its worker and leaves nothing itself."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()

    return lean


def top_rows(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first k rows of every ``by`` in ``order``, with their rank from 1; Spark trims before its shuffle."""
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


#: A key with more than one in HOT of all rows is hot. There are fewer than HOT of them, however many rows there are.
HOT = 4096


def keyed_join(rows: DataFrame, known: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with ``known``, which has one row for each key and its number of rows in ``count`` (left out).

    The hot keys, fewer than HOT by their definition, are sent to all executors, so that their rows stay where they are; the
    others meet by a shuffle, in which no key has more than one in HOT of the rows. total: at least the sum of ``count``.
    """
    hot = known.filter(F.col(count) > total // HOT).drop(count)
    cold = known.filter(F.col(count) <= total // HOT).drop(count)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how))


#: Ids that are sent to all executors at most (8 MB); more are joined by a shuffle.
SENT = 1 << 20


def among(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """rows whose id is (left_anti: isn't) in the one-column table ``ids``, which is written and counted first: few ids go to the rows."""
    ids = cut(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= SENT else ids, ids.columns[0], how)
