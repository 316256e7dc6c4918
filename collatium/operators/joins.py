"""Joins by position, nearness, band, time and fallback. Each has an equality to partition by; ranges become buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatium.sources.scratch import settled


def zipped(left: DataFrame, right: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "i") -> DataFrame:
    """Row i of each group on the left with row i on the right."""
    w = Window.partitionBy(*by).orderBy(*order)
    return left.withColumn(name, F.row_number().over(w)).join(right.withColumn(name, F.row_number().over(w)), [*by, name])


def nearest(left: DataFrame, right: DataFrame, x: str, y: str, key: str, bound: float) -> DataFrame:
    """left with ``key``, the nearest row on the right within ``bound`` (ties: the smaller key), else null.

    There is no key to join by, so both sides are sorted together by ranges over all tasks; the nearest is the last right
    place at or below, or the first one above. What a range lacks at its ends comes from its neighbours, by a table with a
    row for each range. Left rows are dealt by their hash beside the place, so that a frequent place fills many ranges.
    """
    places = right.groupBy(F.col(y).cast("double").alias("_h")).agg(F.min(key).alias("_k")).filter("_h is not null")
    both = left.withColumns({"_h": F.col(x).cast("double"), "_s": F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])}).unionByName(places, allowMissingColumns=True)
    ranged = settled(both.repartitionByRange("_h", F.col("_s").asc_nulls_first()).withColumn("_part", F.spark_partition_id()))
    place = F.when(F.col("_s").isNull(), F.struct("_h", "_k"))
    here = Window.partitionBy("_part")
    upto = lambda *by: here.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    ends = ranged.groupBy("_part").agg(F.max(place).alias("last"), F.min(place).alias("first"))
    ends = ends.select(
        "_part", F.last("last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("first", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    rows = ranged.withColumns({"_low": F.last(place, ignorenulls=True).over(upto(F.asc("_h"), F.asc_nulls_first("_s"))), "_high": F.last(place, ignorenulls=True).over(upto(F.desc("_h"), F.asc_nulls_first("_s")))})
    rows = rows.filter("_s is not null").join(F.broadcast(ends), "_part")
    gap = lambda p: F.when(F.abs(F.col("_h") - p["_h"]) <= bound, F.struct(F.abs(F.col("_h") - p["_h"]).alias("d"), p["_k"].alias("k")))
    found = F.array_min(F.array_compact(F.array(*[gap(F.col(c)) for c in ("_low", "_high", "_before", "_after")])))
    return rows.select(*[F.col(f"`{c}`") for c in left.columns], found["k"].alias(key))


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, value: str, tie: str, forward: bool = False) -> DataFrame:
    """left with ``value`` of the last right row at or before it (forward: the first at or after it) in its group.

    Both sides are sorted together once, so no pair is formed. tie: a column that orders rows of one time.
    """
    side = lambda df, mark, v: df.select("*", F.lit(mark).alias("_side"), v.alias("_v"))
    both = side(left, 1, F.lit(None).cast(right.schema[value].dataType)).unionByName(side(right, 0, F.col(value)), allowMissingColumns=True)
    sort = [F.desc(at), F.asc("_side"), F.desc(tie)] if forward else [F.asc(at), F.asc("_side"), F.asc(tie)]
    w = Window.partitionBy(*by).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").select(*left.columns, F.col("_v").alias(value))


def highest_above(left: DataFrame, right: DataFrame, by: Sequence[str], x: str, y: str, row: str, name: str) -> DataFrame:
    """left with ``name``: the greatest ``row`` among right rows of its group with y > x, else the least of the group, else null.

    Both sides are sorted together by height once, and a running maximum from above is read off: no pair is formed.
    """
    both = left.withColumns({"_h": F.col(x), "_r": F.lit(None).cast(right.schema[row].dataType), "_side": F.lit(1)}).unionByName(
        right.select(*by, F.col(y).alias("_h"), F.col(row).alias("_r"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    # a right row as high as a left one comes after it, so it isn't above
    above = Window.partitionBy(*by).orderBy(F.desc("_h"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.coalesce(F.max("_r").over(above), F.min("_r").over(Window.partitionBy(*by)))).filter("_side = 1").drop("_h", "_r", "_side")


def banded(left: DataFrame, right: DataFrame, by: Sequence[str], x: str, y: str, row: str, key: str, band: float = 1.0) -> DataFrame:
    """left (``key`` is unique) with ``row`` and ``inferred``: the one right row within the band.

    With none or several: the greatest row index among those above (y > x), else the least index of the group. The band
    is looked up by range buckets of its width, the fallback by a sorted union.
    """
    bucket = lambda c: F.floor(F.col(c) / band).cast("long")
    filed = right.select(*by, F.col(y).alias("_y"), F.col(row).alias("_r"), F.explode(F.array(bucket(y) - 1, bucket(y), bucket(y) + 1)).alias("_b"))
    close = left.select(*by, key, x, bucket(x).alias("_b")).join(filed, [*by, "_b"]).filter(F.abs(F.col(x) - F.col("_y")) <= band)
    best = close.groupBy(key).agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
    one = F.col("_lo") == F.col("_hi")
    rows = highest_above(left, right, by, x, y, row, "_above").join(best, key, "left")
    return rows.withColumns({row: F.when(one, F.col("_lo")).otherwise(F.col("_above")), "inferred": ~F.coalesce(one, F.lit(False))}).drop("_lo", "_hi", "_above")


def free_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, reach: int) -> DataFrame:
    """Range anti-join: left rows without a right row of their group within ``reach`` seconds, by time buckets."""
    second = F.unix_micros(F.col(at).cast("timestamp"))
    wide = reach * 1_000_000
    filed = right.select(*by, second.alias("_t"), F.explode(F.sequence(F.floor(second / wide) - 1, F.floor(second / wide) + 1)).alias("_b"))
    placed = left.withColumns({"_u": second, "_b": F.floor(second / wide)})
    on = [placed[c] == filed[c] for c in [*by, "_b"]] + [F.abs(placed["_u"] - filed["_t"]) <= wide]
    return placed.join(filed, on, "left_anti").drop("_u", "_b")


def first_known(rows: DataFrame, steps: Sequence[tuple[DataFrame, str]], value: str, key: str = "key") -> DataFrame:
    """rows left-joined step by step with (key, value) tables; the first that knows the row counts. provenance: its name."""
    found, source = F.lit(None), F.lit("none")
    for table, name in reversed(steps):
        rows = rows.join(table.select(F.col(key), F.col(value).alias(f"_{name}")), key, "left")
        found = F.coalesce(F.col(f"_{name}"), found)
        source = F.when(F.col(f"_{name}").isNotNull(), name).otherwise(source)
    return rows.withColumns({value: found, "provenance": source}).drop(*[f"_{n}" for _, n in steps])


def outcome(n: Column) -> Column:
    """Three outcomes of a lookup by the number of readings."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, "missing").when(n == 1, "unique").otherwise("ambiguous")
