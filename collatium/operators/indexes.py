"""Indexes of forms, votes, dictionaries and multisets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unambiguous(rows: DataFrame, key: str, signature: str) -> DataFrame:
    """(key, signature, n) of the keys that have exactly one signature; keys with null signatures beside it keep it.

    Rows are counted by (key, signature) first, in a hash aggregate, so that the extremes of strings are taken over few.
    """
    return sole(rows.groupBy(key, signature).agg(F.count("*").alias("n")), key, signature)


def sole(counts: DataFrame, key: str, signature: str) -> DataFrame:
    """The same from counts (key, signature, n), whatever else they are grouped by."""
    return counts.groupBy(key).agg(F.min(signature).alias(signature), F.max(signature).alias("_max"), F.sum("n").alias("n")).filter(F.col(signature) == F.col("_max")).drop("_max")


def votes(rows: DataFrame, key: str, value: str, least: int = 5, pure: float = 0.95) -> DataFrame:
    """(key, value, n, purity, mixed): the most frequent value of a key (ties: the smaller) and its share."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("c"))
    top = counts.groupBy(key).agg(F.min(F.struct((-F.col("c")).alias("c"), value)).alias("t"), F.sum("c").alias("n")).filter(F.col("n") >= least)
    share = -F.col("t.c") / F.col("n")
    return top.select(key, F.col(f"t.{value}").alias(value), "n", F.round(share, 6).alias("purity"), (share < pure).alias("mixed"))


def pool(rows: DataFrame, page: str, ord_: str, entry: Sequence[str], name: str = "pool_id") -> DataFrame:
    """Dictionary encoding within a page: distinct entries numbered from 0 by first occurrence."""
    first = rows.groupBy(page, *entry).agg(F.min(ord_).alias("_first"))
    return first.withColumn(name, F.row_number().over(Window.partitionBy(page).orderBy("_first", *entry)) - 1).drop("_first")


def pool_of_lists(rows: DataFrame, page: str, items: Column, entry: str, name: str = "pool_id") -> DataFrame:
    """(page, entry, name): the pool of rows that hold a page's entries as a list.

    A page of one row is numbered where it lies; where every page is one, which is looked at first, nothing else is done. Pages
    of several rows, null among them, are brought together.
    """
    alone = lambda df: df.select(page, F.posexplode(F.array_distinct(items)).alias(name, entry)).select(page, entry, name)
    many = rows.groupBy(F.col(page).alias("_many")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_many")
    if many.isEmpty():
        return alone(rows)
    again = F.col(page).eqNullSafe(F.col("_many"))
    parts = rows.join(many, again, "left_semi").select(page, F.posexplode(items).alias("_ord", entry))
    return alone(rows.join(many, again, "left_anti")).unionByName(pool(parts, page, "_ord", [entry], name).select(page, entry, name))


def bag_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with side ('left' or 'right') and how many more: exceptAll both ways, as counts, in one grouped pass."""
    names = left.columns
    both = left.withColumn("_d", F.lit(1)).unionByName(right.select(*names).withColumn("_d", F.lit(-1)))
    more = both.groupBy(*names).agg(F.sum("_d").alias("n")).filter("n <> 0")
    return more.select(F.when(F.col("n") > 0, "left").otherwise("right").alias("side"), *names, F.abs("n").alias("n"))


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that the left has more often, with how many more."""
    return bag_differences(left, right).filter("side = 'left'").drop("side")


def top_per_group(rows: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
