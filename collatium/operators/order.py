"""Operators over ordered rows: islands, carries, folds. Order is always explicit: partition columns and order columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatium.functions import scripts
from collatium.sources.scratch import settled


def _over(by: Sequence[str], order: Sequence, start: int | None = None, end: int | None = None):
    w = Window.partitionBy(*by).orderBy(*order)
    if start is None and end is None:
        return w
    return w.rowsBetween(Window.unboundedPreceding if start is None else start, Window.currentRow if end is None else end)


def islands(df: DataFrame, by, order, mark: Column, name: str = "island", initiator: bool = False) -> DataFrame:
    """Numbers runs of rows from 0: a run ends after a marked row, or (initiator) begins with one."""
    hit = F.when(mark, 1).otherwise(0)
    w = _over(by, order, None, 0 if initiator else -1)
    return df.withColumn(name, F.coalesce(F.sum(hit).over(w), F.lit(0)))


def runs_of_equal(df: DataFrame, by, order, value: Column, name: str = "run") -> DataFrame:
    """Numbers maximal runs of equal values from 0."""
    before = F.lag(value).over(_over(by, order))
    changed = df.withColumn("_new", F.when(F.row_number().over(_over(by, order)) == 1, 0).when(value.eqNullSafe(before), 0).otherwise(1))
    return changed.withColumn(name, F.sum("_new").over(_over(by, order, None, 0))).drop("_new")


def monotone_fill(df: DataFrame, by, order, value: Column, start: Column, name: str = "filled") -> DataFrame:
    """The greatest valid value so far, else ``start``: a carry that never goes back."""
    return df.withColumn(name, F.coalesce(F.max(value).over(_over(by, order, None, 0)), start))


def carry(df: DataFrame, by, order, value: Column, name: str = "carried", strictly: bool = False) -> DataFrame:
    """The last non-null value up to (strictly: before) the row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_over(by, order, None, -1 if strictly else 0)))


def running_sum(df: DataFrame, by, order, value: Column, name: str = "upto", strictly: bool = False) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.sum(value).over(_over(by, order, None, -1 if strictly else 0)), F.lit(0)))


def near_first(df: DataFrame, by, order, value: Column, reach: int = 3, name: str = "near") -> DataFrame:
    """The first non-null value among the rows from ``reach`` before to ``reach`` after."""
    return df.withColumn(name, F.first(value, ignorenulls=True).over(_over(by, order, -reach, reach)))


def ordered(by_columns, value: str) -> Column:
    """Aggregate: the values of a group in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*by_columns, F.col(value).alias("_v")))), lambda x: x["_v"])


def clamped_depth(steps: Column) -> Column:
    """Fold of +1 and -1 with a floor at 0: struct(now, most)."""
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, x: F.struct(F.greatest(a["now"] + x, F.lit(0)).alias("now"), F.greatest(a["most"], a["now"] + x).alias("most")),
    )


def unopened(chars: Column, opener: str, closer: str) -> Column:
    """Whether a closer stands that nothing before it has opened."""
    step = lambda c: F.when(c == opener, 1).when(c == closer, -1).otherwise(0)
    return F.aggregate(
        chars,
        F.struct(F.lit(0).alias("d"), F.lit(False).alias("bad")),
        lambda a, c: F.struct(F.greatest(a["d"] + step(c), F.lit(0)).alias("d"), (a["bad"] | (a["d"] + step(c) < 0)).alias("bad")),
        lambda a: a["bad"],
    )


def reach_back(chars: Column, opener: str, closer: str, most: int) -> Column:
    """How many characters back, at most ``most``, the opener of a final closer stands; 0 where there is none."""
    step = lambda c: F.when(c == closer, 1).when(c == opener, -1).otherwise(0)
    found = F.aggregate(
        F.slice(F.reverse(chars), 1, most),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("i"), F.lit(0).alias("at")),
        lambda a, c: F.struct((a["d"] + step(c)).alias("d"), (a["i"] + 1).alias("i"), F.when((a["at"] == 0) & (a["d"] + step(c) == 0) & (a["i"] > 0) & (c == opener), a["i"] + 1).otherwise(a["at"]).alias("at")),
        lambda a: a["at"],
    )
    return F.when(F.element_at(chars, -1) == closer, found).otherwise(0)


def prefix_recall(want: Column, got: Column) -> Column:
    """How many of the wanted items are met in order; an item never met stops the count for good. Arrays of single items."""
    return F.aggregate(got, F.lit(0), lambda i, c: F.when(F.get(want, i) == c, i + 1).otherwise(i))


def collapsed(notes: DataFrame, by: str, at: str, rule: str) -> DataFrame:
    """notes (by, at, kind, text) with each rule line as one note of kind 'order'.

    A sign that ends with the rule closes one; the search goes on to the next note that is neither sign nor apparatus, or
    that begins with the rule. If that is a sign, all from the first closing one to it are joined backwards, apparatus in
    brackets. A margin note that begins and ends with the rule is one by itself.
    """
    begins, ends = F.col("text").startswith(rule), F.col("text").endswith(rule)
    ahead = Window.partitionBy(by).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    stop = F.first(F.when(~F.col("kind").isin("sigla", "app") | begins, F.struct(F.col(at).alias("at"), F.col("kind").alias("kind"))), ignorenulls=True).over(ahead)
    rows = notes.withColumn("_stop", stop).withColumn("_stop", F.when((F.col("kind") == "sigla") & ends & ~begins & (F.col("_stop.kind") == "sigla"), F.col("_stop.at")))
    # the first closing sign that leads to a stop is where its group starts
    start = F.min(F.when(F.col("_stop").isNotNull(), F.col(at))).over(Window.partitionBy(by, "_stop"))
    upto = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_open", F.when(F.col("_stop").isNotNull(), F.struct(start.alias("start"), F.col("_stop").alias("stop"))))
    rows = rows.withColumn("_open", F.last("_open", ignorenulls=True).over(upto)).withColumn("_start", F.when(F.col(at) <= F.col("_open.stop"), F.col("_open.start")))
    inside = F.col("_start").isNotNull()
    piece = F.when(inside & (F.col("kind") == "app"), F.concat(F.lit("("), F.trim("text"), F.lit(")"))).when(inside, F.trim("text")).otherwise(F.col("text"))
    kind = F.when(inside | ((F.col("kind") == "margin") & begins & ends), "order").otherwise(F.col("kind"))
    rows = rows.select(by, F.coalesce("_start", at).alias("_at"), at, kind.alias("kind"), piece.alias("_p"))
    return rows.groupBy(by, F.col("_at").alias(at)).agg(F.min("kind").alias("kind"), F.array_join(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("i"), "_p"))), lambda x: x["_p"])), " ").alias("text"))


def projected(segments: DataFrame, by: str, at: str, keep: Sequence[str], variants: Sequence[str]) -> DataFrame:
    """The segments (by, at, cls, text in visual order) that one edition has, with the seams mended where others went out.

    A binding sign is left out where the word it bound is gone (not where only a variant is). Where what went out held a
    blank, the words beside it stay two. Where it stood hard against a prefix that is no word, looked for in the four
    pieces before it, both sides close up.
    """
    blank = r"[ \t-\r]"
    in_order = Window.partitionBy(by).orderBy(at)
    rows = segments.withColumn("_kept", F.col("cls").isin(*keep))
    rows = rows.withColumn("_part", F.coalesce(F.sum(F.col("_kept").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # parts and runs never go back within the order, so that one order by part and place serves all that follows
    after = Window.partitionBy(by).orderBy("_part", at)
    part = Window.partitionBy(by, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gone = lambda c: F.coalesce(F.bool_or(~F.col("_kept") & c).over(part), F.lit(False))
    rows = rows.withColumns({"_gap": gone(~F.col("cls").isin(*variants)), "_spaced": gone(F.col("text").rlike(blank)), "_hard": gone(~F.col("text").rlike(blank + "$"))}).filter("_kept")
    rows = rows.withColumns({"_t": F.when(F.col("_gap"), F.regexp_replace("text", f"-({blank}*)$", " $1")).otherwise(F.col("text")), "_prev": F.lag("text").over(after)})
    rows = rows.withColumn("_run", F.sum(F.col("_gap").cast("int")).over(after.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_piece", F.when(F.col("_spaced"), F.concat("_t", F.lit(" "))).otherwise(F.col("_t")))
    before = [F.when(F.lag("_run", i).over(after) == F.col("_run"), F.lag("_piece", i).over(after)) for i in (1, 2, 3)]
    rows = rows.withColumn("_last", F.concat(*[F.coalesce(c, F.lit("")) for c in (F.col("_piece"), *before)]))
    # the last word stands first in visual order: no more than it is spelled out
    rows = rows.withColumn("_dangling", scripts.bound_fragment(scripts.to_hebrew(F.regexp_extract("_last", scripts.LAST_WORD, 0))))
    closes = F.col("_prev").isNotNull() & F.col("_hard") & ~F.col("_prev").rlike("^" + blank) & F.coalesce(F.lag("_dangling").over(after), F.lit(False))
    parts = F.col("_spaced") & F.col("_prev").isNotNull() & (F.col("_t") != "") & ~F.col("_t").rlike(r"[ \t-\r`-]$") & ~F.col("_prev").rlike(r"^[ \t-\r-]")
    text = F.when(closes, F.regexp_replace("_t", blank + "+$", "")).when(parts, F.concat("_t", F.lit(" "))).otherwise(F.col("_t"))
    return rows.select(by, at, "cls", text.alias("text"))


def placed(df: DataFrame, order: Sequence[str], name: str = "place") -> DataFrame:
    """df with its place from 1 in the order of all rows: sorted by ranges over all tasks, each range moved by the rows before it.

    The ranges' sizes are one row for each, and are what the one unpartitioned window sees. The order must be total.
    """
    ranged = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    numbered = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return numbered.join(F.broadcast(before), "_part").withColumn(name, F.col("_i") + F.col("_before")).drop("_part", "_i", "_before")
