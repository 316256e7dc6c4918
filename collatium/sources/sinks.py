"""Sinks: JSON, CSV with a byte-order mark, one document for each group, reports and rejects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, in UTF-8; fields that are null are left out."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header whose first name bears a byte-order mark, for programs that need it to see UTF-8."""
    first, *rest = df.columns
    df.select(F.col(f"`{first}`").alias("﻿" + first), *[F.col(f"`{c}`") for c in rest]).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def documents(rows: DataFrame, by: Sequence[str], order: Sequence[str], line: Column, title: Column) -> DataFrame:
    """(by, html): one HTML document for each group, its lines in order."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_l")))), lambda x: x["_l"]), "\n")
    head = F.concat(F.lit("<title>"), F.first(title), F.lit("</title>\n"))
    return rows.groupBy(*by).agg(F.concat(head, lines).alias("html"))


def write_documents(df: DataFrame, path: str, by: str) -> None:
    """A folder of text files for each group."""
    df.select(by, F.col("html").alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def routed(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): rejected rows carry reject_reason; the same column decides for both."""
    marked = rows.withColumn("reject_reason", reason)
    return marked.filter("reject_reason is null").drop("reject_reason"), marked.filter("reject_reason is not null")
