"""What several queries share: ordered views of the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatium.functions import folds
from collatium.sources.tables import load

BY, ORDER = ["user_id"], ["ts", "event_id"]
OVER = "PARTITION BY user_id ORDER BY ts, event_id"


def events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return load(spark, d, "events", *(columns or ("event_id", "user_id", "ts", "event_type", "value")))


def tokens(spark: SparkSession, d: str, table: str = "documents", key: str = "doc_id", *more: str) -> DataFrame:
    """(key, more.., ord, token): letter runs of the lower-cased text in order."""
    return load(spark, d, table, key, *more, "text").select(key, *more, F.posexplode(folds.words(F.col("text"))).alias("ord", "token"))


def tokens_sql(table: str = "documents", key: str = "doc_id", more: str = "") -> str:
    return f"(SELECT {key}, {more} CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS ord, unnest(w) AS token FROM (SELECT {key}, {more} regexp_extract_all(lower(text), '(\\p{{L}}+)', 1) AS w FROM {table}))"


def readings(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, want, got): a text and a second reading of it: the same, without blanks after commas, or without its letters e."""
    text = F.coalesce("text", F.lit(""))
    kind = F.col("doc_id") % 3
    got = F.when(kind == 0, text).when(kind == 1, F.replace(text, F.lit(", "), F.lit(","))).otherwise(F.replace(text, F.lit("e"), F.lit("")))
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", text.alias("want"), got.alias("got"))


READINGS = """(SELECT doc_id, coalesce(text, '') AS want, CASE doc_id % 3 WHEN 0 THEN coalesce(text, '')
  WHEN 1 THEN replace(coalesce(text, ''), ', ', ',') ELSE replace(coalesce(text, ''), 'e', '') END AS got FROM documents)"""
LETTERS = "regexp_replace(lower({}), '\\P{{L}}', '', 'g')"


def letters_sql(column: str) -> str:
    return LETTERS.format(column)


def unaccented_sql(column: str) -> str:
    return f"translate(lower({column}), '{folds.LATIN[0]}', '{folds.LATIN[1]}')"


def skeleton_sql(column: str) -> str:
    return f"regexp_replace({unaccented_sql(column)}, '[^\\p{{L}}]|[aeiouy]', '', 'g')"
