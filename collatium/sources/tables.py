"""Sources: tables, optional tables, JSON, read-back of HTML, spans of typeset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table; only the columns named are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the given schema where it is missing. The file system of the path is asked."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def json_rows(spark: SparkSession, path: str, schema: str, many_lines: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", many_lines).json(path)


def whole_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, html) of every file that the pattern names."""
    return spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def paragraphs(html: Column) -> Column:
    """Contents of closed paragraphs, in order; a strict shape, so that drift shows as missing rows."""
    return F.regexp_extract_all(html, F.lit(r"(?s)<p>(.*?)</p>"), 1)


def embedded(html: Column, name: str, kind: str | T.DataType) -> Column:
    """The JSON that a page's script assigns to ``name``."""
    return F.from_json(F.regexp_extract(html, rf"(?s)var {name} = (.*?);</script>", 1), kind)


def mixed_anchor(text: Column) -> Column:
    """A two-element array of a string and a number, which no schema fits, as a struct (col, n)."""
    raw = F.from_json(text, "array<string>")
    return F.when(F.size(raw) == 2, F.struct(F.get(raw, 0).alias("col"), F.get(raw, 1).cast("int").alias("n")))


#: An element's name and the text up to the next tag.
RUN = r"<([a-z0-9]+)[^<>]*>([^<]+)"


def spans(pages: DataFrame) -> DataFrame:
    """(page_id, span_ord, kind, text) of pages (page_id, html): text runs that aren't blank, with the element each is in."""
    parts = F.arrays_zip(F.regexp_extract_all("html", F.lit(RUN), 1).alias("kind"), F.regexp_extract_all("html", F.lit(RUN), 2).alias("text"))
    rows = pages.select("page_id", F.posexplode(parts).alias("span_ord", "s")).select("page_id", "span_ord", "s.kind", "s.text")
    return rows.filter(F.col("text").rlike("[^ \\t\\n\\r]"))


def glyphs(pages: DataFrame) -> DataFrame:
    """(page_id, glyph_ord, glyph): the same pages' glyphs without blanks."""
    text = F.regexp_replace(F.array_join(F.regexp_extract_all("html", F.lit(RUN), 2), ""), r"[ \t-\r]", "")
    return pages.select("page_id", F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("glyph_ord", "glyph"))


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block, spans, chars) of closed paragraphs."""
    rows = pages.select("page_id", F.posexplode(paragraphs(F.col("html"))).alias("block", "body"))
    return rows.select("page_id", "block", (F.size(F.regexp_extract_all("body", F.lit("<[a-z0-9]+"), 0)) + 1).cast("long").alias("spans"), F.length(F.regexp_replace("body", "<[^>]*>", "")).cast("long").alias("chars"))
