"""What stands beside a text column: margin lines set piece by piece, quotations cut into notes, a panel of a translation.

A page is the unit of order; every frame is a window over it, and each result is one aggregation over the same keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatium.functions import scripts
from collatium.operators.order import ordered

# fixed values: widths of a letter, a blank and a point of the Hebrew font, of a sign of the apparatus, the clear gap
# between two pieces, the least full size, how far from a line a raised piece may stand
W_LETTER, W_SPACE, W_POINT, W_APP, GAP, FULL, NEAR = 5.7, 4.1, 3.4, 4.0, 2.5, 8, 4
# fixed values: digits below and above the line
DIGITS, BELOW, ABOVE = "0123456789", "₀₁₂₃₄₅₆₇₈₉", "⁰¹²³⁴⁵⁶⁷⁸⁹"
# fixed values: the rule, a pointer to another verse, and how far right a number of the panel may stand
RULE, POINTER, NUMBER_X = "–––", r"\(vgl\.[^)]*\)", 460.0
BLANK = scripts.BLANK
BEFORE = (Window.unboundedPreceding, -1)


def right_edge(x: Column, text: Column) -> Column:
    """The estimated right edge of a Hebrew piece."""
    letters, blanks = F.regexp_count(text, F.lit(scripts.BASE)), F.regexp_count(text, F.lit(" "))
    return x + letters * W_LETTER + blanks * W_SPACE + (F.length(text) - letters - blanks) * W_POINT


def margin_lines(pieces: DataFrame, by: str, greek: Callable[[Column], Column] = scripts.to_greek, hebrew: Callable[[Column], Column] = scripts.to_hebrew) -> DataFrame:
    """pieces (by, at, line, y, x, size, kind, text) as (by, line, text): one row for each printed line, from left to right.

    A raised piece that is alone on its line goes to the line of the full piece nearest in height (the lower one on a
    tie), if it is near. Neighbouring Hebrew pieces are one, converted together. A raised number is written as a digit
    below or above the line and closes up to what it follows. Blanks are the pieces' own; one is added where two pieces
    meet without any and a clear gap is between them or the script changes. Lines without text are left out.
    """
    full, hebrew_piece = F.col("size") >= FULL, F.col("kind") == "HEB"
    heights = Window.partitionBy(by).orderBy("y", F.desc("line"), "at")
    here = F.when(full, F.struct("y", "line"))
    lower, upper = F.last(here, ignorenulls=True).over(heights.rowsBetween(*BEFORE)), F.first(here, ignorenulls=True).over(heights.rowsBetween(1, Window.unboundedFollowing))
    rows = pieces.withColumns({"_lower": lower, "_upper": upper, "_alone": ~F.bool_or(full).over(Window.partitionBy(by, "line"))})
    down, up = F.col("y") - F.col("_lower.y"), F.col("_upper.y") - F.col("y")
    near = F.when(F.col("_upper").isNull() | (down <= up), F.col("_lower")).otherwise(F.col("_upper"))
    rows = rows.withColumn("_near", near).withColumn("line", F.when(F.col("_alone") & (F.abs(F.col("_near.y") - F.col("y")) < NEAR), F.col("_near.line")).otherwise(F.col("line")))
    across = Window.partitionBy(by, "line").orderBy("x", "at")
    rows = rows.withColumns({"_base": F.first(F.when(full, F.col("y")), ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_new": F.when(hebrew_piece & (F.lag("kind").over(across) == "HEB"), 0).otherwise(1)})
    rows = rows.withColumn("_unit", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    units = rows.groupBy(by, "line", "_unit").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min("size").alias("size"), F.min("_base").alias("_base"), F.min("kind").alias("kind"), F.max_by(right_edge(F.col("x"), F.col("text")), F.struct("x", "at")).alias("_right"), F.array_join(ordered(["x", "at"], "text"), "").alias("text"))
    digits = F.trim("text").rlike("^[0-9]+$") & ~F.col("kind").isin("HEB", "GRK")
    index = digits & (F.col("size") < FULL) & F.col("_base").isNotNull() & (F.col("_unit") > 1)
    shown = F.when(index, F.when(F.col("y") < F.col("_base"), F.translate(F.trim("text"), DIGITS, BELOW)).otherwise(F.translate(F.trim("text"), DIGITS, ABOVE)))
    shown = F.when(F.col("kind") == "HEB", hebrew(F.col("text"))).when(F.col("kind") == "GRK", greek(F.col("text"))).otherwise(F.coalesce(shown, F.col("text")))
    units = units.withColumns({"_index": index, "_t": shown}).withColumn("_end", F.when(F.col("kind") == "HEB", F.col("_right")).otherwise(F.col("x") + F.length("_t") * W_APP))
    inside = Window.partitionBy(by, "line").orderBy("_unit")
    put = F.last(F.when(~F.col("_index"), F.struct("_end", "kind", "_unit")), ignorenulls=True).over(inside.rowsBetween(*BEFORE))
    units = units.withColumns({"_put": put, "_prev": F.lag("_t").over(inside), "_follows": F.coalesce(F.lead("_index").over(inside), F.lit(False))})
    gap = F.col("x") - (F.col("_put._end") + (F.col("_unit") - F.col("_put._unit") - 1) * W_APP)
    parted = ~F.col("_index") & (F.col("_t") != "") & ~F.col("_t").rlike("^" + BLANK) & ~F.col("_prev").rlike(BLANK + "$") & ((gap > GAP) | ((F.col("kind") == "HEB") != (F.col("_put.kind") == "HEB")))
    piece = F.concat(F.when(parted, " ").otherwise(""), F.when(F.col("_follows"), F.regexp_replace("_t", BLANK + "+$", "")).otherwise(F.col("_t")))
    lines = units.withColumn("_p", piece).groupBy(by, "line").agg(F.array_join(ordered(["_unit"], "_p"), "").alias("text"))
    text = F.trim(F.regexp_replace(F.replace("text", F.lit("ё"), F.lit("ë")), BLANK + "+", " "))
    return lines.select(by, "line", F.regexp_replace(text, "[( ]+$", "").alias("text")).filter("text <> ''")


def quotations(notes: DataFrame, by: str, at: str) -> DataFrame:
    """notes (by, at, kind, text) as (by, at, part, kind, text), each quotation as one note of kind 'grk' in guillemets.

    A sign » with Greek right after it opens one; it takes the next note that closes any: a sign or a margin note that
    begins with «, or a margin note that ends with it. Each closing note serves one opening, the earlier first, so that
    it is used if more were opened than closed before it; of it there stays what it says besides, a sign at its end as
    a note of its own. An opening without a closing note stays as it is. A quotation within a margin note is lifted out.
    """
    w = Window.partitionBy(by).orderBy(at)
    bare, kind = F.trim("text"), F.col("kind")
    opens = (kind == "sigla") & (bare == "»") & (F.lead("kind").over(w) == "grk")
    rest = F.when(kind.isin("sigla", "margin") & bare.startswith("«"), F.trim(F.substring(bare, 2, 1 << 30))).when((kind == "margin") & bare.endswith("«"), F.trim(F.regexp_replace(bare, "«$", "")))
    rows = notes.withColumns({"_opens": F.coalesce(opens, F.lit(False)), "_rest": rest})
    step = F.when(F.col("_opens"), 1).when(F.col("_rest").isNotNull(), -1).otherwise(0)
    rows = rows.withColumn("_s", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_floor", F.least(F.lit(0), F.coalesce(F.min("_s").over(w.rowsBetween(*BEFORE)), F.lit(0))))
    rows = rows.withColumn("_used", F.col("_rest").isNotNull() & (F.coalesce(F.lag("_s").over(w), F.lit(0)) > F.col("_floor")))
    whole = Window.partitionBy(by)
    rows = rows.withColumns({"_closed": F.sum(F.col("_used").cast("int")).over(whole), "_nth": F.sum(F.col("_opens").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumn("_begins", F.col("_opens") & (F.col("_nth") <= F.col("_closed"))).withColumn("_quoted", F.coalesce(F.lag("_begins").over(w), F.lit(False)))
    sign = F.when(kind == "margin", F.nullif(F.regexp_extract("_rest", rf"(?s)\S\s+([*|])$", 1), F.lit("")))
    kept = F.when(sign.isNotNull(), F.regexp_replace("_rest", r"\s+[*|]$", "")).otherwise(F.col("_rest"))
    within = r"(?s)^(.*?)«\s*([^«»]+?)\s*»(.*)$"
    note = lambda k, t: F.struct(k.alias("kind"), t.alias("text"))
    lifted = lambda t: F.when(
        (kind == "margin") & t.rlike(within),
        F.array(note(kind, F.trim(F.concat(F.regexp_extract(t, within, 1), F.lit(" "), F.regexp_extract(t, within, 3)))), note(F.lit("grk"), F.concat(F.lit("«"), F.regexp_extract(t, within, 2), F.lit("»")))),
    ).otherwise(F.array(note(kind, t)))
    used = F.concat(lifted(kept), F.when(sign.isNotNull(), F.array(note(F.lit("sigla"), sign))).otherwise(F.array().cast("array<struct<kind:string,text:string>>")))
    out = F.when(F.col("_quoted"), F.array(note(F.lit("grk"), F.concat(F.lit("«"), bare, F.lit("»"))))).when(F.col("_used"), F.filter(used, lambda n: n["text"] != "")).otherwise(lifted(F.col("text")))
    whole_note = F.filter(out, lambda n: (n["text"] != "") | (kind != "margin"))
    return rows.filter(~F.col("_begins")).select(by, at, F.posexplode(whole_note).alias("part", "_n")).select(by, at, "part", "_n.kind", "_n.text")


def panel(spans: DataFrame, by: str, at: str, low: Column, high: Column, convert: Callable[[Column], Column] = scripts.to_greek) -> DataFrame:
    """spans (by, at, x, y, kind, text, mark) of a panel as (by, place, what, verse, y, text): clauses and what goes with them.

    Greek spans (kind GRK) are joined to clauses, with a blank where neither side of a seam has one; a newline ends a
    clause, and so do a verse number, a newline in other text and a closed rule line. A number is one from low to high, or
    a span of digits alone left of NUMBER_X; clauses before the first number are left out. ``place`` numbers a page's
    clauses from 0. Other rows name the clause they go with: 'mark' (a footnote's mark, whatever it says) the clause it
    stands in or, where none is begun, the one before; 'order' (a rule line, gathered until its closing rule) the one
    before; 'app' (a pointer to another verse) the one that follows. A rule line without an end says nothing.
    """
    w = Window.partitionBy(by).orderBy(at)
    greek = F.col("kind") == "GRK"
    other = ~greek & F.col("mark").isNull()
    rows = spans.withColumn("_rules", F.when(other, F.regexp_count("text", F.lit(RULE))).otherwise(0))
    # one rule opens or closes, two or more always leave the line closed
    rows = rows.withColumn("_reset", F.coalesce(F.sum((F.col("_rules") >= 2).cast("int")).over(w.rowsBetween(*BEFORE)), F.lit(0)))
    toggles = F.sum((F.col("_rules") == 1).cast("int")).over(Window.partitionBy(by, "_reset").orderBy(at).rowsBetween(*BEFORE))
    rows = rows.withColumn("_open", F.coalesce(toggles, F.lit(0)) % 2 == 1)
    rows = rows.withColumn("_order", other & (F.col("_open") | (F.col("_rules") > 0)))
    rows = rows.withColumn("_closes", F.col("_order") & F.when(F.col("_open"), F.col("_rules") > 0).otherwise(F.col("_rules") > 1))
    rows = rows.withColumn("_nth", F.sum((F.col("_order") & ~F.col("_open")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    plain, bare = other & ~F.col("_order"), F.regexp_replace("text", POINTER, " ")
    alone = (F.col("x") < NUMBER_X) & F.trim(F.regexp_replace(bare, BLANK, " ")).rlike("^[0-9]+$")
    numbers = F.filter(F.transform(F.regexp_extract_all(bare, F.lit("[0-9]+"), 0), lambda n: n.try_cast("long")), lambda n: n.between(low, high) | (n.isNotNull() & alone))
    rows = rows.withColumn("_number", F.when(plain & (F.size(numbers) > 0), F.element_at(numbers, -1)))
    ends = F.col("_closes") | (plain & (F.contains("text", F.lit("\n")) | F.col("_number").isNotNull()))
    refs = F.when(plain, F.regexp_extract_all("text", F.lit(POINTER), 0))
    parts = F.when(greek, F.split("text", "\n")).otherwise(F.array(F.lit("")))
    rows = rows.select(by, at, "y", "text", "mark", "_order", "_closes", "_nth", "_number", greek.alias("_greek"), ends.alias("_ends"), refs.alias("_refs"), F.posexplode(parts).alias("_k", "_piece"))
    w = Window.partitionBy(by).orderBy(at, "_k")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_clause": F.sum((F.col("_ends") | (F.col("_k") > 0)).cast("int")).over(upto), "_verse": F.last("_number", ignorenulls=True).over(upto)})
    inside = Window.partitionBy(by, "_clause").orderBy(at, "_k").rowsBetween(*BEFORE)
    said = F.when(F.col("_greek") & (F.col("_piece") != ""), F.col("_piece"))
    rows = rows.withColumns({"_last": F.last(said, ignorenulls=True).over(inside), "_begun": F.coalesce(F.bool_or(F.trim(F.regexp_replace(said, BLANK, " ")) != "").over(inside), F.lit(False))})
    seam = F.when(F.col("_last").isNotNull() & ~F.col("_last").rlike(BLANK + "$") & ~F.col("_piece").rlike("^" + BLANK), " ").otherwise("")
    height = F.when((F.col("_k") == 0) & F.col("_piece").rlike(r"[^ \t-\r]"), F.struct(F.col(at).alias("at"), "y"))
    pieces = rows.withColumns({"_joined": F.concat(seam, "_piece"), "_height": height}).filter(F.col("_greek") & (F.col("_piece") != ""))
    clauses = pieces.groupBy(by, "_clause").agg(F.min("_verse").alias("verse"), F.min("_height")["y"].alias("y"), F.array_join(ordered([at, "_k"], "_joined"), "").alias("text"))
    spoken = F.col("verse").isNotNull() & F.col("text").rlike(r"[^ \t-\r]")
    clauses = clauses.filter(spoken).withColumn("text", convert(F.col("text"))).filter("text <> ''").select(by, "_clause", F.lit("clause").alias("what"), "verse", "y", "text", F.lit(0).alias("_off"))
    line = F.array_join(ordered([at], "text"), "")
    orders = rows.filter("_order").groupBy(by, "_nth").agg(F.bool_or("_closes").alias("_whole"), F.max("_clause").alias("_clause"), line.alias("text")).filter("_whole")
    note = lambda df, what, text, off: df.select(by, "_clause", F.lit(what).alias("what"), F.lit(None).cast("long").alias("verse"), F.lit(None).cast("double").alias("y"), text.alias("text"), off.alias("_off"))
    orders = note(orders, "order", F.trim(F.regexp_replace("text", BLANK + "+", " ")), F.lit(-1))
    marks = note(rows.filter(~F.col("_greek") & F.col("mark").isNotNull()), "mark", F.col("mark"), F.when(F.col("_begun"), 0).otherwise(-1))
    refs = note(rows.select(by, "_clause", F.explode("_refs").alias("_r")), "app", F.trim(F.regexp_replace("_r", r"^\(|\)$", "")), F.lit(0))
    every = clauses.unionByName(marks).unionByName(orders).unionByName(refs)
    before = F.coalesce(F.sum((F.col("what") == "clause").cast("int")).over(Window.partitionBy(by).orderBy("_clause").rangeBetween(*BEFORE)), F.lit(0))
    return every.withColumn("place", (before + F.col("_off")).cast("int")).select(by, "place", "what", "verse", "y", "text")
