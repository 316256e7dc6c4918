"""Queries of page scans, sinks, the two scripts, and the columns and notes of an edition.

The edition's own pages aren't there: documents cut at their full stops stand for its segments, whose letters the Hebrew
font reads as visual order, and conversations for its notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collatium.functions import folds, scripts
from collatium.functions.scripts import to_hebrew, to_hebrew_sql
from collatium.operators import order
from collatium.plans.catalog import query
from collatium.plans.common import events
from collatium.sources import scratch, sinks, tables
from collatium.sources.tables import load

CLASSES, VARIANTS = ("common", "plus", "minus", "mtvar", "ogabbr"), ("mtvar", "ogvar", "mtsup")
SEGMENTS = f"""(SELECT doc_id, CAST(ord AS INTEGER) AS ord, ['{"', '".join(CLASSES)}'][1 + (doc_id + ord) % 5] AS cls, piece AS text, ord % 3 = 1 AS joined
  FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS ord FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\. ') AS p FROM documents)))"""
TOKENS = "(SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \\t-\\r]+')) AS w FROM documents)"
PAIRS = "(SELECT DISTINCT w AS mt, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS og FROM (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t-\\r]+') AS t FROM documents)))"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ord, cls, text, joined)."""
    rows = load(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\. ")).alias("ord", "text"))
    cls = F.get(F.array(*map(F.lit, CLASSES)), ((F.col("doc_id") + F.col("ord")) % 5).cast("int"))
    return rows.select("doc_id", "ord", cls.alias("cls"), "text", (F.col("ord") % 3 == 1).alias("joined"))


def words(spark: SparkSession, d: str) -> DataFrame:
    """(w): distinct runs without blanks."""
    return load(spark, d, "documents", "text").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t-\r]+"), 0)).alias("w")).distinct()


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(mt, og): distinct neighbours, the last word of a text with null."""
    rows = load(spark, d, "documents", "text").select(F.regexp_extract_all("text", F.lit(r"[^ \t-\r]+"), 0).alias("t"))
    return rows.select("t", F.posexplode("t").alias("i", "mt")).select("mt", F.get("t", F.col("i") + 1).alias("og")).distinct()


PARTS = r"<([a-z0-9]+)[^<>]*>([^<]+)"


@query("s1_span_scan", rf"""
WITH s AS (SELECT page_id, regexp_extract_all(html, '{PARTS}', 1) AS k, regexp_extract_all(html, '{PARTS}', 2) AS t FROM pages),
u AS (SELECT page_id, unnest(k) AS kind, unnest(t) AS text, CAST(generate_subscripts(k, 1) - 1 AS INTEGER) AS span_ord FROM s)
SELECT page_id, span_ord, kind, text FROM u WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def s1(spark, d):
    """Every run of text of a page with the kind of the element it is in, as a visitor would be called for it."""
    return tables.spans(load(spark, d, "pages", "page_id", "html"))


@query("s2_glyph_trace", rf"""
WITH s AS (SELECT page_id, array_to_string(regexp_extract_all(html, '{PARTS}', 2), '') AS t FROM pages),
g AS (SELECT page_id, regexp_replace(t, '[ \t-\r]', '', 'g') AS t FROM s)
SELECT page_id, CAST(i AS INTEGER) AS glyph_ord, substr(t, i + 1, 1) AS glyph FROM (SELECT page_id, t, unnest(range(length(t))) AS i FROM g)""")
def s2(spark, d):
    """The second reading of the same pages: single glyphs without blanks, in order."""
    return tables.glyphs(load(spark, d, "pages", "page_id", "html"))


@query("s3_block_scan", r"""
WITH b AS (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS p FROM pages), u AS (SELECT page_id, unnest(p) AS body, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS block FROM b)
SELECT page_id, block, len(regexp_extract_all(body, '<[a-z0-9]+')) + 1 AS spans, length(regexp_replace(body, '<[^>]*>', '', 'g')) AS chars FROM u""")
def s3(spark, d):
    """Blocks of a page with how many spans and characters each has."""
    return tables.blocks(load(spark, d, "pages", "page_id", "html"))


@query("k1_json_dump", "SELECT doc_id, md5(text) AS text, lang FROM documents WHERE lang <> 'en'")
def k1(spark, d):
    """Written as JSON, non-ASCII kept, and read back."""
    path = scratch.folder(spark)
    sinks.write_json(load(spark, d, "documents", "doc_id", "text", "lang").filter("lang <> 'en'"), path)
    return tables.json_rows(spark, path, "doc_id long, text string, lang string").select("doc_id", F.md5("text").alias("text"), "lang")


@query("k2_csv_with_mark", "SELECT 'EFBBBF' AS mark, page_id, url FROM pages")
def k2(spark, d):
    """Written as CSV with a byte-order mark, and read back; the mark is looked for in the files' first bytes."""
    path = scratch.folder(spark)
    sinks.write_csv(load(spark, d, "pages", "page_id", "url"), path)
    back = spark.read.option("header", True).csv(path).toDF("page_id", "url").select(F.col("page_id").cast("long").alias("page_id"), "url")
    marks = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).agg(F.max(F.hex(F.substring("content", 1, 3))).alias("mark"))
    return back.join(F.broadcast(marks)).select("mark", "page_id", "url")  # marks has one row


@query("k4_index_pages", """
WITH s AS (SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (WHERE n_chars < 500) AS short FROM documents WHERE lang IS NOT NULL GROUP BY lang),
l AS (SELECT string_agg('<li><a href="' || lang || '.html">' || lang || '</a> ' || replace(format('{:,}', n), ',', '.') || '</li>', chr(10) ORDER BY lang) AS items, CAST(sum(n) AS BIGINT) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM s)
SELECT 'index.html' AS path, '<title>Index</title>' || chr(10) || items || chr(10) || '<p>' || replace(format('{:,}', n), ',', '.') || ' texts, ' || replace(format('{:,}', chars), ',', '.') || ' characters</p>' AS html FROM l
UNION ALL SELECT lang || '.html', '<title>' || lang || '</title>' || chr(10) || '<p>' || replace(format('{:,}', n), ',', '.') || ' texts, ' || replace(format('{:.1f}', 100.0 * short / greatest(n, 1)), '.', ',') || ' % short</p>' FROM s""")
def k4(spark, d):
    """A landing page with totals over all groups, and one for each group with its shares: aggregates put into a template."""
    rows = load(spark, d, "documents", "lang", "n_chars").filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 500).alias("short"))
    share = F.replace(F.format_number(100.0 * F.col("short") / F.greatest("n", F.lit(1)), 1), F.lit("."), F.lit(","))
    each = rows.select(F.concat("lang", F.lit(".html")).alias("path"), F.concat(F.lit("<title>"), "lang", F.lit("</title>\n<p>"), folds.continental(F.col("n")), F.lit(" texts, "), share, F.lit(" % short</p>")).alias("html"))
    item = rows.withColumn("item", F.concat(F.lit('<li><a href="'), "lang", F.lit('.html">'), "lang", F.lit("</a> "), folds.continental(F.col("n")), F.lit("</li>")))
    whole = item.agg(F.array_join(order.ordered(["lang"], "item"), "\n").alias("items"), F.sum("n").alias("n"), F.sum("chars").alias("chars")).filter("n is not null")
    index = whole.select(F.lit("index.html").alias("path"), F.concat(F.lit("<title>Index</title>\n"), "items", F.lit("\n<p>"), folds.continental(F.col("n")), F.lit(" texts, "), folds.continental(F.col("chars")), F.lit(" characters</p>")).alias("html"))
    return index.unionByName(each)


@query("c3_plain", f"SELECT doc_id, md5(replace(regexp_replace({to_hebrew_sql('text')} || 'קֹ֖ול', '[\\x{{0591}}-\\x{{05af}}]', '', 'g'), 'ֹו', 'וֹ')) AS plain FROM documents WHERE text IS NOT NULL")
def c3(spark, d):
    rows = load(spark, d, "documents", "doc_id", "text").filter("text is not null")
    return rows.select("doc_id", F.md5(folds.plain(F.concat(to_hebrew(F.col("text")), F.lit("קֹ֖ול")))).alias("plain"))


@query("c4_without_accents", f"SELECT doc_id, md5(regexp_replace(replace({to_hebrew_sql('text')}, 'ָ', 'ָ֖'), '[\\x{{0591}}-\\x{{05af}}]', '', 'g')) AS bare FROM documents WHERE text IS NOT NULL")
def c4(spark, d):
    accented = F.replace(to_hebrew(F.col("text")), F.lit("ָ"), F.lit("ָ֖"))
    return load(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", F.md5(folds.without_accents(accented)).alias("bare"))


@query("c5_hebrew", f"SELECT doc_id, md5({to_hebrew_sql('text')}) AS hebrew FROM documents")
def c5(spark, d):
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(to_hebrew(F.col("text"))).alias("hebrew"))


@query("c6_greek")
def c6(spark, d):
    """No SQL: marks are bound by place and composed. Tests hold the function against words of the font."""
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(scripts.to_greek("text")).alias("greek"))


@query("c8_unspaced", r"""
WITH w AS (SELECT doc_id, trim(regexp_replace(upper(lang || source), '([A-Z0-9])', '\1 ', 'g')) || '  ab c  ' || source AS line FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, array_to_string(list_transform(string_split_regex(line, ' {2,}'), lambda g: CASE WHEN regexp_matches(g, '^\p{L}( \p{L}){2,}$') THEN replace(g, ' ', '') ELSE g END), '  ') AS closed FROM w""")
def c8(spark, d):
    rows = load(spark, d, "documents", "doc_id", "lang", "source").filter("lang is not null and source is not null")
    line = F.concat(F.trim(F.regexp_replace(F.upper(F.concat("lang", "source")), "([A-Z0-9])", "$1 ")), F.lit("  ab c  "), "source")
    return rows.select("doc_id", folds.unspaced(line).alias("closed"))


NOT_BASE = scripts.one_of(scripts.HEBREW, without=True)
CONS = lambda c: f"length(regexp_replace({c}, '[^א-ת]', '', 'g'))"
LAST = lambda c: f"regexp_extract({c}, '([א-ת]{scripts.POINTS}*)$', 1)"
FIRST = lambda c: to_hebrew_sql(f"regexp_extract({c}, '({scripts.BASE}{NOT_BASE}*)$', 1)")
DROP = lambda c: f"regexp_extract({c}, '(?s)^(.*){scripts.BASE}{NOT_BASE}*$', 1)"
OPEN = f"""(last <> '' AND heb NOT LIKE '%־' AND ({CONS('heb')} = 1 OR NOT (length(last) = 1 OR regexp_matches(last, '^[{scripts.FINAL}]') OR regexp_matches(last, '^ה.*ּ') OR regexp_matches(last, '^[חע].*ַ'))))"""


@query("c11_edge_letters", f"SELECT w, {LAST(to_hebrew_sql('w'))} AS last, {FIRST('w')} AS first, {DROP('w')} AS dropped, {CONS(to_hebrew_sql('w'))} AS consonants FROM {TOKENS}")
def c11(spark, d):
    w, heb = F.col("w"), to_hebrew(F.col("w"))
    return words(spark, d).select("w", scripts.last_letter(heb).alias("last"), scripts.first_unit(w).alias("first"), scripts.without_first(w).alias("dropped"), scripts.consonants(heb).cast("long").alias("consonants"))


@query("c12_open_head", f"SELECT w, {OPEN} AS open FROM (SELECT w, heb, {LAST('heb')} AS last FROM (SELECT w, {to_hebrew_sql('w')} AS heb FROM {TOKENS}))")
def c12(spark, d):
    return words(spark, d).select("w", scripts.open_head(to_hebrew(F.col("w"))).alias("open"))


SUPPLIED = f"""(SELECT *, CASE WHEN {CONS('heb')} < {CONS('og_heb')} AND {OPEN} AND trim(tail) <> '' AND trim(cut) <> '' THEN cut END AS completion
  FROM (SELECT *, CASE WHEN heb LIKE '%ְ' AND contains({FIRST('tail')}, 'ְ') THEN {DROP('tail')} ELSE tail END AS cut
    FROM (SELECT mt, og, heb, og_heb, {LAST('heb')} AS last, {DROP('og')} AS tail FROM (SELECT mt, og, {to_hebrew_sql('mt')} AS heb, {to_hebrew_sql('og')} AS og_heb FROM {PAIRS} WHERE og IS NOT NULL))))"""


@query("c13_completion", f"SELECT mt, og, completion FROM {SUPPLIED} WHERE completion IS NOT NULL")
def c13(spark, d):
    # exploded, since a filter would be pushed below the spelling and repeat it
    rows = scripts.spelled(pairs(spark, d).filter("og is not null"))
    return rows.select("mt", "og", F.explode(F.array_compact(F.array(scripts.supplied_of()))).alias("completion"))


@query("c14_abbreviated_side", f"""
WITH s AS (SELECT *, {LAST('og_heb')} AS og_last FROM {SUPPLIED})
SELECT mt, og, CASE WHEN completion IS NOT NULL THEN 'first' WHEN {CONS('og_heb')} < {CONS('heb')} AND heb NOT LIKE '%־' AND og_heb NOT LIKE '%־'
  AND NOT ({CONS('og_heb')} = 1 AND NOT regexp_matches(og_last, '^[{scripts.FINAL}]') AND contains(og_last, 'ְ')) THEN 'second' ELSE 'neither' END AS side FROM s""")
def c14(spark, d):
    rows = scripts.spelled(pairs(spark, d).filter("og is not null"))
    side = F.when(scripts.supplied_of().isNotNull(), "first").when(scripts.tail_only_of(), "second").otherwise("neither")
    return rows.select("mt", "og", side.alias("side"))


@query("c15_visible_width", "SELECT s_suppkey, 10 * length(s_name) - 5 * length(regexp_replace(s_name, '[^ijlt.,]', '', 'g')) + 5 * length(regexp_replace(s_name, '[^A-Z]', '', 'g')) AS width FROM supplier")
def c15(spark, d):
    return load(spark, d, "supplier", "s_suppkey", "s_name").select("s_suppkey", folds.visible_width(F.col("s_name")).cast("long").alias("width"))


@query("c17_symbols", "SELECT doc_id, md5(translate(replace(replace(text, '|', chr(61660)), '!', chr(61662)), chr(61660) || chr(61662), '⇐⇒')) AS text FROM documents")
def c17(spark, d):
    private = F.replace(F.replace("text", F.lit("|"), F.lit("")), F.lit("!"), F.lit(""))
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(folds.symbols(private)).alias("text"))


LIST = f"string_split({to_hebrew_sql('text')}, ' ')"
GLUES = f"""list_transform(range(1, len(l) + 1), lambda i: l[i] || CASE WHEN i = len(l) OR (regexp_matches(l[i], '^{scripts.LONE}$') AND regexp_matches(l[i + 1], '^[א-ת]') AND NOT (i = 1 AND joined)) THEN '' ELSE ' ' END)"""


@query("c19_bound_proclitics", f"""
WITH h AS (SELECT doc_id, ord, cls, joined, {LIST} AS l FROM {SEGMENTS}),
b AS (SELECT *, len(l) = 1 AND regexp_matches(l[1], '^{scripts.LONE}$') AND cls <> 'ogabbr' AND NOT joined AS lone FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - row_number() OVER (PARTITION BY doc_id, lone ORDER BY ord) AS run FROM b),
p AS (SELECT *, lone AND row_number() OVER (PARTITION BY doc_id, lone, run ORDER BY ord) % 2 = 1 AND coalesce(lead(cls) OVER (PARTITION BY doc_id ORDER BY ord) <> 'ogabbr', false) AS binds FROM r),
j AS (SELECT *, joined OR coalesce(lag(binds) OVER (PARTITION BY doc_id ORDER BY ord), false) AS now FROM p)
SELECT doc_id, ord, now AS joined, md5(CASE WHEN cls = 'ogabbr' THEN array_to_string(l, ' ') ELSE array_to_string({GLUES.replace('joined', 'now')}, '') END) AS text FROM j""")
def c19(spark, d):
    """Lone prefixes bound to the word after them: within a segment, and over its end, where of several in a row every second binds.

    One order of the segments serves every step, and two digests go through it instead of a text: as it is, and as it would
    be if the segment before bound itself to it.
    """
    h = segments(spark, d).withColumn("heb", to_hebrew(F.col("text")))
    lone = F.col("heb").rlike(f"^{scripts.LONE}$") & (F.col("cls") != "ogabbr") & ~F.col("joined")
    h = h.withColumn("lone", lone).withColumn("inside", F.when(F.col("cls") == "ogabbr", F.col("heb")).otherwise(scripts.bound_inside(F.col("heb"))))
    own = F.when(F.col("joined") | (F.col("cls") == "ogabbr"), F.col("inside")).otherwise(scripts.bound_first(F.col("inside")))
    h = h.select("doc_id", "ord", "cls", "joined", "lone", F.md5(own).alias("own"), F.md5("inside").alias("after"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    h = h.withColumn("i", F.row_number().over(w))
    turn = (F.col("i") - F.coalesce(F.max(F.when(~F.col("lone"), F.col("i"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))) % 2 == 1
    h = h.withColumn("binds", F.col("lone") & turn & F.coalesce(F.lead("cls").over(w) != "ogabbr", F.lit(False)))
    h = h.withColumn("taken", ~F.col("joined") & F.coalesce(F.lag("binds").over(w), F.lit(False)))
    return h.select("doc_id", "ord", (F.col("joined") | F.col("taken")).alias("joined"), F.when(F.col("taken"), F.col("after")).otherwise(F.col("own")).alias("text"))


FRAGMENT = lambda heb: f"regexp_matches(regexp_replace(regexp_extract({heb}, '([^ ]+) *$', 1), '[^א-ת]', '', 'g'), '^[{scripts.PROCLITIC}]{{1,2}}$')"


@query("c20_bound_fragment", f"SELECT w, {FRAGMENT(to_hebrew_sql('w'))} AS fragment FROM {TOKENS}")
def c20(spark, d):
    return words(spark, d).select("w", scripts.bound_fragment(to_hebrew(F.col("w"))).alias("fragment"))


PIECE = r"־*[^ \t-\r־]+־?|־+"
PIECES = f"""(SELECT *, mid OR maq OR coalesce(lag(token) OVER (PARTITION BY doc_id ORDER BY ord, k) LIKE '%־', false) AS glue FROM (
  SELECT doc_id, ord, k, cls, token, maq, CASE WHEN k > 0 THEN false ELSE joined AND row_number() OVER (PARTITION BY doc_id ORDER BY ord, k) > 1 AND NOT maq END AS mid
  FROM (SELECT *, regexp_matches(token, '^[־׃]') AS maq FROM (SELECT doc_id, ord, cls, joined, unnest(p) AS token, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS k FROM (SELECT *, regexp_extract_all({to_hebrew_sql('text')}, '{PIECE}') AS p FROM {SEGMENTS})))))"""


def pieces(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ord, k, cls, token, glue, mid): pieces of segments. glue: no blank before it; mid: within a word.

    Only whole segments are put in order: of what is before one, its first piece asks whether there is any and how it ends.
    A segment is cut at one sign that no text has; a second one says that the piece before ends in a binding sign.
    """
    cut, tied = "\u0001", "\u0002"
    rows = segments(spark, d).select("doc_id", "ord", "cls", "joined", to_hebrew(F.col("text")).alias("heb"))
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("bound", F.last(F.when(F.col("heb") != "", F.col("heb").endswith("־")), ignorenulls=True).over(before))
    # a binding sign ends a piece if it has a letter before it and goes on; there are few, so that most cuts are blanks
    tied_parts = F.regexp_replace("heb", "־(?<=[^ ־]־)(?=[^ ])", f"־{cut}{tied}")
    marked = F.when(F.contains("heb", F.lit("־")), F.replace(tied_parts, F.lit("־ "), F.lit(f"־{cut}{tied}"))).otherwise(F.col("heb"))
    rows = rows.select("doc_id", "ord", "cls", "joined", "bound", F.posexplode(F.split(F.replace(marked, F.lit(" "), F.lit(cut)), cut)).alias("k", "t"))
    rows = rows.filter("t <> ''").withColumn("token", F.replace("t", F.lit(tied), F.lit("")))
    sign = F.col("token").startswith("־") | F.col("token").startswith("׃")
    mid = (F.col("k") == 0) & F.col("joined") & F.col("bound").isNotNull() & ~sign
    tie = F.col("t").startswith(tied) | ((F.col("k") == 0) & F.coalesce("bound", F.lit(False)))
    return rows.select("doc_id", "ord", "k", "cls", "token", (mid | sign | tie).alias("glue"), mid.alias("mid"))


@query("c22_tokens_with_glue", f"SELECT doc_id, ord, k, cls, token, glue, mid FROM {PIECES}")
def c22b(spark, d):
    return pieces(spark, d).select("doc_id", "ord", "k", "cls", "token", "glue", "mid")


@query("c23_printed_words", f"""
WITH g AS (SELECT doc_id, ord, k, token, sum(CAST(NOT glue AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY ord, k) AS word FROM {PIECES}),
w AS (SELECT doc_id, word, string_agg(token, '' ORDER BY ord, k) AS w FROM g GROUP BY ALL),
p AS (SELECT doc_id, word, unnest(string_split(w, '־')) AS part, generate_subscripts(string_split(w, '־'), 1) AS i FROM w)
SELECT doc_id, regexp_replace(part, '[^א-ת]', '', 'g') AS word, count(*) AS n FROM p WHERE regexp_matches(part, '[א-ת]') GROUP BY ALL""")
def c23(spark, d):
    """The words a reader sees: pieces glued to islands, divided again at the binding sign, as consonants, with their counts in each text.

    The same from whole segments: what the binding sign glues is divided there again, so that only a stop or a joined segment
    leaves no end of a word before it, and a blank or a binding sign is one everywhere else.
    """
    rows = segments(spark, d).select("doc_id", "ord", "joined", scripts.bare_hebrew(F.col("text")).alias("heb"))
    piece = F.concat(F.when(F.col("joined") | (F.col("heb") == "") | F.col("heb").startswith("׃"), "").otherwise(" "), F.regexp_replace("heb", " +׃", "׃"))
    whole = rows.select("doc_id", "ord", piece.alias("piece")).groupBy("doc_id").agg(F.array_join(order.ordered(["ord"], "piece"), "").alias("w"))
    parts = whole.select("doc_id", F.explode(F.split(F.translate("w", "־׃", " "), " ")).alias("word")).filter("word <> ''")
    return parts.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query("c25_note_text", r"""
WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS i FROM conversations WHERE text IS NOT NULL),
r AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, role ORDER BY i) AS run FROM c),
p AS (SELECT conv_id, role, run, min(i) AS first, trim(string_agg(text, '' ORDER BY i)) AS t FROM r GROUP BY ALL)
SELECT conv_id, md5(regexp_replace(regexp_replace(string_agg(t, ' ' ORDER BY first), '\([ \t-\r]+', '(', 'g'), '[ \t-\r]+([,;.)])', '\1', 'g')) AS text FROM p WHERE t <> '' GROUP BY conv_id""")
def c25(spark, d):
    """A note's pieces in visual order: runs of one script joined as they stand, runs by blanks, none before a stop or inside a bracket."""
    rows = load(spark, d, "conversations", "conv_id", "turn", "role", "text").filter("text is not null")
    back = ["turn", "text"]
    runs = order.runs_of_equal(rows, ["conv_id"], [F.desc(c) for c in back], F.col("role"))
    latest = F.reverse(F.array_sort(F.collect_list(F.struct(*back))))
    joined = runs.groupBy("conv_id", "run").agg(F.trim(F.array_join(F.transform(latest, lambda x: x["text"]), "")).alias("t")).filter("t <> ''")
    text = joined.groupBy("conv_id").agg(F.array_join(order.ordered(["run"], "t"), " ").alias("text"))
    return text.select("conv_id", F.md5(folds.tight(F.col("text"))).alias("text"))


RULE = "–––"
NOTES = f"""(SELECT conv_id, turn AS ord, CASE turn % 4 WHEN 0 THEN 'sigla' WHEN 1 THEN 'app' WHEN 2 THEN 'sigla' ELSE 'margin' END AS kind,
  CASE (conv_id + turn) % 5 WHEN 0 THEN n || ' {RULE}' WHEN 1 THEN '{RULE} ' || n WHEN 2 THEN '{RULE} ' || n || ' {RULE}' ELSE n END AS text
  FROM (SELECT conv_id, turn, min(role) || ' ' || turn AS n FROM conversations GROUP BY conv_id, turn))"""


@query("c27_note_sequences", f"""
WITH n AS (SELECT *, text LIKE '{RULE}%' AS opens, text LIKE '%{RULE}' AS closes FROM {NOTES}),
s AS (SELECT *, min(CASE WHEN kind NOT IN ('sigla', 'app') OR opens THEN ord END) OVER (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM n),
k AS (SELECT s.*, o.kind = 'sigla' AND s.kind = 'sigla' AND s.closes AND NOT s.opens AS begins FROM s LEFT JOIN s o ON o.conv_id = s.conv_id AND o.ord = s.stop),
b AS (SELECT conv_id, stop, min(ord) AS start FROM k WHERE begins GROUP BY ALL),
g AS (SELECT n.*, b.start FROM n LEFT JOIN b ON b.conv_id = n.conv_id AND n.ord BETWEEN b.start AND b.stop)
SELECT conv_id, coalesce(start, ord) AS ord, CASE WHEN start IS NOT NULL OR (min(kind) = 'margin' AND bool_and(opens) AND bool_and(closes)) THEN 'order' ELSE min(kind) END AS kind,
  string_agg(CASE WHEN start IS NOT NULL AND kind = 'app' THEN '(' || trim(text) || ')' ELSE CASE WHEN start IS NULL THEN text ELSE trim(text) END END, ' ' ORDER BY ord DESC) AS text FROM g GROUP BY conv_id, coalesce(start, ord), start""")
def c27(spark, d):
    """A sign that closes a rule line, and what leads to the sign that opens it, as one note in visual order.

    The notes are read backwards. Every closing sign looks ahead to the next note that ends the search; if that one is a
    sign, all from the first closing one to it are one group.
    """
    rows = load(spark, d, "conversations", "conv_id", "turn", "role").groupBy("conv_id", F.col("turn").alias("ord")).agg(F.min("role").alias("r"))
    name, k = F.concat("r", F.lit(" "), F.col("ord").cast("string")), (F.col("conv_id") + F.col("ord")) % 5
    text = F.when(k == 0, F.concat(name, F.lit(f" {RULE}"))).when(k == 1, F.concat(F.lit(f"{RULE} "), name)).when(k == 2, F.concat(F.lit(f"{RULE} "), name, F.lit(f" {RULE}"))).otherwise(name)
    kind = F.get(F.array(*map(F.lit, ("sigla", "app", "sigla", "margin"))), (F.col("ord") % 4).cast("int"))
    return order.collapsed(rows.select("conv_id", "ord", kind.alias("kind"), text.alias("text")), "conv_id", "ord", RULE)


@query("c28_script_runs", f"""
WITH t AS (SELECT doc_id, 'a < ' || {to_hebrew_sql("source || ' ' || lang")} || ' & ' || lang AS t FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)
SELECT doc_id, '<bdi class="inl" dir="ltr">' || regexp_replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([֐-׿][֐-׿ \\t-\\r]*[֐-׿]|[֐-׿])', '<bdi class="heb">\\1</bdi>', 'g') || '</bdi>' AS html FROM t""")
def c28(spark, d):
    rows = load(spark, d, "documents", "doc_id", "source", "lang").filter("source is not null and lang is not null")
    mixed = F.concat(F.lit("a < "), to_hebrew(F.concat("source", F.lit(" "), "lang")), F.lit(" & "), "lang")
    return rows.select("doc_id", folds.inline(mixed).alias("html"))


KEEP = ("common", "minus", "ogabbr")
_KEPT = "cls IN ('common', 'minus', 'ogabbr')"


@query("f17_column_projection", f"""
WITH s AS (SELECT *, {_KEPT} AS kept FROM {SEGMENTS}),
g AS (SELECT *, coalesce(sum(CAST(kept AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM s),
d AS (SELECT *, coalesce(bool_or(NOT kept AND cls NOT IN ('mtvar', 'ogvar', 'mtsup')) OVER p, false) AS gap, coalesce(bool_or(NOT kept AND regexp_matches(text, '[ \\t-\\r]')) OVER p, false) AS spaced,
  coalesce(bool_or(NOT kept AND NOT regexp_matches(text, '[ \\t-\\r]$')) OVER p, false) AS hard FROM g WINDOW p AS (PARTITION BY doc_id, part)),
k AS (SELECT *, CASE WHEN gap THEN regexp_replace(text, '-([ \\t-\\r]*)$', ' \\1') ELSE text END AS t, lag(text) OVER (PARTITION BY doc_id ORDER BY ord) AS prev FROM d WHERE kept),
r AS (SELECT *, sum(CAST(gap AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM k),
h AS (SELECT *, {FRAGMENT(to_hebrew_sql("array_to_string(list_reverse(list(CASE WHEN spaced THEN t || ' ' ELSE t END) OVER (PARTITION BY doc_id, run ORDER BY ord ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)), '')"))} AS dangling FROM r),
c AS (SELECT *, prev IS NOT NULL AND hard AND NOT regexp_matches(prev, '^[ \\t-\\r]') AND coalesce(lag(dangling) OVER (PARTITION BY doc_id ORDER BY ord), false) AS closes FROM h)
SELECT doc_id, ord, md5(CASE WHEN closes THEN regexp_replace(t, '[ \\t-\\r]+$', '') WHEN spaced AND prev IS NOT NULL AND t <> '' AND NOT regexp_matches(t, '[ \\t-\\r`-]$') AND NOT regexp_matches(prev, '^[ \\t-\\r-]') THEN t || ' ' ELSE t END) AS text FROM c""")
def f17(spark, d):
    return order.projected(segments(spark, d), "doc_id", "ord", KEEP, VARIANTS).select("doc_id", "ord", F.md5("text").alias("text"))


OVER = "PARTITION BY user_id ORDER BY ts, event_id"


@query("f14_footnote_runs", f"""
WITH r AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type IN ('purchase', 'error') THEN 0 END IGNORE NULLS) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
  list(struct_pack(k := event_type, v := value)) OVER ({OVER} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM events)
SELECT event_id, coalesce(run = 1, false) AS footnote, coalesce(run <> 1 OR run IS NULL, true) AND event_type = 'error' AND coalesce(value - list_filter(near, lambda s: s.k = 'purchase' AND abs(s.v - value) < 30)[1].v >= 5, false) AS raised FROM r""")
def f14(spark, d):
    """Runs from a footnote's number to its last span, taken out; of the rest, a number raised over its line is a mark."""
    rows = order.carry(events(spark, d), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", 1).when(F.col("event_type").isin("purchase", "error"), 0), "run")
    frame = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 3)
    rows = rows.withColumn("near", F.collect_list(F.struct(F.col("event_type").alias("k"), F.col("value").alias("v"))).over(frame))
    line = F.get(F.filter("near", lambda s: (s["k"] == "purchase") & (F.abs(s["v"] - F.col("value")) < 30)), F.lit(0))["v"]
    run = F.coalesce(F.col("run") == 1, F.lit(False))
    return rows.select("event_id", run.alias("footnote"), (~run & (F.col("event_type") == "error") & F.coalesce(F.col("value") - line >= 5, F.lit(False))).alias("raised"))


@query("f19_notes_without_own_footnotes", r"""
WITH n AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), f AS (SELECT doc_id, l, list_transform(list_filter(l, lambda x: starts_with(x, 'Licensed')), lambda x: split_part(x, ' ', 2)) AS own FROM n)
SELECT doc_id, len(list_filter(l, lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^[0-9]{1,3}$') AND NOT list_contains(own, split_part(x, ' ', 2)))) AS n FROM f""")
def f19(spark, d):
    """Notes without blanks, page numbers, and those that bear the mark of one of the row's own footnotes."""
    mark = lambda x: F.split_part(x, F.lit(" "), F.lit(2))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    own = F.transform(F.filter(lines, lambda x: x.startswith("Licensed")), mark)
    rows = load(spark, d, "documents", "doc_id", "text").select("doc_id", lines.alias("l"), own.alias("own"))
    return rows.select("doc_id", F.size(F.filter("l", lambda x: (F.trim(x) != "") & ~x.rlike("^[0-9]{1,3}$") & ~F.array_contains("own", mark(x)))).cast("long").alias("n"))
