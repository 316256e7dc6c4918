"""Queries of sources, sinks, filters, scalar functions and the notation parser."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from collatium.functions import arrow, folds
from collatium.operators import notation, order
from collatium.plans.catalog import query
from collatium.plans.common import BY, ORDER, OVER, READINGS, events, letters_sql, readings, skeleton_sql, tokens, unaccented_sql
from collatium.sources import sinks
from collatium.sources.tables import embedded, load, mixed_anchor, optional, paragraphs

def _text():
    return F.col("text")


def documents(spark, d, *columns):
    return load(spark, d, "documents", "doc_id", *(columns or ("text",)))


@query("s4_pruned_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_returnflag = 'R'")
def s4(spark, d):
    return load(spark, d, "lineitem").filter((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("s5_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_array_length('[\"mt\",' || event_id || ']') AS parts, event_id AS anchor_n FROM events")
def s5(spark, d):
    pair = F.concat(F.lit('["mt",'), F.col("event_id").cast("string"), F.lit("]"))
    return load(spark, d, "events", "event_id", "props").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.json_array_length(pair).cast("long").alias("parts"), mixed_anchor(pair)["n"].cast("long").alias("anchor_n"))


@query("s6_optional_source", "SELECT doc_id, CAST(NULL AS VARCHAR) AS note FROM documents")
def s6(spark, d):
    return documents(spark, d, "lang").select("doc_id").join(optional(spark, f"{d}/notes_that_may_be_missing.parquet", "doc_id long, note string"), "doc_id", "left")


@query("s7_html_read_back", r"SELECT page_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS ord, unnest(p) AS body FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS p FROM pages)")
def s7(spark, d):
    return load(spark, d, "pages", "page_id", "html").select("page_id", F.posexplode(paragraphs(F.col("html"))).alias("ord", "body"))


@query("s8_embedded_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s8(spark, d):
    page = F.concat(F.lit("<script>var pool = "), "props", F.lit(";</script>"))
    return load(spark, d, "events", "event_id", "props").select("event_id", embedded(page, "pool", "k long")["k"].alias("k"))


@query("k3_document_per_group", """SELECT conv_id, md5('<title>' || conv_id || '</title>' || chr(10) || string_agg('<p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>', chr(10) ORDER BY turn, text)) AS html FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def k3(spark, d):
    rows = load(spark, d, "conversations", "conv_id", "turn", "text").filter("text is not null")
    line = F.concat(F.lit("<p>"), folds.escaped(_text()), F.lit("</p>"))
    return sinks.documents(rows.withColumn("own", _text()), ["conv_id"], ["turn", "own"], line, F.col("conv_id").cast("string")).select("conv_id", F.md5("html").alias("html"))


@query("k5_report", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars < 500) AS short, round(count(*) FILTER (WHERE n_chars < 500) / greatest(count(*), 1), 6) AS share FROM documents GROUP BY lang")
def k5(spark, d):
    short = F.count_if(F.col("n_chars") < 500)
    return load(spark, d, "documents", "lang", "n_chars").groupBy("lang").agg(F.count("*").alias("n"), short.alias("short"), F.round(short / F.greatest(F.count("*"), F.lit(1)), 6).alias("share"))


@query("k6_rejects", "SELECT doc_id, CASE WHEN contains(text, '!!') THEN 'shout' WHEN contains(text, '%%%') THEN 'symbols' END AS reject_reason FROM documents WHERE contains(text, '!!') OR contains(text, '%%%')")
def k6(spark, d):
    reason = F.when(F.contains(_text(), F.lit("!!")), "shout").when(F.contains(_text(), F.lit("%%%")), "symbols")
    return sinks.routed(documents(spark, d), reason)[1].select("doc_id", "reject_reason")


@query("f1_kind", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'HEB' WHEN contains(lower(p_name), 'bolt') THEN 'GRK' WHEN contains(lower(p_type), 'small') THEN 'BOLD' ELSE 'APP' END AS kind FROM part")
def f1(spark, d):
    has = lambda c, s: F.contains(F.lower(c), F.lit(s))
    return load(spark, d, "part").select("p_partkey", F.when(has("p_name", "ring"), "HEB").when(has("p_name", "bolt"), "GRK").when(has("p_type", "small"), "BOLD").otherwise("APP").alias("kind"))


HEADING = r"/([a-z]{2})/([0-9]+)(?:.*page=([0-9]+))?"


@query("f2_heading", f"SELECT page_id, regexp_extract(url, '{HEADING}', 1) AS book, TRY_CAST(nullif(regexp_extract(url, '{HEADING}', 2), '') AS INTEGER) AS chapter, coalesce(TRY_CAST(nullif(regexp_extract(url, '{HEADING}', 3), '') AS INTEGER), 1) AS first FROM pages WHERE url IS NOT NULL")
def f2(spark, d):
    url = F.col("url")
    number = lambda i: F.nullif(F.regexp_extract(url, HEADING, i), F.lit("")).try_cast("int")
    return load(spark, d, "pages", "page_id", "url").filter(url.isNotNull()).select("page_id", F.regexp_extract(url, HEADING, 1).alias("book"), number(2).alias("chapter"), F.coalesce(number(3), F.lit(1)).alias("first"))


@query("f3_unparsable", "SELECT page_id, CASE WHEN NOT regexp_matches(url, '/[a-z]{2}/[0-9]') THEN 'no heading' WHEN contains(url, 'ref=') THEN 'supplement' END AS reject_reason FROM pages WHERE NOT regexp_matches(url, '/[a-z]{2}/[0-9]') OR contains(url, 'ref=')")
def f3(spark, d):
    url = F.col("url")
    return sinks.routed(load(spark, d, "pages", "page_id", "url"), F.when(~url.rlike("/[a-z]{2}/[0-9]"), "no heading").when(F.contains(url, F.lit("ref=")), "supplement"))[1].select("page_id", "reject_reason")


@query("f5_null_tokens", "SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN event_type END AS kind FROM events")
def f5(spark, d):
    return events(spark, d, "event_id", "event_type").select("event_id", F.when(~F.col("event_type").isin("error", "view"), F.col("event_type")).alias("kind"))


@query("f4_entity_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linenumber = 2")
def f4(spark, d):
    """The book and chapter that are wanted; the scan gets the filter."""
    return load(spark, d, "lineitem").filter(F.col("l_returnflag").isin("A", "N") & (F.col("l_linenumber") == 2)).select("l_orderkey", "l_linenumber")


#: A label once markup is taken out; with raised sigla in it only if a small letter or a digit is there too.
LABEL, SIGLA = "^[a-z]{0,3}[0-9]{0,2}$", "^[PDQa-z0-9]{1,6}$"


@query("f6_label", rf"""
WITH f AS (SELECT doc_id, regexp_replace(m, '[#§%_»«]', '', 'g') AS flat FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '_' || source WHEN 1 THEN source || '_P_' WHEN 2 THEN 'P' ELSE '» ' || source END AS m FROM documents))
SELECT doc_id, trim(flat) <> '' AND (regexp_matches(trim(flat), '{LABEL}') OR regexp_matches(trim(flat), '{SIGLA}') AND regexp_matches(flat, '[a-z0-9]')) AS label FROM f""")
def f6(spark, d):
    k, source = F.col("doc_id") % 4, F.col("source")
    mark = F.when(k == 0, F.concat(F.lit("_"), source)).when(k == 1, F.concat(source, F.lit("_P_"))).when(k == 2, "P").otherwise(F.concat(F.lit("» "), source))
    flat = F.trim(F.regexp_replace(mark, "[#§%_»«]", ""))
    return documents(spark, d, "source").select("doc_id", ((flat != "") & (flat.rlike(LABEL) | (flat.rlike(SIGLA) & flat.rlike("[a-z0-9]")))).alias("label"))


@query("f7_last_label", "SELECT user_id, arg_max(event_id, struct_pack(ts := ts, e := event_id)) AS last_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS all_ids FROM events WHERE event_type = 'purchase' AND value BETWEEN 20 AND 120 GROUP BY user_id")
def f7(spark, d):
    band = events(spark, d).filter((F.col("event_type") == "purchase") & F.col("value").between(20, 120)).withColumn("id", F.col("event_id").cast("string"))
    return band.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"), F.array_join(order.ordered(ORDER, "id"), ",").alias("all_ids"))


@query("f8_size_match", "SELECT event_id, list_bool_or(list_transform([7.5, 12.0, 40.25], lambda s: abs(value - s) < 0.5)) AS sized FROM events")
def f8(spark, d):
    return events(spark, d).select("event_id", F.exists(F.array(*map(F.lit, (7.5, 12.0, 40.25))), lambda s: F.abs(F.col("value") - s) < 0.5).alias("sized"))


@query("f9_stream_routing", "SELECT CASE WHEN event_type = 'signup' THEN 'heading' WHEN event_type = 'error' THEN 'title' WHEN value > 50 THEN 'panel' ELSE 'body' END AS role, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def f9(spark, d):
    role = F.when(F.col("event_type") == "signup", "heading").when(F.col("event_type") == "error", "title").when(F.col("value") > 50, "panel").otherwise("body")
    return events(spark, d).groupBy(role.alias("role")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("f10_column_band", f"SELECT event_id, CASE WHEN value < 30 OR (event_type = 'click' AND coalesce(lead(value) OVER ({OVER}), 0) < 30) THEN 'margin' ELSE 'text' END AS col FROM events")
def f10(spark, d):
    ahead = F.coalesce(F.lead("value").over(Window.partitionBy(*BY).orderBy(*ORDER)), F.lit(0.0))
    return events(spark, d).select("event_id", F.when((F.col("value") < 30) | ((F.col("event_type") == "click") & (ahead < 30)), "margin").otherwise("text").alias("col"))


FOLD = """list_reduce(list_transform({c}, lambda x: {{'d': CASE x WHEN '<' THEN 1 WHEN '>' THEN -1 ELSE 0 END, 'bad': false}}),
  lambda a, x: {{'d': greatest(a.d + x.d, 0), 'bad': a.bad OR a.d + x.d < 0}}, {{'d': 0, 'bad': false}})"""


@query("f11_unopened_closer", f"SELECT page_id, ({FOLD.format(c='c')}).bad AS bad FROM (SELECT page_id, list_filter(string_split(regexp_replace(html, '[^<>]', '', 'g'), ''), lambda x: x <> '') AS c FROM pages)")
def f11(spark, d):
    marks = folds.chars(F.regexp_replace("html", "[^<>]", ""))
    return load(spark, d, "pages", "page_id", "html").select("page_id", order.unopened(marks, "<", ">").alias("bad"))


@query("f12_reach_back", "SELECT page_id, CASE WHEN html LIKE '%>' AND strpos(reverse(html), '<') BETWEEN 2 AND 40 AND strpos(substr(reverse(html), 2), '>') >= strpos(reverse(html), '<') - 1 THEN strpos(reverse(html), '<') ELSE 0 END AS reach FROM pages")
def f12(spark, d):
    return load(spark, d, "pages", "page_id", "html").select("page_id", order.reach_back(folds.chars(F.substring("html", -40, 40)), "<", ">", 40).cast("long").alias("reach"))


@query("f13_reference", r"SELECT page_id, regexp_matches(regexp_replace(url, '[#/]+[a-z]*$', ''), '[0-9]+$') AS reference FROM pages")
def f13(spark, d):
    return load(spark, d, "pages", "page_id", "url").select("page_id", F.regexp_replace("url", "[#/]+[a-z]*$", "").rlike("[0-9]+$").alias("reference"))


@query("f14_footnote_run", f"""
WITH m AS (SELECT *, max(CAST(event_type = 'error' AND value < 60 AS INTEGER)) OVER ({OVER} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS near FROM events)
SELECT event_id, near AND value < 20 AS raised FROM m""")
def f14(spark, d):
    rows = order.near_first(events(spark, d), BY, ORDER, F.when((F.col("event_type") == "error") & (F.col("value") < 60), 1))
    return rows.select("event_id", (F.col("near").isNotNull() & (F.col("value") < 20)).alias("raised"))


@query("f15_split_at_gap", r"SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS piece, unnest(list_transform(p, lambda x: length(x))) AS width FROM (SELECT doc_id, string_split(want, ' | ') AS p FROM " + READINGS + ")")
def f15(spark, d):
    return readings(spark, d).select("doc_id", F.posexplode(F.split("want", r" \| ")).alias("piece", "part")).select("doc_id", "piece", F.length("part").cast("long").alias("width"))


@query("f16_empty_lines", r"SELECT doc_id, len(list_filter(string_split(want, chr(10)), lambda x: trim(x) <> '')) AS lines FROM " + READINGS)
def f16(spark, d):
    return readings(spark, d).select("doc_id", F.size(F.filter(F.split("want", "\n"), lambda x: F.trim(x) != "")).cast("long").alias("lines"))


@query("f18_blank_rendering", f"SELECT doc_id, length({skeleton_sql('text')}) AS shown FROM documents WHERE {skeleton_sql('text')} <> ''")
def f18(spark, d):
    return documents(spark, d).withColumn("s", folds.skeleton(_text())).filter("s <> ''").select("doc_id", F.length("s").cast("long").alias("shown"))


@query("f19_note_filters", r"""WITH n AS (SELECT doc_id, list_filter(string_split(want, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^[0-9]{1,3}$') AND NOT starts_with(x, 'Licensed')) AS notes FROM """ + READINGS + """)
SELECT doc_id, len(notes) AS n, md5(array_to_string(notes, '|')) AS notes FROM n""")
def f19(spark, d):
    kept = F.filter(F.split("want", "\n"), lambda x: (F.trim(x) != "") & ~x.rlike("^[0-9]{1,3}$") & ~x.startswith("Licensed"))
    return readings(spark, d).select("doc_id", F.size(kept).cast("long").alias("n"), F.md5(F.array_join(kept, "|")).alias("notes"))


@query("f20_geometric_bands", "SELECT event_id, ts, value FROM events WHERE value > 15 AND value < 240 AND NOT (event_type = 'view' AND value < 45)")
def f20(spark, d):
    v = F.col("value")
    return events(spark, d).filter((v > 15) & (v < 240) & ~((F.col("event_type") == "view") & (v < 45))).select("event_id", "ts", "value")


@query("f21_eligible_group", "SELECT user_id, bool_and(event_type IN ('view', 'click', 'signup', 'purchase')) AS eligible FROM events GROUP BY user_id, date_trunc('day', ts)")
def f21(spark, d):
    kinds = events(spark, d).groupBy("user_id", F.date_trunc("day", F.col("ts")).alias("day")).agg(F.collect_set("event_type").alias("k"))
    return kinds.select("user_id", F.forall("k", lambda x: x.isin("view", "click", "signup", "purchase")).alias("eligible"))


@query("f22_script_purity", r"SELECT doc_id, regexp_matches(text, '^[\p{Latin}\p{Common}]*$') AS latin, regexp_matches(text, '[^\x00-\x7F]') AS beyond_ascii FROM documents")
def f22(spark, d):
    return documents(spark, d).select("doc_id", _text().rlike(r"^[\p{IsLatin}\p{IsCommon}]*$").alias("latin"), _text().rlike(r"[^\x00-\x7F]").alias("beyond_ascii"))


@query("f23_pointed_only", f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '(\\p{{L}}+)', 1)) AS token FROM documents) WHERE {unaccented_sql('token')} <> token GROUP BY token")
def f23(spark, d):
    forms = tokens(spark, d).groupBy("token").agg(F.count("*").alias("n"))
    return forms.filter(folds.unaccented(F.col("token")) != F.col("token"))


@query("f24_character_subset", r"SELECT page_id, regexp_matches(regexp_replace(url, '^[a-z]+://', ''), '^[a-z0-9./]*$') AS bare FROM pages")
def f24(spark, d):
    return load(spark, d, "pages", "page_id", "url").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").rlike("^[a-z0-9./]*$").alias("bare"))


@query("c1_skeleton", f"SELECT doc_id, md5({skeleton_sql('text')}) AS skeleton, length({letters_sql('text')}) AS letters FROM documents")
def c1(spark, d):
    return documents(spark, d).select("doc_id", F.md5(folds.skeleton(_text())).alias("skeleton"), F.length(folds.letters(_text())).cast("long").alias("letters"))


@query("c2_accent_fold", f"SELECT doc_id, md5({unaccented_sql('text')}) AS folded, md5(strip_accents(lower(text))) AS nfd FROM documents")
def c2(spark, d):
    return documents(spark, d).select("doc_id", F.md5(folds.unaccented(_text())).alias("folded"), F.md5(arrow.nfd_fold("text")).alias("nfd"))


@query("c7_base_units", r"SELECT doc_id, md5(array_to_string(list_reverse(regexp_extract_all(want, '([^aeiou ][aeiou]*)', 1)), '')) AS units FROM " + READINGS)
def c7(spark, d):
    return readings(spark, d).select("doc_id", F.md5(F.array_join(F.reverse(F.regexp_extract_all("want", F.lit("([^aeiou ][aeiou]*)"), 1)), "")).alias("units"))


@query("c9_dictionary_rejoin")
def c9(spark, d):
    """Words broken in two after their fourth letter, joined again by the corpus's own vocabulary, matched as a table."""
    token = F.col("token")
    whole = tokens(spark, d, "benchmark", "item_id").filter(F.length("token") > 6).select(F.col("item_id").alias("doc_id"), "ord", "token")
    pieces = whole.select("doc_id", "ord", F.posexplode(F.array(F.substring("token", 1, 4), F.expr("substring(token, 5)"))).alias("half", "token"))
    line = pieces.groupBy("doc_id").agg(order.ordered(["ord", "half"], "token").alias("parts"))
    vocabulary = tokens(spark, d, "benchmark", "item_id").select("token").distinct()
    runs = line.select("doc_id", F.posexplode("parts").alias("at", "_t"), "parts").select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.array_join(F.slice("parts", F.col("at") + 1, k), ""))).alias("token"))
    known = runs.distinct().join(vocabulary, "token", "left_semi").groupBy("doc_id").agg(F.collect_set(token).alias("known"))
    return line.join(known, "doc_id", "left").select("doc_id", F.size("parts").alias("parts"), F.array_join(arrow.rejoin("parts", "known", F.lit(None).cast("array<string>")), " ").alias("joined"))


@query("c10_edge_tokens", r"SELECT doc_id, regexp_extract(want, '^[ \-]*([^ \-]+)', 1) AS first, regexp_extract(want, '([^ \-]+)[ \-]*$', 1) AS last FROM " + READINGS)
def c10(spark, d):
    return readings(spark, d).select("doc_id", folds.edge(F.col("want")).alias("first"), folds.edge(F.col("want"), last=True).alias("last"))


@query("c16_digit_tables", "SELECT event_id, translate(CAST(event_id AS VARCHAR), '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') AS raised, CAST(event_id AS VARCHAR) AS back FROM events")
def c16(spark, d):
    up = folds.digits_up(F.col("event_id").cast("string"))
    return events(spark, d, "event_id").select("event_id", up.alias("raised"), folds.digits_down(up).alias("back"))


@query("c18_doubled_marks", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(want, '\.\.+', '.', 'g'), ',,+', ',', 'g'), ';;+', ';', 'g'), '::+', ':', 'g'), '!!+', '!', 'g'), '\?\?+', '?', 'g')) AS text FROM " + READINGS)
def c18(spark, d):
    return readings(spark, d).select("doc_id", F.md5(folds.single_marks(F.col("want"))).alias("text"))


#: Words with the blanks before them, which are spelled out: engines differ in what they count as blank.
SPACED = r"[ \t-\r]*[^ \t-\r]+"


@query("c21_spaced_words", rf"SELECT doc_id, len(regexp_extract_all(want, '{SPACED}')) AS n, md5(array_to_string(regexp_extract_all(want, '{SPACED}'), '|')) AS words FROM " + READINGS)
def c21(spark, d):
    parts = F.regexp_extract_all("want", F.lit(SPACED), 0)
    return readings(spark, d).select("doc_id", F.size(parts).cast("long").alias("n"), F.md5(F.array_join(parts, "|")).alias("words"))


@query("c22_tokenise", r"SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS ord, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(want, '(\p{L}+|[0-9]+|[^\p{L}0-9 ]+)', 1) AS t FROM " + READINGS + ")")
def c22(spark, d):
    return readings(spark, d).select("doc_id", F.posexplode(F.regexp_extract_all("want", F.lit(r"(\p{L}+|[0-9]+|[^\p{L}0-9 ]+)"), 1)).alias("ord", "token"))


@query("c29_cells", r"""
WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS body FROM pages),
t AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(body, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM p)
SELECT page_id, text, count(*) AS n FROM t GROUP BY ALL""")
def c29(spark, d):
    cells = load(spark, d, "pages", "page_id", "html").select("page_id", F.explode(paragraphs(F.col("html"))).alias("body")).select("page_id", folds.cell(F.col("body")).alias("text"))
    return cells.groupBy("page_id", "text").agg(F.count("*").alias("n"))


@query("c30_context", """SELECT doc_id, substr(want, greatest(strpos(want, 'e') - 12, 1), strpos(want, 'e') - greatest(strpos(want, 'e') - 12, 1)) || '[' || substr(want, strpos(want, 'e'), 3) || ']' || substr(want, strpos(want, 'e') + 3, 12) AS context FROM """ + READINGS + " WHERE contains(want, 'e')")
def c30(spark, d):
    at = F.instr("want", "e")
    return readings(spark, d).filter(at > 0).select("doc_id", folds.context(F.col("want"), at, F.lit(3)).alias("context"))


MOSTLY = "coalesce({a} <> '' AND {b} <> '' AND (contains({b}, {a}) OR contains({a}, {b})) AND 2 * least(length({a}), length({b})) >= greatest(length({a}), length({b})), false)"


@query("c31_mostly", f"""
WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id), p AS (SELECT doc_id, coalesce(source, '') AS a, CASE doc_id % 4 WHEN 0 THEN source || source WHEN 1 THEN substr(source, 2) WHEN 2 THEN source || source || 'x' ELSE lang END AS b FROM documents JOIN l USING (doc_id))
SELECT doc_id, {MOSTLY.format(a='a', b='b')} AS mostly FROM p""")
def c31(spark, d):
    k, source = F.col("doc_id") % 4, F.col("source")
    other = F.when(k == 0, F.concat(source, source)).when(k == 1, F.expr("substring(source, 2)")).when(k == 2, F.concat(source, source, F.lit("x"))).otherwise(F.col("lang"))
    rows = documents(spark, d, "source", "lang").join(load(spark, d, "labels", "doc_id").distinct(), "doc_id")
    return rows.select("doc_id", folds.mostly(F.coalesce(source, F.lit("")), other).alias("mostly"))


@query("c32_locate", f"""
WITH r AS (SELECT doc_id, {letters_sql("split_part(want, ' ', 1)")} AS run, {letters_sql('want')} AS og, {letters_sql("substr(got, 2)")} AS mt, {letters_sql("split_part(want, ' ', 2)")} AS note, reverse({letters_sql('want')}) AS parsed FROM {READINGS})
SELECT doc_id, CASE WHEN length(run) < 3 THEN 'short' WHEN contains(mt, run) THEN 'misordered' WHEN doc_id % 5 > 1 AND contains(og, run) THEN 'alexandrian'
  WHEN {MOSTLY.format(a='run', b='note')} THEN 'margin' WHEN contains(parsed, run) THEN 'parsed' ELSE 'lost' END AS place FROM r""")
def c32(spark, d):
    """Where a text's first word is found: in the other reading, in the text, in a note (its second word), or in the parse (the text backwards)."""
    word = lambda i: folds.letters(F.get(F.split("want", " "), i))
    run, og, mt = word(0), folds.letters(F.col("want")), folds.letters(F.expr("substring(got, 2)"))
    place = folds.located(run, mt, F.when(F.col("doc_id") % 5 > 1, og).otherwise(F.lit("")), F.array(F.coalesce(word(1), F.lit(""))), F.reverse(og))
    return readings(spark, d).select("doc_id", place.alias("place"))


@query("c33_number_format", "SELECT lang, replace(format('{:,}', CAST(sum(n_chars) AS BIGINT)), ',', '.') AS chars FROM documents GROUP BY lang")
def c33(spark, d):
    return load(spark, d, "documents", "lang", "n_chars").groupBy("lang").agg(folds.continental(F.sum("n_chars")).alias("chars"))


KEYS = {"table": r" \| ", "shout": "!!", "digits": "[0-9]", "never": "☃"}


@query("c35_keys_in_use", " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) AS n FROM documents WHERE regexp_matches(text, '{rx}') HAVING count(*) > 0" for k, rx in KEYS.items()))
def c35(spark, d):
    hits = F.array_compact(F.array(*[F.when(_text().rlike(rx), k) for k, rx in KEYS.items()]))
    return documents(spark, d).select(F.explode(hits).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("c36_pattern_families", r"SELECT doc_id, len(regexp_extract_all(want, '[0-9]+[.,:][0-9]+')) AS refs, len(regexp_extract_all(want, '[A-Z]{4,}')) AS titles FROM " + READINGS)
def c36(spark, d):
    count = lambda rx: F.size(F.regexp_extract_all("want", F.lit(rx), 0)).cast("long")
    return readings(spark, d).select("doc_id", count("[0-9]+[.,:][0-9]+").alias("refs"), count("[A-Z]{4,}").alias("titles"))


def marked_lines(spark, d):
    rows = load(spark, d, "conversations", "conv_id", "turn", "text")
    return rows.select(F.col("conv_id").alias("page"), F.col("turn").cast("int").alias("clause_ord"), F.posexplode(F.split(notation.marked(F.coalesce("text", F.lit("")), F.col("turn")), "\n")).alias("line_ord", "text"))


@query("n1_notation_segments")
def n1(spark, d):
    return notation.parse(marked_lines(spark, d))


@query("n2_both_editions")
def n2(spark, d):
    segments = notation.parse(marked_lines(spark, d))
    a, b = notation.edition(segments, "a"), notation.edition(segments, "b").withColumnRenamed("text", "text_b")
    return a.withColumnRenamed("text", "text_a").join(b, ["page", "clause_ord"], "full")
