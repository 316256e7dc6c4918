"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from collatium.functions import arrow, folds
from collatium.operators import indexes, joins
from collatium.plans.catalog import query
from collatium.plans.common import READINGS, events, letters_sql, readings, skeleton_sql, tokens, tokens_sql
from collatium.sources.tables import load

LABELLED = tokens_sql(more="lang,")
LOCAL = tokens_sql("benchmark", "item_id")


def of(kind: str):
    return F.col("event_type") == kind


def kinds(spark, d, kind: str, *columns: str):
    return events(spark, d).filter(of(kind)).select(*columns)


@query("j1_positional_zip", """
WITH n AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events)
SELECT a.user_id, a.i, a.event_id AS view_id, b.event_id AS click_id FROM n a JOIN n b USING (user_id, i) WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def j1(spark, d):
    side = lambda kind: events(spark, d).filter(of(kind)).select("user_id", "ts", "event_id")
    views, clicks = side("view").withColumn("view_id", F.col("event_id")), side("click").withColumn("click_id", F.col("event_id"))
    return joins.zipped(views, clicks, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("i").cast("long").alias("i"), "view_id", "click_id")


def _nearest(bound: int, step: int):
    sql = f"""
WITH g AS (SELECT DISTINCT p_size * {step} AS mark FROM part)
SELECT event_id, arg_min(mark, struct_pack(d := abs(value - mark), m := mark)) AS mark FROM events LEFT JOIN g ON abs(value - mark) <= {bound} GROUP BY event_id"""

    def run(spark, d):
        marks = load(spark, d, "part", "p_size").select((F.col("p_size") * step).alias("mark")).distinct()
        return joins.nearest(events(spark, d, "event_id", "value"), marks, "value", "mark", "mark", bound).select("event_id", "mark")

    return sql, run


for _name, _bound, _step in (("j2_nearest_bounded", 6, 10), ("j3_nearest_margin", 4, 7)):
    _sql, _run = _nearest(_bound, _step)
    query(_name, _sql)(_run)


@query("j4_band_with_fallback", """
WITH s AS (SELECT user_id, value AS y, event_id AS line FROM events WHERE event_type = 'signup'),
b AS (SELECT e.event_id, count(DISTINCT s.line) FILTER (WHERE abs(e.value - s.y) <= 1) AS hits, min(s.line) FILTER (WHERE abs(e.value - s.y) <= 1) AS one,
  max(s.line) FILTER (WHERE s.y > e.value) AS above, min(s.line) AS least FROM events e LEFT JOIN s USING (user_id) GROUP BY e.event_id)
SELECT event_id, CASE WHEN hits = 1 THEN one ELSE coalesce(above, least) END AS line, hits <> 1 AS inferred FROM b""")
def j4(spark, d):
    left = events(spark, d, "event_id", "user_id", "value")
    lines = kinds(spark, d, "signup", "user_id", F.col("value").alias("y"), F.col("event_id").alias("line"))
    return joins.banded(left, lines, ["user_id"], "value", "y", "line", "event_id").select("event_id", "line", "inferred")


@query("j5_highest_line_above", """SELECT e.event_id, coalesce(max(s.event_id) FILTER (WHERE s.value > e.value), min(s.event_id)) AS line
  FROM events e JOIN events s ON e.user_id = s.user_id AND e.event_type = 'purchase' AND s.event_type = 'signup' GROUP BY e.event_id""")
def j5(spark, d):
    lines = kinds(spark, d, "signup", "user_id", F.col("value").alias("y"), F.col("event_id").alias("line"))
    rows = joins.highest_above(kinds(spark, d, "purchase", "user_id", "event_id", "value"), lines, ["user_id"], "value", "y", "line", "line")
    return rows.filter("line is not null").select("event_id", "line")


def _as_of(kind: str, by: str, name: str, forward: bool):
    near, order_ = (">=", "ASC") if forward else ("<=", "DESC")
    sql = f"""SELECT p.event_id, (SELECT s.event_id FROM events s WHERE s.user_id = p.user_id AND s.event_type = '{by}' AND s.ts {near} p.ts ORDER BY s.ts {order_}, s.event_id {order_} LIMIT 1) AS {name}
  FROM events p WHERE p.event_type = '{kind}'"""

    def run(spark, d):
        left = kinds(spark, d, kind, "event_id", "user_id", "ts")
        right = kinds(spark, d, by, F.col("event_id"), "user_id", "ts").withColumn(name, F.col("event_id"))
        return joins.as_of(left, right, ["user_id"], "ts", name, "event_id", forward).select("event_id", name)

    return sql, run


for _name, _args in (("j6_as_of", ("purchase", "signup", "heading_id", False)), ("j7_forward_as_of", ("signup", "purchase", "first_id", True))):
    _sql, _run = _as_of(*_args)
    query(_name, _sql)(_run)


@query("j8_stepwise_fallback", """
WITH a AS (SELECT doc_id, max(quality) AS v FROM labels GROUP BY 1), b AS (SELECT item_id AS doc_id, max(length(text)) AS v FROM benchmark GROUP BY 1), c AS (SELECT conv_id AS doc_id, max(turn) AS v FROM conversations GROUP BY 1)
SELECT doc_id, coalesce(a.v, b.v, c.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'labels' WHEN b.v IS NOT NULL THEN 'benchmark' WHEN c.v IS NOT NULL THEN 'conversations' ELSE 'none' END AS provenance
FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)""")
def j8(spark, d):
    table = lambda name, key, value: load(spark, d, name).groupBy(F.col(key).alias("doc_id")).agg(F.max(value).cast("long").alias("v"))
    steps = [(table("labels", "doc_id", F.col("quality")), "labels"), (table("benchmark", "item_id", F.length("text")), "benchmark"), (table("conversations", "conv_id", F.col("turn")), "conversations")]
    return joins.first_known(load(spark, d, "documents", "doc_id"), steps, "v", "doc_id")


MARKS = ("/en/", "/de/", "page=", "#top", ".html")


@query("j9_containment", f"SELECT page_id, min(i) AS mark FROM pages LEFT JOIN (VALUES {', '.join(f'({i}, {m!r})' for i, m in enumerate(MARKS))}) m(i, s) ON contains(url, s) GROUP BY page_id")
def j9(spark, d):
    marks = spark.createDataFrame(list(enumerate(MARKS)), "i int, s string")  # a fixed list
    return load(spark, d, "pages", "page_id", "url").join(F.broadcast(marks), F.contains(F.col("url"), F.col("s")), "left").groupBy("page_id").agg(F.min("i").alias("mark"))


OVERRIDES = {3: "three", 7: "seven", 40: "forty"}


@query("j10_override_lookup", f"SELECT doc_id, coalesce(o.s, d.source) AS source, o.s IS NOT NULL AS overridden FROM documents d LEFT JOIN (VALUES {', '.join(f'({k}, {v!r})' for k, v in OVERRIDES.items())}) o(k, s) ON doc_id = k")
def j10(spark, d):
    fixed = spark.createDataFrame(list(OVERRIDES.items()), "doc_id long, s string")
    rows = load(spark, d, "documents", "doc_id", "source").join(F.broadcast(fixed), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("s", "source").alias("source"), F.col("s").isNotNull().alias("overridden"))


@query("j11_reference_units", "SELECT doc_id, length(b.text) AS units FROM documents d LEFT JOIN benchmark b ON doc_id = item_id")
def j11(spark, d):
    units = load(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").cast("long").alias("units"))
    return load(spark, d, "documents", "doc_id").join(units, "doc_id", "left")


@query("j12_key_expansion", """
WITH k AS (SELECT doc_id, unnest([doc_id, doc_id + 1]) AS key, unnest([0, 1]) AS part FROM documents)
SELECT k.doc_id, string_agg(b.text, ' ' ORDER BY part, item_id) AS text FROM k JOIN benchmark b ON k.key = b.item_id GROUP BY k.doc_id""")
def j12(spark, d):
    keys = load(spark, d, "documents", "doc_id").select("doc_id", F.posexplode(F.array(F.col("doc_id"), F.col("doc_id") + 1)).alias("part", "item_id"))
    return keys.join(load(spark, d, "benchmark"), "item_id").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "item_id", "text"))), lambda x: x["text"]), " ").alias("text"))


@query("j13_two_tier_lookup", f"""
WITH t AS (SELECT doc_id, token, count(*) AS n FROM {tokens_sql()} GROUP BY ALL),
near AS (SELECT item_id AS doc_id, token, 'item' || item_id AS reading FROM {LOCAL} GROUP BY ALL),
far AS (SELECT token, min(lang) AS reading FROM {LABELLED} GROUP BY token HAVING count(DISTINCT lang) = 1)
SELECT doc_id, token, n, coalesce(near.reading, far.reading) AS reading, CASE WHEN near.reading IS NOT NULL THEN 'local' WHEN far.reading IS NOT NULL THEN 'index' ELSE 'none' END AS tier
FROM t LEFT JOIN near USING (doc_id, token) LEFT JOIN far USING (token)""")
def j13(spark, d):
    # languages are asked of each text's distinct words, which go to the index in few bytes; forms are counted and looked up apart
    docs = load(spark, d, "documents", "lang", "text")
    langs = docs.select("lang", F.explode(F.array_distinct(folds.words(F.col("text")))).alias("token")).groupBy("token", "lang").agg(F.count("*").alias("n"))
    far = indexes.sole(langs, "token", "lang").select("token", F.col("lang").alias("_far"))
    near = tokens(spark, d, "benchmark", "item_id").select(F.col("item_id").alias("doc_id"), "token").distinct().withColumn("_near", F.concat(F.lit("item"), "doc_id"))
    forms = tokens(spark, d).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    rows = forms.join(near, ["doc_id", "token"], "left").join(far.hint("shuffle_hash"), "token", "left")
    tier = F.when(F.col("_near").isNotNull(), "local").when(F.col("_far").isNotNull(), "index").otherwise("none")
    return rows.select("doc_id", "token", "n", F.coalesce("_near", "_far").alias("reading"), tier.alias("tier"))


@query("j14_lcs_alignment")
def j14(spark, d):
    truth = load(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("truth"))
    rows = load(spark, d, "documents", "doc_id", "text").join(truth, "doc_id")
    both = rows.select("doc_id", folds.words(F.col("text")).alias("a"), folds.words(F.col("truth")).alias("b"))
    return both.select("doc_id", F.explode(arrow.lcs_align("a", "b")).alias("p"), "a").select("doc_id", F.col("p.l").alias("left"), F.col("p.r").alias("right"), F.get("a", F.col("p.l")).alias("token"))


@query("j15_parsed_and_truth", f"SELECT b.item_id, length({letters_sql('b.text')}) AS want, length({letters_sql('d.text')}) AS got FROM benchmark b JOIN documents d ON doc_id = item_id")
def j15(spark, d):
    rows = load(spark, d, "benchmark").select("item_id", F.length(folds.letters(F.col("text"))).cast("long").alias("want"))
    return rows.join(load(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("item_id"), F.length(folds.letters(F.col("text"))).cast("long").alias("got")), "item_id")


@query("j16_truth_driven", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'ABSENT' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS status FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def j16(spark, d):
    marks = load(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    status = F.when(F.col("q").isNull(), "ABSENT").when(F.col("q") == 1, "good").otherwise("poor")
    return load(spark, d, "documents", "doc_id").join(marks, "doc_id", "left").select("doc_id", status.alias("status"))


@query("j17_full_outer_bags", f"""
WITH a AS (SELECT doc_id AS page, token, count(*) AS n FROM {tokens_sql()} GROUP BY ALL), b AS (SELECT item_id AS page, token, count(*) AS n FROM {LOCAL} GROUP BY ALL)
SELECT coalesce(a.page, b.page) AS page, coalesce(a.token, b.token) AS token, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n FROM a FULL JOIN b ON a.page = b.page AND a.token = b.token""")
def j17(spark, d):
    bag = lambda df, key, n: df.groupBy(F.col(key).alias("page"), "token").agg(F.count("*").alias(n))
    a, b = bag(tokens(spark, d), "doc_id", "left_n"), bag(tokens(spark, d, "benchmark", "item_id"), "item_id", "right_n")
    return a.join(b, ["page", "token"], "full").select("page", "token", F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))


@query("j18_vocabulary_membership", f"WITH t AS (SELECT token, count(*) AS n FROM {tokens_sql()} GROUP BY token) SELECT token, n, token IN (SELECT token FROM {LOCAL}) AS known FROM t")
def j18(spark, d):
    both = tokens(spark, d).select("token", F.lit(1).alias("n"), F.lit(False).alias("known")).unionByName(tokens(spark, d, "benchmark", "item_id").select("token", F.lit(0).alias("n"), F.lit(True).alias("known")))
    return both.groupBy("token").agg(F.sum("n").alias("n"), F.max("known").alias("known")).filter("n > 0")


@query("j19_range_anti", """SELECT event_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = e.user_id AND abs(epoch_us(c.ts) - epoch_us(e.ts)) <= 21600000000)""")
def j19(spark, d):
    return joins.free_of(kinds(spark, d, "error", "event_id", "user_id", "ts"), kinds(spark, d, "click", "user_id", "ts"), ["user_id"], "ts", 21600).select("event_id")


@query("j20_lookup_outcome", f"""
WITH i AS (SELECT {skeleton_sql('token')} AS key, count(DISTINCT token) AS n FROM {LOCAL} GROUP BY 1), t AS (SELECT token, {skeleton_sql('token')} AS key, count(*) AS c FROM {tokens_sql()} GROUP BY ALL)
SELECT token, c, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS outcome FROM t LEFT JOIN i USING (key)""")
def j20(spark, d):
    index = tokens(spark, d, "benchmark", "item_id").select(folds.skeleton(F.col("token")).alias("key"), "token").distinct().groupBy("key").agg(F.count("*").alias("n"))
    forms = tokens(spark, d).groupBy("token").agg(F.count("*").alias("c")).withColumn("key", folds.skeleton(F.col("token")))
    return forms.join(index, "key", "left").select("token", "c", joins.outcome(F.col("n")).alias("outcome"))


@query("j21_unit_pairs", """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(want), '(\\p{L}+)', 1) AS a, regexp_extract_all(lower(got), '(\\p{L}+)', 1) AS b FROM """ + READINGS + """)
SELECT doc_id, len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) AS differing FROM w WHERE len(a) = len(b)""")
def j21(spark, d):
    rows = readings(spark, d).select("doc_id", folds.words(F.col("want")).alias("a"), folds.words(F.col("got")).alias("b")).filter("size(a) = size(b)")
    return rows.select("doc_id", F.size(F.filter(F.arrays_zip("a", "b"), lambda p: p["a"] != p["b"])).cast("long").alias("differing"))


@query("j22_sequence_diff")
def j22(spark, d):
    """Truth against text, opening lines first: word sequences of documents and the benchmark item of their number."""
    truth = load(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), folds.letters(F.col("text")).alias("want"))
    rows = truth.join(load(spark, d, "documents", "doc_id", "text").select("doc_id", folds.letters(F.col("text")).alias("got")), "doc_id")
    return rows.select("doc_id", F.explode(arrow.sequence_diff("want", "got")).alias("r")).select("doc_id", "r.op", "r.at", "r.want", "r.got")


ANCHORS = ("tion", "ment", "heit", "ción", "the")


@query("j23_first_anchor", f"SELECT doc_id, min(i) AS anchor FROM documents LEFT JOIN (VALUES {', '.join(f'({i}, {a!r})' for i, a in enumerate(ANCHORS))}) a(i, s) ON contains(lower(text), s) GROUP BY doc_id")
def j23(spark, d):
    first = F.coalesce(*[F.when(F.contains(F.lower("text"), F.lit(a)), i) for i, a in enumerate(ANCHORS)])
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", first.alias("anchor"))


@query("j25_navigation", """SELECT c_custkey, n_name, r_name, count(o_orderkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def j25(spark, d):
    up = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    down = load(spark, d, "orders", "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("k"))
    rows = load(spark, d, "customer", "c_custkey", "c_nationkey").join(up, F.col("c_nationkey") == F.col("n_nationkey")).join(down, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", "n_name", "r_name", F.coalesce("k", F.lit(0)).alias("n"))
