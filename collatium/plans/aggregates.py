"""Queries of aggregations, indexes, sets and sorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from collatium.functions import folds
from collatium.operators import indexes, order
from collatium.plans.catalog import query
from collatium.plans.common import READINGS, events, letters_sql, readings, skeleton_sql, tokens, tokens_sql, unaccented_sql
from collatium.sources.tables import load


@query("a1_ordered_concat", "SELECT conv_id, count(*) AS n, md5(string_agg(coalesce(text, ''), ' ' ORDER BY turn, text)) AS text FROM conversations GROUP BY conv_id")
def a1(spark, d):
    rows = load(spark, d, "conversations", "conv_id", "turn", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.md5(F.array_join(order.ordered(["turn"], "text"), " ")).alias("text"))


@query("a2_first_seen_groups", "SELECT source, min(doc_id) AS first_id, count(*) AS n, row_number() OVER (ORDER BY min(doc_id)) AS place FROM documents GROUP BY source")
def a2(spark, d):
    groups = load(spark, d, "documents", "doc_id", "source").groupBy("source").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    return order.placed(groups, ["first_id"])


@query("a3_unambiguous_index", f"SELECT token, min(lang) AS lang, count(*) AS n FROM {tokens_sql(more='lang,')} GROUP BY token HAVING count(DISTINCT lang) = 1")
def a3(spark, d):
    return indexes.unambiguous(tokens(spark, d, "documents", "doc_id", "lang"), "token", "lang")


@query("a4_token_counts", f"SELECT doc_id, token, count(*) AS n FROM {tokens_sql()} GROUP BY ALL")
def a4(spark, d):
    return tokens(spark, d).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("a5_vote_table", f"""
WITH c AS (SELECT token, lang, count(*) AS c FROM {tokens_sql(more='lang,')} WHERE lang IS NOT NULL GROUP BY ALL),
t AS (SELECT token, lang, c, sum(c) OVER (PARTITION BY token) AS n, row_number() OVER (PARTITION BY token ORDER BY c DESC, lang) AS r FROM c)
SELECT token, lang, CAST(n AS BIGINT) AS n, round(c / n, 6) AS purity, c / n < 0.95 AS mixed FROM t WHERE r = 1 AND n >= 5""")
def a5(spark, d):
    return indexes.votes(tokens(spark, d, "documents", "doc_id", "lang").filter("lang is not null"), "token", "lang")


@query("a6_form_counts", f"""
WITH f AS (SELECT {skeleton_sql('token')} AS key, token, count(*) AS c FROM {tokens_sql()} GROUP BY ALL)
SELECT key, count(*) AS forms, CAST(sum(c) AS BIGINT) AS n, first(token ORDER BY c DESC, token) AS top FROM f GROUP BY key""")
def a6(spark, d):
    forms = tokens(spark, d).groupBy("token").agg(F.count("*").alias("c")).withColumn("key", folds.skeleton(F.col("token")))
    return forms.groupBy("key").agg(F.count("*").alias("forms"), F.sum("c").alias("n"), F.min(F.struct((-F.col("c")).alias("c"), "token"))["token"].alias("top"))


@query("a7_scalar_stats", """
SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 4) AS mean,
  round(CAST(count(*) FILTER (WHERE n_chars > 1000) AS DOUBLE) / greatest(count(*) FILTER (WHERE n_chars <= 100), 1), 6) AS ratio FROM documents GROUP BY lang""")
def a7(spark, d):
    n = F.col("n_chars")
    return load(spark, d, "documents", "lang", "n_chars").groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(n).alias("chars"), F.round(F.avg(n), 4).alias("mean"), F.round(F.count_if(n > 1000) / F.greatest(F.count_if(n <= 100), F.lit(1)), 6).alias("ratio")
    )


@query("a8_conditional_distinct", r"""
SELECT user_id, count(DISTINCT CASE WHEN event_type <> 'error' THEN struct_pack(h := hour(ts), b := regexp_replace(event_type, '[a-e]+$', '')) END)
  + count(*) FILTER (WHERE event_type = 'error') AS sentences FROM events GROUP BY user_id""")
def a8(spark, d):
    base = F.when(F.col("event_type") == "error", "").otherwise(F.regexp_replace("event_type", "[a-e]+$", ""))
    rows = events(spark, d, "user_id", "ts", "event_type").withColumn("base", base)
    return rows.groupBy("user_id").agg((F.count_distinct(F.when(F.col("base") != "", F.struct(F.hour("ts"), "base"))) + F.count_if(F.col("base") == "")).alias("sentences"))


@query("a9_agreement", f"""
SELECT CASE WHEN regexp_extract_all(lower(want), '(\\p{{L}}+)', 1) = regexp_extract_all(lower(got), '(\\p{{L}}+)', 1) THEN 'words'
  WHEN {letters_sql('want')} = {letters_sql('got')} THEN 'letters' ELSE 'differ' END AS agreement, count(*) AS n FROM {READINGS} GROUP BY 1""")
def a9(spark, d):
    want, got = F.col("want"), F.col("got")
    kind = F.when(folds.words(want) == folds.words(got), "words").when(folds.letters(want) == folds.letters(got), "letters").otherwise("differ")
    return readings(spark, d).groupBy(kind.alias("agreement")).agg(F.count("*").alias("n"))


@query("a10_category_tally", r"""
SELECT c AS category, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN contains(text, '!!') THEN 'shout' END,
  CASE WHEN regexp_matches(text, '[0-9]') THEN 'digits' END, CASE WHEN n_chars > 1000 THEN 'long' END], lambda x: x IS NOT NULL)) AS c FROM documents) GROUP BY c""")
def a10(spark, d):
    t = F.col("text")
    kinds = F.array_compact(F.array(F.when(F.contains(t, F.lit("|")), "table"), F.when(F.contains(t, F.lit("!!")), "shout"), F.when(t.rlike("[0-9]"), "digits"), F.when(F.col("n_chars") > 1000, "long")))
    return load(spark, d, "documents", "text", "n_chars").select(F.explode(kinds).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("a11_all_placed", "SELECT user_id, bool_and(value > 0.5) AS placed, bool_or(value > 300) AS any_far FROM events GROUP BY user_id")
def a11(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.bool_and(F.col("value") > 0.5).alias("placed"), F.bool_or(F.col("value") > 300).alias("any_far"))


@query("a12_group_flag", "SELECT event_id, max(event_type = 'purchase') OVER (PARTITION BY user_id, date_trunc('day', ts)) OR value > 200 AS bar FROM events")
def a12(spark, d):
    w = Window.partitionBy("user_id", F.date_trunc("day", "ts"))
    return events(spark, d).select("event_id", (F.max(F.col("event_type") == "purchase").over(w) | (F.col("value") > 200)).alias("bar"))


@query("a13_extremes_with_default", "SELECT user_id, coalesce(min(value) FILTER (WHERE event_type = 'signup'), 0) AS low, coalesce(max(value) FILTER (WHERE event_type = 'error'), -1) AS high FROM events GROUP BY user_id")
def a13(spark, d):
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    return events(spark, d).groupBy("user_id").agg(F.coalesce(F.min(of("signup")), F.lit(0.0)).alias("low"), F.coalesce(F.max(of("error")), F.lit(-1.0)).alias("high"))


@query("a14_in_order_recall", f"""
WITH r AS (SELECT doc_id, string_split({letters_sql('want')}, '') AS w, string_split({letters_sql('got')}, '') AS g FROM {READINGS} WHERE {letters_sql('want')} <> '' AND {letters_sql('got')} <> ''),
k AS (SELECT doc_id, len(w) AS n, len(g) AS m, list_reduce(g, lambda a, c: {{'i': a.i + CAST(w[a.i + 1] IS NOT DISTINCT FROM c.s AS INTEGER), 's': c.s}}, {{'i': 0, 's': ''}}).i AS met
  FROM (SELECT doc_id, w, list_transform(g, lambda s: {{'i': 0, 's': s}}) AS g FROM r))
SELECT doc_id, met, round(met / n, 6) AS recall, met = n AND n = m AS exact FROM k""")
def a14(spark, d):
    want, got = folds.chars(folds.letters(F.col("want"))), folds.chars(folds.letters(F.col("got")))
    rows = readings(spark, d).select("doc_id", want.alias("w"), got.alias("g")).filter("size(w) > 0 and size(g) > 0")
    met = rows.withColumn("met", order.prefix_recall(F.col("w"), F.col("g")))
    return met.select("doc_id", "met", F.round(F.col("met") / F.size("w"), 6).alias("recall"), ((F.col("met") == F.size("w")) & (F.size("w") == F.size("g"))).alias("exact"))


@query("a15_dictionary_pool", f"""
SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY o, token) - 1 AS pool_id, '{{"f":"' || token || '","n":' || length(token) || '}}' AS entry
FROM (SELECT doc_id, token, min(ord) AS o FROM {tokens_sql()} GROUP BY ALL)""")
def a15(spark, d):
    rows = indexes.pool_of_lists(load(spark, d, "documents", "doc_id", "text"), "doc_id", folds.words(F.col("text")), "token")
    return rows.select("doc_id", "token", F.col("pool_id").cast("long").alias("pool_id"), F.to_json(F.struct(F.col("token").alias("f"), F.length("token").alias("n"))).alias("entry"))


@query("a16_corpus_ratio", f"SELECT source, round(sum(length({skeleton_sql('text')})) / greatest(sum(length({letters_sql('text')})), 1), 6) AS ratio FROM documents GROUP BY source")
def a16(spark, d):
    t = F.col("text")
    return load(spark, d, "documents", "source", "text").groupBy("source").agg(F.round(F.sum(F.length(folds.skeleton(t))) / F.greatest(F.sum(F.length(folds.letters(t))), F.lit(1)), 6).alias("ratio"))


@query("a17_attestation", f"""
WITH v AS (SELECT DISTINCT token FROM {tokens_sql('benchmark', 'item_id')}), f AS (SELECT DISTINCT {unaccented_sql('token')} AS token FROM v),
t AS (SELECT lang, token, count(*) AS n FROM {tokens_sql(more='lang,')} GROUP BY ALL)
SELECT lang, CAST(sum(n) AS BIGINT) AS n, round(coalesce(sum(n) FILTER (WHERE token IN (FROM v)), 0) / sum(n), 6) AS strict,
  round(coalesce(sum(n) FILTER (WHERE {unaccented_sql('token')} IN (FROM f)), 0) / sum(n), 6) AS loose FROM t GROUP BY lang""")
def a17(spark, d):
    known = tokens(spark, d, "benchmark", "item_id").select("token").distinct()
    folded = known.select(folds.unaccented(F.col("token")).alias("fold")).distinct()
    counts = tokens(spark, d, "documents", "doc_id", "lang").groupBy("lang", "token").agg(F.count("*").alias("n")).withColumn("fold", folds.unaccented(F.col("token")))
    rows = counts.join(known.withColumn("s", F.lit(True)), "token", "left").join(folded.withColumn("l", F.lit(True)), "fold", "left")
    share = lambda c: F.round(F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)) / F.sum("n"), 6)
    return rows.groupBy("lang").agg(F.sum("n").alias("n"), share("s").alias("strict"), share("l").alias("loose"))


@query("x1_multiset_difference", f"""
WITH b AS (SELECT item_id AS doc_id, token, count(*) AS n FROM {tokens_sql('benchmark', 'item_id')} GROUP BY ALL), a AS (SELECT doc_id, token, count(*) AS n FROM {tokens_sql()} GROUP BY ALL)
SELECT 'missing' AS side, doc_id, token, b.n - coalesce(a.n, 0) AS n FROM b LEFT JOIN a USING (doc_id, token) WHERE b.n > coalesce(a.n, 0)
UNION ALL SELECT 'extra', doc_id, token, a.n - coalesce(b.n, 0) FROM a LEFT JOIN b USING (doc_id, token) WHERE a.n > coalesce(b.n, 0)""")
def x1(spark, d):
    a, b = tokens(spark, d).select("doc_id", "token"), tokens(spark, d, "benchmark", "item_id").select(F.col("item_id").alias("doc_id"), "token")
    return indexes.bag_differences(a, b).withColumn("side", F.when(F.col("side") == "left", "extra").otherwise("missing"))


@query("x2_union_of_keys", "SELECT doc_id AS key FROM documents UNION SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark")
def x2(spark, d):
    keys = [load(spark, d, t).select(F.col(c).alias("key")) for t, c in (("documents", "doc_id"), ("labels", "doc_id"), ("benchmark", "item_id"))]
    return keys[0].union(keys[1]).union(keys[2]).distinct()


@query("x3_multiset_sum", "SELECT token, count(*) AS n FROM (SELECT event_type AS token FROM events UNION ALL SELECT role FROM conversations UNION ALL SELECT lang FROM documents) GROUP BY token")
def x3(spark, d):
    bags = [load(spark, d, t).select(F.col(c).alias("token")) for t, c in (("events", "event_type"), ("conversations", "role"), ("documents", "lang"))]
    return bags[0].unionAll(bags[1]).unionAll(bags[2]).groupBy("token").agg(F.count("*").alias("n"))


@query("x4_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def x4(spark, d):
    return load(spark, d, "documents", "doc_id").subtract(load(spark, d, "labels", "doc_id"))


@query("x5_disjoint", "SELECT doc_id, list_has_any(regexp_extract_all(lower(want), '(\\p{L}+)', 1), ['the', 'der', 'los', 'les']) AS meets FROM " + READINGS)
def x5(spark, d):
    return readings(spark, d).select("doc_id", F.arrays_overlap(folds.words(F.col("want")), F.array(*map(F.lit, ("the", "der", "los", "les")))).alias("meets"))


@query("x6_distinct", "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '(\\p{L}+)', 1))) AS kinds FROM documents")
def x6(spark, d):
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(F.array_distinct(folds.words(F.coalesce("text", F.lit(""))))).cast("long").alias("kinds"))


@query("o1_computed_sort", "SELECT row_number() OVER (ORDER BY lang, CAST(regexp_extract(source, '[0-9]+') AS INTEGER), doc_id) AS place, doc_id FROM documents")
def o1(spark, d):
    rows = load(spark, d, "documents", "doc_id", "lang", "source").withColumn("_n", F.regexp_extract("source", "[0-9]+", 0).cast("int"))
    return order.placed(rows, ["lang", "_n", "doc_id"]).select("place", "doc_id")


@query("o2_effective_key_sort", """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY floor(value / 10) DESC, CASE WHEN event_type = 'view' THEN 0 ELSE value END, event_id) AS place FROM events""")
def o2(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc(F.floor(F.col("value") / 10)), F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value")), "event_id")
    return events(spark, d).select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place"))


@query("o3_rounded_sort", "SELECT user_id, event_id, round_even(value * 2, 0) / 2 AS line, row_number() OVER (PARTITION BY user_id ORDER BY round_even(value * 2, 0), ts, event_id) AS place FROM events")
def o3(spark, d):
    line = F.bround(F.col("value") * 2)
    return events(spark, d).select("user_id", "event_id", (line / 2).alias("line"), F.row_number().over(Window.partitionBy("user_id").orderBy(line, "ts", "event_id")).cast("long").alias("place"))


@query("o4_reading_order", "SELECT doc_id, md5(array_to_string(list_reverse(regexp_extract_all(lower(want), '(\\p{L}+)', 1)), ' ')) AS reversed FROM " + READINGS)
def o4(spark, d):
    return readings(spark, d).select("doc_id", F.md5(F.array_join(F.reverse(folds.words(F.col("want"))), " ")).alias("reversed"))


@query("o5_top_k_per_group", f"""
SELECT lang, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM (SELECT lang, token, count(*) AS n FROM {tokens_sql(more='lang,')} GROUP BY ALL)) WHERE rank <= 12""")
def o5(spark, d):
    counts = tokens(spark, d, "documents", "doc_id", "lang").groupBy("lang", "token").agg(F.count("*").alias("n"))
    return indexes.top_per_group(counts, ["lang"], [F.desc("n"), "token"], 12).withColumn("rank", F.col("rank").cast("long"))


@query("o6_first_n", "SELECT doc_id, array_to_string(regexp_extract_all(lower(want), '(\\p{L}+)', 1)[1:3], ' ') AS opening FROM " + READINGS)
def o6(spark, d):
    return readings(spark, d).select("doc_id", F.array_join(F.slice(folds.words(F.col("want")), 1, 3), " ").alias("opening"))


@query("o7_bounded_keys", f"SELECT token, count(*) AS n FROM {tokens_sql()} GROUP BY token ORDER BY n DESC, token LIMIT 400")
def o7(spark, d):
    return tokens(spark, d).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(400)


@query("o8_insertion", "SELECT doc_id, md5(array_to_string(flatten(list_transform(regexp_extract_all(lower(want), '(\\p{L}+)', 1), lambda w, i: CASE WHEN i % 5 = 0 THEN [w, '*'] ELSE [w] END)), ' ')) AS marked FROM " + READINGS)
def o8(spark, d):
    parts = F.transform(folds.words(F.col("want")), lambda w, i: F.when((i + 1) % 5 == 0, F.array(w, F.lit("*"))).otherwise(F.array(w)))
    return readings(spark, d).select("doc_id", F.md5(F.array_join(F.flatten(parts), " ")).alias("marked"))
