"""Queries of what stands beside a column: margin lines, quotations, a translation's panel. Events stand for the pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatium.functions.scripts import to_hebrew_sql
from collatium.operators import columns
from collatium.plans.catalog import query
from collatium.plans.common import events

PIECES = """(SELECT user_id, event_id AS pos, CAST(floor(value / 25) AS INTEGER) AS line, 12.0 * floor(value / 25) + CASE event_type WHEN 'view' THEN 9 ELSE 0 END AS y, CAST(event_id * 37 % 400 AS DOUBLE) AS x,
  CASE event_type WHEN 'view' THEN 6.0 ELSE 10.0 END AS size, CASE WHEN event_type IN ('click', 'purchase') THEN 'HEB' ELSE 'APP' END AS kind,
  CASE event_type WHEN 'view' THEN CAST(event_id % 10 AS VARCHAR) WHEN 'click' THEN 'dg' WHEN 'purchase' THEN 'ab ' WHEN 'error' THEN 'x(' ELSE ' n' || event_id END AS text FROM events)"""


def by_type(**values) -> F.Column:
    """A value by event type; ``rest`` for all others."""
    rest = values.pop("rest", F.lit(None))
    out = F
    for name, value in values.items():
        out = out.when(F.col("event_type") == name, value)
    return out.otherwise(rest)


def pieces_of(d: str, spark: SparkSession, **columns_) -> DataFrame:
    return events(spark, d).select("user_id", F.col("event_id").alias("at"), *[c.alias(k) for k, c in columns_.items()])


@query("c26_margin_lines", f"""
WITH p AS {PIECES},
a AS (SELECT user_id, line FROM p GROUP BY ALL HAVING max(size) < 8),
n AS (SELECT p.user_id, p.pos, arg_min(q.line, {{'d': abs(q.y - p.y), 'y': q.y}}) AS near FROM p JOIN a USING (user_id, line) JOIN p q ON q.user_id = p.user_id AND q.size >= 8 AND abs(q.y - p.y) < 4 GROUP BY ALL),
r AS (SELECT p.* REPLACE (coalesce(n.near, p.line) AS line) FROM p LEFT JOIN n USING (user_id, pos)),
s AS (SELECT *, lag(kind) OVER (PARTITION BY user_id, line ORDER BY x, pos) AS prev FROM r),
u AS (SELECT *, sum(CASE WHEN kind = 'HEB' AND prev = 'HEB' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, line ORDER BY x, pos) AS unit FROM s),
b AS (SELECT user_id, line, arg_min(y, {{'x': x, 'pos': pos}}) AS base FROM r WHERE size >= 8 GROUP BY ALL),
g AS (SELECT user_id, line, unit, min(x) AS x, min(y) AS y, min(size) AS size, min(kind) AS kind, string_agg(text, '' ORDER BY x, pos) AS text,
  arg_max(x + 2 * 5.7::DOUBLE + CASE text WHEN 'ab ' THEN 4.1::DOUBLE ELSE 0.0::DOUBLE END, {{'x': x, 'pos': pos}}) AS edge FROM u GROUP BY ALL),
t AS (SELECT g.*, kind = 'APP' AND size < 8 AND base IS NOT NULL AND unit > 1 AND regexp_matches(text, '^[0-9]+$') AS idx, base FROM g LEFT JOIN b USING (user_id, line)),
v AS (SELECT *, CASE WHEN kind = 'HEB' THEN {to_hebrew_sql('text')} WHEN idx THEN translate(text, '0123456789', CASE WHEN y < base THEN '₀₁₂₃₄₅₆₇₈₉' ELSE '⁰¹²³⁴⁵⁶⁷⁸⁹' END) ELSE text END AS shown FROM t),
w AS (SELECT *, lag(shown) OVER o AS before, coalesce(lead(idx) OVER o, false) AS follows, last_value(CASE WHEN NOT idx THEN {{'e': CASE kind WHEN 'HEB' THEN edge ELSE x + 4.0 * length(shown) END, 'k': kind, 'u': unit}} END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS put FROM v WINDOW o AS (PARTITION BY user_id, line ORDER BY unit)),
z AS (SELECT user_id, line, string_agg(CASE WHEN NOT idx AND shown <> '' AND shown NOT LIKE ' %' AND before NOT LIKE '% ' AND (kind <> put.k OR x - (put.e + 4.0 * (unit - put.u - 1)) > 2.5) THEN ' ' ELSE '' END || CASE WHEN follows THEN rtrim(shown) ELSE shown END, '' ORDER BY unit) AS text FROM w GROUP BY ALL)
SELECT user_id, line, rtrim(trim(regexp_replace(text, ' +', ' ', 'g')), '( ') AS text FROM z WHERE rtrim(trim(text), '( ') <> ''""")
def c26(spark, d):
    number = F.col("event_id")
    text = by_type(view=(number % 10).cast("string"), click=F.lit("dg"), purchase=F.lit("ab "), error=F.lit("x("), rest=F.concat(F.lit(" n"), number.cast("string")))
    line, hebrew = F.floor(F.col("value") / 25).cast("int"), F.col("event_type").isin("click", "purchase")
    y = line * 12.0 + by_type(view=F.lit(9), rest=F.lit(0))
    pieces = pieces_of(d, spark, line=line, y=y, x=(number * 37 % 400).cast("double"), size=by_type(view=F.lit(6.0), rest=F.lit(10.0)), kind=F.when(hebrew, "HEB").otherwise("APP"), text=text)
    return columns.margin_lines(pieces, "user_id")


@query("c27_quotations", r"""
WITH n AS (SELECT user_id, event_id AS pos, CASE event_type WHEN 'signup' THEN 'sigla' WHEN 'click' THEN 'grk' WHEN 'view' THEN 'grk' WHEN 'error' THEN 'margin' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'margin' ELSE 'sigla' END END AS kind,
  CASE event_type WHEN 'signup' THEN '»' WHEN 'error' THEN event_id || ' « q »' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN '« ' || event_id || ' |' ELSE '«' END ELSE 'g' || event_id END AS text FROM events),
m AS (SELECT *, kind = 'sigla' AND text = '»' AND coalesce(lead(kind) OVER w = 'grk', false) AS opens, text LIKE '«%' AS shuts FROM n WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
s AS (SELECT *, sum(CASE WHEN opens THEN 1 WHEN shuts THEN -1 ELSE 0 END) OVER w AS s FROM m WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
f AS (SELECT *, shuts AND coalesce(lag(s) OVER w, 0) > least(0, coalesce(min(s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS used FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
c AS (SELECT user_id, count(*) AS closed FROM f WHERE used GROUP BY ALL),
o AS (SELECT f.*, opens AND sum(CAST(opens AS INTEGER)) OVER w <= coalesce(closed, 0) AS begins FROM f LEFT JOIN c USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
q AS (SELECT *, coalesce(lag(begins) OVER (PARTITION BY user_id ORDER BY pos), false) AS quoted FROM o),
x AS (SELECT user_id, pos, kind, CASE WHEN quoted THEN '«' || text || '»' WHEN used AND kind = 'margin' THEN CAST(pos AS VARCHAR) WHEN kind = 'margin' AND NOT shuts THEN CAST(pos AS VARCHAR) ELSE text END AS text, 0 AS part FROM q WHERE NOT begins AND NOT (used AND kind = 'sigla')
  UNION ALL SELECT user_id, pos, CASE WHEN shuts THEN 'sigla' ELSE 'grk' END, CASE WHEN shuts THEN '|' ELSE '«q»' END, 1 FROM q WHERE kind = 'margin' AND (used OR NOT shuts))
SELECT user_id, pos, CAST(part AS INTEGER) AS part, kind, text FROM x""")
def c27_quotes(spark, d):
    number, even = F.col("event_id").cast("string"), F.col("event_id") % 2 == 0
    kind = by_type(signup=F.lit("sigla"), error=F.lit("margin"), purchase=F.when(even, "margin").otherwise("sigla"), rest=F.lit("grk"))
    text = by_type(signup=F.lit("»"), error=F.concat(number, F.lit(" « q »")), purchase=F.when(even, F.concat(F.lit("« "), number, F.lit(" |"))).otherwise("«"), rest=F.concat(F.lit("g"), number))
    return columns.quotations(pieces_of(d, spark, kind=kind, text=text), "user_id", "at").withColumnRenamed("at", "pos")


@query("w9_panel", rf"""
WITH s AS (SELECT user_id, event_id AS pos, value AS x, event_type IN ('click', 'view') AS grk, CASE event_type WHEN 'click' THEN 'w' || event_id WHEN 'view' THEN 'v' || event_id || chr(10) || 'u' WHEN 'signup' THEN event_id % 7 || ' (vgl. V. ' || event_id || '!)'
  WHEN 'error' THEN '––– ' || event_id || CASE WHEN event_id % 3 = 0 THEN ' –––' ELSE '' END ELSE CAST(event_id AS VARCHAR) END AS text, CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END AS mark, event_type AS t FROM events),
r AS (SELECT *, CASE WHEN t = 'error' THEN CASE WHEN pos % 3 = 0 THEN 2 ELSE 1 END ELSE 0 END AS rules, NOT grk AND mark IS NULL AS other FROM s),
a AS (SELECT *, coalesce(sum(CAST(rules = 2 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM r),
b AS (SELECT *, coalesce(sum(CAST(rules = 1 AS INTEGER)) OVER (PARTITION BY user_id, island ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS opened FROM a),
c AS (SELECT *, other AND (opened OR rules > 0) AS ruled, other AND ((opened AND rules > 0) OR rules = 2) AS closes FROM b),
d AS (SELECT *, CASE WHEN other AND NOT ruled THEN CASE WHEN t = 'signup' AND pos % 7 BETWEEN 2 AND 5 THEN pos % 7 WHEN t = 'signup' AND x < 460 THEN pos % 7 WHEN t = 'purchase' AND (pos BETWEEN 2 AND 5 OR x < 460) THEN pos END END AS number,
  sum(CAST(ruled AND NOT opened AS INTEGER)) OVER (PARTITION BY user_id ORDER BY pos) AS nth FROM c),
e AS (SELECT *, 0 AS k, CASE WHEN t = 'view' THEN 'v' || pos WHEN grk THEN text ELSE '' END AS piece, closes OR number IS NOT NULL AS starts FROM d UNION ALL SELECT *, 1, 'u', true FROM d WHERE t = 'view'),
f AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER w AS clause, last_value(number IGNORE NULLS) OVER w AS verse FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT *, coalesce(bool_or(piece <> '') OVER (PARTITION BY user_id, clause ORDER BY pos, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS begun FROM f),
h AS (SELECT user_id, clause, 'clause' AS what, min(verse) AS verse, arg_min(x, pos) FILTER (WHERE k = 0) AS y, string_agg(piece, ' ' ORDER BY pos, k) AS text, 0 AS off FROM g WHERE piece <> '' AND verse IS NOT NULL GROUP BY ALL),
i AS (SELECT user_id, max(clause), 'order', NULL, NULL, string_agg(text, '' ORDER BY pos), -1 FROM g WHERE ruled GROUP BY user_id, nth HAVING bool_or(closes)),
l AS (SELECT * FROM h UNION ALL SELECT * FROM i UNION ALL SELECT user_id, clause, 'mark', NULL, NULL, mark, CASE WHEN begun THEN 0 ELSE -1 END FROM g WHERE mark IS NOT NULL
  UNION ALL SELECT user_id, clause, 'app', NULL, NULL, 'vgl. V. ' || pos || '!', 0 FROM g WHERE t = 'signup' AND NOT ruled)
SELECT user_id, CAST(coalesce(sum(CASE WHEN what = 'clause' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY clause RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + off AS INTEGER) AS place, what, CAST(verse AS BIGINT) AS verse, y, text FROM l""")
def w9_panel(spark, d):
    """A panel whose numbers are 2 to 5; a span's value stands for both its places on the page."""
    number = F.col("event_id").cast("string")
    rule = F.concat(F.lit("––– "), number, F.when(F.col("event_id") % 3 == 0, " –––").otherwise(""))
    pointer = F.concat((F.col("event_id") % 7).cast("string"), F.lit(" (vgl. V. "), number, F.lit("!)"))
    text = by_type(click=F.concat(F.lit("w"), number), view=F.concat(F.lit("v"), number, F.lit("\nu")), signup=pointer, error=rule, rest=number)
    mark = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 2 == 0), number)
    spans = pieces_of(d, spark, x=F.col("value"), y=F.col("value"), kind=F.when(F.col("event_type").isin("click", "view"), "GRK").otherwise("APP"), text=text, mark=mark)
    return columns.panel(spans, "user_id", "at", F.lit(2), F.lit(5), lambda c: c)
