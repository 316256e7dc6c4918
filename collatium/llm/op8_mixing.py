"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic). Raking scales the cells' token weights to the target shares
of each margin in turn, until a whole round moves no margin by more than TOLERANCE of itself. Targets that contradict each
other or the empty cells may never get there: raking then ends after MOST rounds with the margin raked last met. A document's inclusion probability is its cell's ratio of weight
to tokens times one factor, cut at 1, with the factor set so that the expected tokens are ``keep`` of the whole. The
draw is a hash of the id, so it repeats exactly, and a repeated id is drawn alike.

Null source, language or topic is a value of its own ('?'); a null or wordless text has no tokens and is drawn with its cell.
Cells without tokens have probability 0. The topic is a rough genre by layout and length unless the caller names a better one. Targets not given are the margin's shares raised to a power below 1. An empty
table gives an empty result. Only aggregates of the cell table reach the driver, one row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatium.llm.common import HOT, cut, keyed_join, settle

MARGINS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
TOLERANCE, MOST, FACTORS, KEEP, SEED = 1e-4, 100, 6, 0.6, 17
WORD = "[^ \\t-\\r]+"


def topic(text: Column, words: Column) -> Column:
    """A rough genre by layout and length."""
    return (
        F.when(words == 0, "none").when(F.instr(text, " | ") > 0, "table").when(F.instr(text, "!!") > 0, "shout").when(words < 120, "brief").when(words < 1200, "prose").otherwise("long")
    )


def draw(key: Column, seed: int) -> Column:
    """A uniform number in [0, 1) from an id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("?")), F.lit(str(seed)))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def rake(cells: DataFrame, margins: dict[str, float], targets: dict[str, dict[str, float]] | None = None, tolerance: float = TOLERANCE, most: int = MOST) -> DataFrame:
    """cells (margins.., tokens) with weight: shares of the whole whose margins meet the targets as far as the cells allow.

    A margin's sums are windows over the cells, which are counted already; no join and no broadcast is repeated.
    """
    given = targets or {}
    over = {m: Window.partitionBy(m) for m in margins}
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m, power in margins.items():
        if m in given:
            table = F.create_map(*[F.lit(x) for k, v in given[m].items() for x in (k, float(v))])
            goal = F.coalesce(F.element_at(table, F.col(m)), F.lit(0.0)) / sum(given[m].values())
            now = now.withColumns({f"_goal_{m}": goal, f"_share_{m}": F.lit(0.0)})
        else:
            goal = F.pow(F.sum("tokens").over(over[m]).cast("double"), F.lit(power))
            now = now.withColumn(f"_goal_{m}", goal).withColumn(f"_share_{m}", F.col(f"_goal_{m}") / F.count("*").over(over[m]))
    now = settle(now)
    whole = now.agg(*[F.sum(f"_share_{m}").alias(m) for m in margins]).first()
    for m in margins:
        now = now.drop(f"_share_{m}") if m in given else now.withColumn(f"_goal_{m}", F.col(f"_goal_{m}") / (whole[m] or 1.0)).drop(f"_share_{m}")
    for _ in range(most):
        now = now.withColumn("_off", F.lit(0.0))
        for m in margins:
            now = now.withColumn("_s", F.sum("weight").over(over[m]))
            factor = F.when(F.col("_s") > 0, F.col(f"_goal_{m}") / F.col("_s"))
            off = F.greatest("_off", F.coalesce(F.abs(factor - 1), F.lit(0.0)))
            now = now.withColumns({"weight": F.coalesce(F.col("weight") * factor, F.lit(0.0)), "_off": off}).drop("_s")
        now = settle(now)
        if (now.agg(F.max("_off")).first()[0] or 0.0) <= tolerance:
            break
        now = now.drop("_off")
    return now.drop("_off", *[f"_goal_{m}" for m in margins])


def probabilities(cells: DataFrame, keep: float, factors: int = FACTORS) -> DataFrame:
    """cells (tokens, weight) with prob: min(1, c * weight / tokens), c fitted so that ``keep`` of the tokens is expected."""
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    cells = settle(cells.withColumn("ratio", ratio))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    c = 0.0
    for _ in range(factors):
        full, part = cells.agg(F.sum(F.when(F.col("ratio") * c >= 1, F.col("tokens")).otherwise(0)), F.sum(F.when(F.col("ratio") * c < 1, F.col("weight")).otherwise(0.0))).first()
        if not part or part <= 0:
            break
        c = max(c, (keep * total - full) / part)
    return cells.withColumn("prob", F.least(F.lit(1.0), F.col("ratio") * c)).drop("ratio")


def described(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", topic_of=topic) -> DataFrame:
    """docs with tokens, source, lang and topic. topic_of: a function of the columns text and words."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    named = docs.withColumns({"tokens": words, "source": F.coalesce(F.col(source), F.lit("?")), "lang": F.coalesce(F.col(lang), F.lit("?"))})
    return named.withColumn("topic", F.coalesce(topic_of(F.coalesce(F.col(text), F.lit("")), F.col("tokens")), F.lit("?")))


CELL = ["source", "lang", "topic"]


def cell_probabilities(marks: DataFrame, keep: float, targets: dict[str, dict[str, float]] | None, tolerance: float) -> tuple[DataFrame, int]:
    """(source, lang, topic, n, prob) of the cells of marks (source, lang, topic, tokens), and the number of rows."""
    cells = settle(marks.groupBy(*CELL).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
    prob = cut(probabilities(rake(cells, MARGINS, targets, tolerance), keep).select(*CELL, "n", "prob"))
    return prob, prob.agg(F.sum("n")).first()[0] or 0


def mix(docs: DataFrame, key: str = "doc_id", keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None, seed: int = SEED, tolerance: float = TOLERANCE, topic_of=topic) -> DataFrame:
    """(key, source, lang, topic, tokens, prob, selected) for every row of ``docs`` (key, text, source, lang)."""
    rows = cut(described(docs.select(key, "text", "source", "lang"), topic_of=topic_of).select(key, *CELL, "tokens"))
    prob, total = cell_probabilities(rows, keep, targets, tolerance)
    return keyed_join(rows, prob, CELL, "n", total).withColumn("selected", draw(F.col(key), seed) < F.col("prob")).select(key, *CELL, "tokens", F.round("prob", 6).alias("prob"), "selected")


def sampled(docs: DataFrame, key: str = "doc_id", keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None, seed: int = SEED, tolerance: float = TOLERANCE, topic_of=topic) -> DataFrame:
    """The rows of ``docs`` that are drawn, with its columns. Texts in cells that hold more than one in 4096 rows stay where they are."""
    names = {"source": "_source", "lang": "_lang", "topic": "_topic"}
    prob, total = cell_probabilities(described(docs.select("text", "source", "lang"), topic_of=topic_of).select(*CELL, "tokens"), keep, targets, tolerance)
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.withColumns({"_source": F.coalesce("source", F.lit("?")), "_lang": F.coalesce("lang", F.lit("?")), "_topic": F.coalesce(topic_of(F.coalesce("text", F.lit("")), words), F.lit("?"))})
    prob, on = prob.withColumnsRenamed(names | {"prob": "_prob", "n": "_n"}), list(names.values())
    # a table of few cells goes to the rows as a whole: texts are read once
    drawn = rows.join(F.broadcast(prob.drop("_n")), on) if prob.count() <= HOT else keyed_join(rows, prob, on, "_n", total)
    return drawn.filter(draw(F.col(key), seed) < F.col("_prob")).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(factors: int = FACTORS, keep: float = KEEP, seed: int = SEED) -> str:
    """DuckDB SQL: raking as a recursive table that ends by the same rule."""
    goals = "".join(f", g_{m} AS (SELECT {m}, g / sum(g) OVER () AS goal_{m} FROM (SELECT {m}, pow(sum(tokens), {power}) AS g FROM k GROUP BY {m}))" for m, power in MARGINS.items())
    inner = "SELECT *, 0.0::DOUBLE AS off FROM rk WHERE err > " + str(TOLERANCE) + f" AND round < {MOST}"
    for m in MARGINS:
        summed = f"SELECT *, sum(weight) OVER (PARTITION BY {m}) AS s FROM ({inner})"
        inner = f"SELECT * EXCLUDE (s) REPLACE (CASE WHEN s > 0 THEN weight * (goal_{m} / s) ELSE 0 END AS weight, CASE WHEN s > 0 THEN greatest(off, abs(goal_{m} / s - 1)) ELSE off END AS off) FROM ({summed})"
    names = f"source, lang, topic, tokens, weight, {', '.join('goal_' + m for m in MARGINS)}"
    ctes = [
        f"""d AS (SELECT doc_id, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang, coalesce(text, '') AS text,
  CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS tokens FROM documents)""",
        """r AS (SELECT doc_id, source, lang, tokens, CASE WHEN tokens = 0 THEN 'none' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'shout'
  WHEN tokens < 120 THEN 'brief' WHEN tokens < 1200 THEN 'prose' ELSE 'long' END AS topic FROM d)""",
        "k AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM r GROUP BY ALL)" + goals,
        f"""rk AS (SELECT 0 AS round, {names.replace('weight', 'tokens AS weight')}, 1.0::DOUBLE AS err FROM k {' '.join(f'JOIN g_{m} USING ({m})' for m in MARGINS)}
  UNION ALL SELECT round + 1, {names}, max(off) OVER () FROM ({inner}))""",
        "q AS MATERIALIZED (SELECT source, lang, topic, tokens, weight, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS ratio FROM rk WHERE round = (SELECT max(round) FROM rk))",
        "c0 AS (SELECT 0.0::DOUBLE AS c)",
    ]
    for i in range(factors):
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT greatest(any_value(c), coalesce(({keep} * sum(tokens) - coalesce(sum(tokens) FILTER (WHERE ratio * c >= 1), 0)) / nullif(sum(weight) FILTER (WHERE ratio * c < 1), 0), 0)) AS c FROM q, c{i})")
    return f"""WITH RECURSIVE {', '.join(ctes)}
SELECT doc_id, source, lang, topic, r.tokens, round(least(1.0, ratio * c), 6) AS prob,
  CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), '?'), ':{seed}')), 1, 12) AS BIGINT) / 281474976710656.0 < least(1.0, ratio * c) AS selected
FROM r JOIN q USING (source, lang, topic), c{factors}"""
