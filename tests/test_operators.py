"""Operators on small fixtures by hand, and every registered query against its oracle."""

import difflib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from collatium.functions import arrow, folds
from collatium.operators import indexes, joins, notation, order
from collatium.plans import catalog
from collatium.sources import sinks, tables

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    r = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(row[names.index(c)]) for c in cols]) for row in r.fetchall())


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x in (y if isinstance(y, (list, set)) else [y]) else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_is_longest_and_skips_the_left_on_a_tie():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 12))] for _ in range(2))
        pairs = arrow.lcs_pairs(a, b)
        assert len(pairs) == lcs_length(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs) == len({i for i, _ in pairs})
    assert arrow.lcs_pairs(["a", "b"], ["b", "a"]) == [(1, 0)]
    assert arrow.lcs_pairs(["x", "b"], [["y", "x"], ["b"]]) == [(0, 0), (1, 1)]


def test_diff_runs_rebuild_the_text():
    rng = random.Random(3)
    for _ in range(100):
        want = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 30)))
        got = "".join(c for c in want if rng.random() > 0.2)
        runs = arrow.diff_runs(want, got)
        assert sum(len(w) - len(g) for _, _, w, g in runs) == len(want) - len(got)
        assert bool(runs) == (want != got)
    assert arrow.diff_runs("abxcd", "abcd") == [("delete", 2, "x", "")]
    assert difflib.SequenceMatcher(None, "ab", "ab", autojunk=False).ratio() == 1


def test_rejoining_is_greedy_and_needs_an_unknown_part():
    known = {"river", "riverbank", "bank", "stone"}
    assert arrow.rejoined(["riv", "er", "bank"], known) == ["riverbank"]
    assert arrow.rejoined(["river", "bank"], known) == ["river", "bank"]
    assert arrow.rejoined(["st", "one", "x"], known) == ["stone", "x"]


def test_transliterations():
    assert arrow.lcs_pairs(["", "a"], ["", "a"]) == [(1, 1)]


def test_islands_keep_the_first_island_whole(spark):
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate([0, 0, 1, 0, 1, 1, 0])], "u int, i int, m int")
    ends = [r.island for r in order.islands(df, ["u"], ["i"], F.col("m") == 1).orderBy("i").collect()]
    assert ends == [0, 0, 0, 1, 1, 2, 3]
    starts = [r.island for r in order.islands(df, ["u"], ["i"], F.col("m") == 1, initiator=True).orderBy("i").collect()]
    assert starts == [0, 0, 1, 1, 2, 3, 3]
    runs = [r.run for r in order.runs_of_equal(df, ["u"], ["i"], F.col("m")).orderBy("i").collect()]
    assert runs == [0, 0, 1, 2, 3, 3, 4]


def test_folds_over_arrays(spark):
    row = spark.sql("SELECT 'a(b)c)' t, array(1, -1, -1, 1, 1) s, array('a','b','c') w, array('a','x','c','b') g, 'x [ab]' r").select(
        order.unopened(folds.chars(F.col("t")), "(", ")").alias("bad"), order.clamped_depth(F.col("s")).alias("d"), order.prefix_recall(F.col("w"), F.col("g")).alias("met"),
        order.reach_back(folds.chars(F.col("r")), "[", "]", 10).alias("reach"), order.reach_back(folds.chars(F.col("r")), "[", "]", 2).alias("short"),
    ).first()
    assert row.bad and (row.d.now, row.d.most) == (2, 2) and row.met == 2 and row.reach == 4 and row.short == 0


def test_recall_stops_at_what_is_never_met(spark):
    row = spark.sql("SELECT array('a','b','c','d') w, array('a','c','d') g").select(order.prefix_recall(F.col("w"), F.col("g")).alias("n")).first()
    assert row.n == 1  # not the length of a common subsequence


def test_nearest_takes_the_smaller_key_on_a_tie(spark):
    left = spark.createDataFrame([(1, 5.0), (2, 50.0), (3, 5.0)], "id int, x double")
    right = spark.createDataFrame([(10, 3.0), (11, 7.0), (12, 20.0)], "k int, y double")
    assert {r.id: r.k for r in joins.nearest(left, right, "x", "y", "k", 6).collect()} == {1: 10, 2: None, 3: 10}


def test_band_join_falls_back_to_the_highest_row_above(spark):
    left = spark.createDataFrame([(1, 0, 5.0), (2, 0, 9.0), (3, 1, 1.0)], "id int, p int, x double")
    right = spark.createDataFrame([(0, 7, 5.5), (0, 3, 9.4), (0, 4, 8.5)], "p int, row int, y double")
    got = {r.id: (r.row, r.inferred) for r in joins.banded(left, right, ["p"], "x", "y", "row", "id").collect()}
    assert got == {1: (7, False), 2: (3, True), 3: (None, True)}


def test_as_of_includes_equal_times(spark):
    left = spark.createDataFrame([(1, 0, 10), (2, 0, 4)], "id int, g int, t int")
    right = spark.createDataFrame([(0, 5, 1, 100), (0, 10, 2, 101), (0, 12, 3, 102)], "g int, t int, id int, v int")
    assert {r.id: r.v for r in joins.as_of(left, right, ["g"], "t", "v", "id").collect()} == {1: 101, 2: None}
    assert {r.id: r.v for r in joins.as_of(left, right, ["g"], "t", "v", "id", forward=True).collect()} == {1: 101, 2: 100}


def test_indexes(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "k string, s string")
    assert {(r.k, r.s, r.n) for r in indexes.unambiguous(df, "k", "s").collect()} == {("a", "x", 2)}
    assert [(r.k, r.s, r.n, r.purity, r.mixed) for r in indexes.votes(df, "k", "s", least=2).orderBy("k").collect()] == [("a", "x", 2, 1.0, False), ("b", "x", 2, 0.5, True)]
    assert {(r.k, r.s, r.n) for r in indexes.bag_difference(df, df.limit(1)).collect()} >= {("b", "x", 1), ("b", "y", 1)}


def segments(clauses):
    return [(cls, text) for _, _, cls, text, _ in notation.parse_page(clauses)]


def test_notation_of_one_clause():
    assert segments([["one [two] {three} four"]]) == [("common", "one"), ("plus", "two"), ("minus", "three"), ("common", "four")]
    assert segments([["a <b|c> d (note [x]) e"]]) == [("common", "a"), ("mtvar", "b"), ("ogvar", "c"), ("common", "d e")]
    assert segments([["a <b> c"]]) == [("common", "a b c")]  # no bar answers it
    assert segments([["a > b [c [d] e"]]) == [("common", "a b"), ("plus", "c d"), ("common", "e")]  # flags aren't depths
    assert segments([["a (b", "c d"]]) == [("common", "a c d")]  # apparatus ends with its line


def test_notation_is_carried_only_to_a_bar():
    assert segments([["a <b"], ["c|d> e"]]) == [("common", "a b"), ("mtvar", "c"), ("ogvar", "d"), ("common", "e")]
    assert segments([["a <b"], ["c d"]]) == [("common", "a b"), ("common", "c d")]


def test_editions(spark):
    lines = spark.createDataFrame([(1, 0, 0, "a <b|c> d [e] {f}"), (1, 1, 0, None), (2, 0, 0, "")], "page long, clause_ord int, line_ord int, text string")
    s = notation.parse(lines)
    assert [r.text for r in notation.edition(s, "a").collect()] == ["a b d e"] and [r.text for r in notation.edition(s, "b").collect()] == ["a c d f"]
    assert notation.parse(lines.limit(0)).count() == 0


def test_hebrew_and_greek_folds(spark):
    row = spark.sql("SELECT 'בְּרֵאשִׁ֖ית' h, 'Λόγος' g, 'a b c  word  x' u").select(folds.hebrew_skeleton(F.col("h")).alias("h"), folds.greek_norm(F.col("g")).alias("g"), folds.unspaced(F.col("u")).alias("u"), folds.plain(F.col("h")).alias("p")).first()
    assert (row.h, row.g, row.u) == ("בראשית", "λογοσ", "abc  word  x") and "֖" not in row.p


def test_sinks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "id int, name string")
    sinks.write_json(df, f"{tmp_path}/j")
    assert sorted(tables.json_rows(spark, f"{tmp_path}/j", "id int, name string").collect()) == sorted(df.collect())
    sinks.write_csv(df, f"{tmp_path}/c")
    raw = b"".join(p.read_bytes() for p in (tmp_path / "c").glob("part-*"))
    assert raw.startswith("﻿id,name".encode()) or raw.startswith('"﻿id"'.encode())
    html = sinks.documents(df.withColumn("g", F.lit("p")), ["g"], ["id"], F.coalesce("name", F.lit("-")), F.lit("T"))
    assert html.first().html == "<title>T</title>\né\n-"
    sinks.write_documents(html, f"{tmp_path}/h", "g")
    assert tables.whole_files(spark, f"{tmp_path}/h/g=p/*").count() == 1
    kept, out = sinks.routed(df, F.when(F.col("name").isNull(), "no name"))
    assert kept.count() == 1 and out.first().reject_reason == "no name"
    assert tables.optional(spark, f"{tmp_path}/none", "a int").count() == 0
    anchor = spark.sql("""SELECT '["mt",3]' a""").select(tables.mixed_anchor(F.col("a")).alias("x")).first().x
    assert (anchor.col, anchor.n) == ("mt", 3)
