"""The two scripts, words cut by an edition's signs, columns and notes, by hand; plans that must not pair rows."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from collatium.functions import folds, scripts
from collatium.operators import joins, order


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_hebrew_of_the_font(spark):
    got = column(spark, ["gb", "b;g", "~yhla", "Vv", "a'b' *#g", " gb  d", "`a-b", None, "", ";'"], scripts.to_hebrew)
    shin = "\u05e9\u05c1"
    assert got == ["בג", "גבַ", "אלהים", shin + shin + "\u05bc", "ג" + "ץ" + " בָאָ", "ד בג", "ב\u05beא\u05c3", None, "", ""]


@pytest.mark.parametrize(("font", "text"), [("logoj", "λογος"), ("lo,goj", "λόγος"), ("VIerousalhm", "Ἰερουσαλημ"), ("evpV", "ἐπ᾿"), ("w-n", "ὧν"), ("HME ,RAIS", "ΗΜΈ ΡΑΙΣ"), ("+Apij", "Ἆπις"), ("boi<dia 3;", "βοϊδια 3;"), ("*lo#goj", "λογος"), ("", "")])
def test_greek_of_the_font(font, text):
    assert scripts.greek(font) == unicodedata.normalize("NFC", text)


def test_edges_and_open_heads(spark):
    # visual order: the first sign is the last letter
    assert column(spark, ["b'a;", "-a", "H'b", "x;b", "~b", "b", "l'b", "lb"], lambda v: scripts.open_head(scripts.to_hebrew(v))) == [True, False, False, False, False, True, True, False]
    assert column(spark, ["ab;g.", "", ";"], scripts.first_unit) == ["ג\u05b0", "", ""]
    assert column(spark, ["ab;g.", "a", "x"], scripts.without_first) == ["ab;", "", ""]


def test_completions(spark):
    rows = [("t'a", "~klt'a"), ("t.a", "~kt.a"), ("lb", "~klta"), ("~klta", "wb"), ("~klta", "w.")]
    got = spark.createDataFrame(rows, "mt string, og string").select(scripts.supplied(F.col("mt"), F.col("og")).alias("s"), scripts.tail_only(F.col("mt"), F.col("og")).alias("t")).collect()
    assert [r.s for r in got] == ["~klt'", "~k", None, None, None] and [r.t for r in got] == [False, False, False, True, False]


def test_lone_prefixes(spark):
    df = spark.createDataFrame([("ו אבג ב ל דהו", False), ("ו אבג", True), ("מה אבג", False), ("אבג ו", False), ("", False)], "t string, j boolean")
    assert [r.x for r in df.select(scripts.bound(F.split("t", " "), F.col("j")).alias("x")).collect()] == ["ואבג בלדהו", "ו אבג", "מה אבג", "אבג ו", ""]
    assert column(spark, ["אבג ול", "אבג וללה", "אבג דו", "ו", ""], scripts.bound_fragment) == [True, False, False, True, False]


def test_rule_lines_become_one_note(spark):
    rows = [(1, 0, "sigla", "9a –––"), (1, 1, "app", " = 4Q "), (1, 2, "sigla", "hier"), (1, 3, "sigla", "––– x"), (1, 4, "margin", "––– y –––"), (2, 0, "sigla", "a –––"), (2, 1, "id", "b"), (2, 2, "sigla", "c"), (3, 0, "app", "d")]
    got = order.collapsed(spark.createDataFrame(rows, "page int, ord int, kind string, text string"), "page", "ord", "–––").orderBy("page", "ord").collect()
    assert [tuple(r) for r in got] == [(1, 0, "order", "––– x hier (= 4Q) 9a –––"), (1, 4, "order", "––– y –––"), (2, 0, "sigla", "a –––"), (2, 1, "id", "b"), (2, 2, "sigla", "c"), (3, 0, "app", "d")]


def test_seams_of_a_column(spark):
    # visual order: what follows in reading stands to the left of a text's end
    rows = [(1, 0, "common", "w"), (1, 1, "plus", "xx"), (1, 2, "common", "abg "), (2, 0, "common", "abg"), (2, 1, "plus", "d d"), (2, 2, "common", "zxj"), (3, 0, "common", "abg"), (3, 1, "plus", "d"), (3, 2, "common", "zxj-"), (4, 0, "common", "abg"), (4, 1, "ogvar", "d"), (4, 2, "common", "zxj-")]
    got = order.projected(spark.createDataFrame(rows, "v int, ord int, cls string, text string"), "v", "ord", ["common"], ["ogvar"]).orderBy("v", "ord").collect()
    assert [r.text for r in got] == ["w", "abg", "abg", "zxj ", "abg", "zxj ", "abg", "zxj-"]


def test_nearest_and_highest_above_by_brute_force(spark):
    import random

    rng = random.Random(4)
    left = [(i, rng.choice(["a", "b"]), rng.choice([float(rng.randrange(0, 60)), None, 7.0])) for i in range(300)]
    right = [(100 + i, rng.choice(["a", "b"]), rng.uniform(0, 60) if i % 3 else float(rng.randrange(0, 60))) for i in range(40)]
    ldf, rdf = spark.createDataFrame(left + left[:3], "i int, g string, x double"), spark.createDataFrame(right, "k int, h string, y double")
    for bound in (0.5, 3, 100):
        want = sorted((i, min(((abs(y - x), k) for k, _, y in right if abs(y - x) <= bound), default=(0, -1))[1] if x is not None else -1) for i, _, x in left + left[:3])
        assert sorted((r.i, -1 if r.k is None else r.k) for r in joins.nearest(ldf, rdf, "x", "y", "k", bound).collect()) == want
    some = ldf.filter("x is not null")
    got = joins.highest_above(some, rdf.withColumnRenamed("h", "g"), ["g"], "x", "y", "k", "top").collect()
    above = {(i, g, x): max([k for k, h, y in right if h == g and y > x], default=min(k for k, h, _ in right if h == g)) for i, g, x in left if x is not None}
    assert len(got) == some.count() and all(r.top == above[r.i, r.g, r.x] for r in got)


def test_containment_and_places(spark):
    df = spark.createDataFrame([("abc", "xabcx"), ("xabcx", "abc"), ("abc", "abcabcabc"), ("", "a"), (None, "a"), ("abc", "abd")], "a string, b string")
    assert [r.x for r in df.select(folds.mostly(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, False, False, False, False]
    assert column(spark, ["ab", "xyz", "ooo", "nnn", "ppp", "qqq"], lambda v: folds.located(v, F.lit("mmmxyz"), F.lit("oooxyz"), F.array(F.lit("nnnn")), F.lit("pppp"))) == ["short", "misordered", "alexandrian", "margin", "parsed", "lost"]


def test_places_over_all_rows(spark):
    df = spark.range(1000).select((F.xxhash64("id") % 1000).alias("a"), "id").repartition(7)
    got = order.placed(df, ["a", "id"]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 1001)) and [(r.a, r.id) for r in got] == sorted((r.a, r.id) for r in got)


def spellings(spark, name, sf="/root/testdata/sf0.001"):
    """How often the optimized plan of a query spells out visual text."""
    from collatium.plans import catalog

    return catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("reverse(regexp_extract_all(")


def test_completion_spells_a_word_once(spark):
    """Both words of a pair, and a tail's first letter; and what the columns made for it give is what the functions give."""
    assert spellings(spark, "c13_completion") <= 4
    rows = [("t'a", "~klt'a"), ("t.a", "~kt.a"), ("lb", "~klta"), ("~klta", "wb"), ("~klta", "w."), (".a", "b.a"), ("b>", "~klt>b"), ("", "a"), ("-a", "ab"), ("x;b", "abg"), (None, "ab")]
    df = spark.createDataFrame(rows, "mt string, og string")
    want = df.select("mt", "og", scripts.supplied(F.col("mt"), F.col("og")).alias("s"))
    assert sorted(map(str, scripts.spelled(df).select("mt", "og", scripts.supplied_of().alias("s")).collect())) == sorted(map(str, want.collect()))


def test_abbreviated_side_spells_a_word_once(spark):
    assert spellings(spark, "c14_abbreviated_side") <= 4
    rows = [("~klta", "wb"), ("~klta", "w."), ("t'a", "~klt'a"), ("", "a"), ("-a", "ab"), ("abg", "a>"), ("abg", "a"), ("abg", "-ab"), (None, "ab")]
    df = spark.createDataFrame(rows, "mt string, og string")
    want = df.select("mt", "og", (scripts.supplied(F.col("mt"), F.col("og")).isNull() & scripts.tail_only(F.col("mt"), F.col("og"))).alias("t"))
    assert sorted(map(str, scripts.spelled(df).select("mt", "og", (scripts.supplied_of().isNull() & scripts.tail_only_of()).alias("t")).collect())) == sorted(map(str, want.collect()))


def test_greek_word_by_word_is_greek_piece_by_piece(monkeypatch):
    """Random signs of the font, blanks and strangers; and a word is spelled out once, however often it comes."""
    import random

    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("abgLJVv+`;,.-'|<? \t\n  ()1:!–é/=~[]\\ἀ̓᾿") for _ in range(rng.randrange(0, 16)))
        known = scripts._UNKNOWN.sub("", text)
        assert scripts.greek(text) == scripts._greek_word(known, "")[0]
    calls = []
    plain = scripts._plain_word
    monkeypatch.setattr(scripts, "_plain_word", lambda w: calls.append(w) or plain(w))
    scripts._WORDS.clear()
    assert scripts.greek(("lo,goj kai, qeo.j " * 50).strip()) == " ".join(["λόγος καί θεὸς"] * 50) and len(calls) == 3


def against_sql(spark, tmp_path, name, texts, ids=None):
    """A query's rows over documents of odd texts, and its SQL's; and its optimized plan."""
    import duckdb

    from collatium.plans import catalog

    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(zip(ids or range(len(texts)), texts, strict=True)), "doc_id long, text string").selectExpr("*", "'en' as lang", "'a' as source", "1L as n_chars").coalesce(1).write.parquet(path)
    df = catalog.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    sql = con.execute(catalog.oracle_sql()[name])
    at = [d[0] for d in sql.description]
    return sorted(repr(list(r)) for r in df.select(*at).collect()), sorted(repr(list(r)) for r in sql.fetchall()), df._jdf.queryExecution().optimizedPlan().toString()


def odd_texts(n=400):
    import random

    rng = random.Random(9)
    signs = "abgwl--``';,.e \n\tXV~"
    return [None, "", ". ", "-. -. a", "a. `. `b. -c", "w. a b. l'. g"] + [". ".join("".join(rng.choice(signs) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 9))) for _ in range(n)]


def test_pieces_of_odd_segments(spark, tmp_path):
    """Binding signs and stops in a row, at ends and alone; segments are put in order, not their pieces."""
    got, want, plan = against_sql(spark, tmp_path, "c22_tokens_with_glue", odd_texts())
    assert len(got) > 1000 and got == want and plan.index("Generate") < plan.index("Window")


def test_printed_words_of_odd_segments(spark, tmp_path):
    got, want, plan = against_sql(spark, tmp_path, "c23_printed_words", odd_texts())
    assert len(got) > 1000 and got == want and "Window" not in plan


@pytest.mark.parametrize("ids", [None, [1, 1, 2, 3, None, None, 4, 5, 1]])
def test_pool_of_texts(spark, tmp_path, ids):
    """Pages of one row are numbered where they lie, and nothing is moved; rows with one id, or none, are one page."""
    texts = ["b a b c", "c d a", None, "", "x y x", "z y", "q r q", "é É e", "a b"]
    got, want, plan = against_sql(spark, tmp_path, "a15_dictionary_pool", texts, ids)
    assert got == want and plan.count("array_distinct") == 1 and (ids or not any(s in plan for s in ("Window", "Join", "Aggregate")))


def lone_texts(n=300):
    import random

    rng = random.Random(11)
    words = ["w", "'w", "b'", "l", "h", "ab", "~kl", "-", "w-", "g'", "x", "`", "e"]
    return [None, "", "w. ab", "w. w. w. ab. w"] + [". ".join(" ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 1, 2, 3, 5]))) for _ in range(rng.randrange(1, 12))) for _ in range(n)]


def test_lone_prefixes_in_one_order(spark, tmp_path):
    """Runs of lone prefixes over ends of segments; no text goes through the order, nor is it cut into words."""
    got, want, plan = against_sql(spark, tmp_path, "c19_bound_proclitics", lone_texts())
    assert len(got) > 1000 and got == want and "transform(" not in plan and plan.count("md5") == 2


def test_seams_spell_out_last_words_only(spark, tmp_path):
    got, want, plan = against_sql(spark, tmp_path, "f17_column_projection", lone_texts() + odd_texts())
    assert len(got) > 1000 and got == want and "collect_list" not in plan


def test_forms_of_repeated_ids_in_two_languages(spark, tmp_path):
    """Texts of one id are one page of forms, whatever their languages."""
    import duckdb

    from collatium.plans import catalog

    docs = [(1, "a b a", "en"), (1, "a c", "de"), (2, "b c", "de"), (3, "c d", None), (None, "d", "fr"), (4, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "c x")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    sql = con.execute(catalog.oracle_sql()["j13_two_tier_lookup"])
    at = [d[0] for d in sql.description]
    got = catalog.queries()["j13_two_tier_lookup"](spark, str(tmp_path)).select(*at).collect()
    assert sorted(repr(list(r)) for r in got) == sorted(repr(list(r)) for r in sql.fetchall())
