"""Margin lines, quotations and a translation's panel, by hand."""

import random

from pyspark.sql import functions as F

from collatium.operators import columns

SPAN = "page int, at int, x double, y double, kind string, text string, mark string"


def margin(spark, pieces):
    df = spark.createDataFrame([(1, i, *p) for i, p in enumerate(pieces)], "page int, at int, line int, y double, x double, size double, kind string, text string")
    return [(r.line, r.text) for r in columns.margin_lines(df, "page").orderBy("line").collect()]


def test_a_margin_line_is_read_from_left_to_right(spark):
    got = margin(spark, [(2, 80.0, 55.0, 10.0, "APP", "; 46,25b"), (2, 80.0, 30.0, 10.0, "APP", "25,3a"), (1, 92.0, 30.0, 10.0, "APP", "→ "), (1, 92.0, 38.0, 10.0, "APP", "1a ("), (3, 78.0, 51.0, 6.0, "APP", "1")])
    assert got == [(1, "→ 1a"), (2, "25,3a₁; 46,25b")]


def test_script_gap_and_raised_digits_in_a_margin_line(spark):
    assert margin(spark, [(1, 9.0, 30.0, 10.0, "HEB", "g"), (1, 9.0, 36.0, 10.0, "HEB", "b"), (1, 9.0, 42.0, 10.0, "APP", "vgl."), (1, 11.0, 58.0, 6.0, "APP", " 2 "), (1, 9.0, 62.0, 10.0, "APP", "x"), (1, 9.0, 80.0, 10.0, "GRK", "logoj")]) == [(1, "בג vgl.²x λογος")]
    # a raised piece far from any line, one without a full piece at all, and nothing but blanks
    assert margin(spark, [(1, 9.0, 30.0, 10.0, "APP", " "), (2, 40.0, 30.0, 6.0, "APP", "3")]) == [(2, "3")]
    assert margin(spark, []) == []


def quoted(spark, notes):
    df = spark.createDataFrame([(1, i, *n) for i, n in enumerate(notes)], "page int, at int, kind string, text string")
    return [(r.kind, r.text) for r in columns.quotations(df, "page", "at").orderBy("at", "part").collect()]


def test_quotations(spark):
    assert quoted(spark, [("sigla", "»"), ("grk", " a "), ("sigla", "«")]) == [("grk", "«a»")]
    assert quoted(spark, [("sigla", "»"), ("grk", "a"), ("app", "n"), ("margin", "36,30c «")]) == [("grk", "«a»"), ("app", "n"), ("margin", "36,30c")]
    assert quoted(spark, [("sigla", "»"), ("grk", "a"), ("margin", "« 4,2d |")]) == [("grk", "«a»"), ("margin", "4,2d"), ("sigla", "|")]
    assert quoted(spark, [("sigla", "»"), ("app", "a"), ("sigla", "«")]) == [("sigla", "»"), ("app", "a"), ("sigla", "«")]
    assert quoted(spark, [("sigla", "«"), ("sigla", "»"), ("grk", "a")]) == [("sigla", "«"), ("sigla", "»"), ("grk", "a")]
    assert quoted(spark, [("sigla", "»"), ("grk", "a"), ("sigla", "»"), ("grk", "b"), ("sigla", "«")]) == [("grk", "«a»"), ("sigla", "»"), ("grk", "b")]
    assert quoted(spark, [("margin", "21,12c « auton »"), ("margin", "«b»"), ("app", "« c »")]) == [("margin", "21,12c"), ("grk", "«auton»"), ("grk", "«b»"), ("app", "« c »")]
    assert quoted(spark, []) == []


def paneled(spark, spans, convert=lambda c: c):
    df = spark.createDataFrame([(1, i, s[0], float(i), s[1], s[2], s[3] if len(s) > 3 else None) for i, s in enumerate(spans)], SPAN)
    rows = columns.panel(df, "page", "at", F.lit(5), F.lit(9), convert).collect()
    return sorted((r.place, r.what, r.verse, r.y, r.text) for r in rows if r.what == "clause"), sorted((r.what, r.text, r.place) for r in rows if r.what != "clause")


def test_a_panel_of_clauses(spark):
    g, n = "GRK", "APP"
    clauses, notes = paneled(spark, [(500.0, g, "lost"), (451.0, n, "5"), (500.0, g, "a"), (510.0, g, "b\nc"), (505.0, n, "17", "17"), (451.0, n, " 33 "), (500.0, g, " d"), (800.0, n, "77"), (500.0, g, "e")])
    assert clauses == [(0, "clause", 5, 2.0, "a b"), (1, "clause", 5, None, "c"), (2, "clause", 33, 6.0, " d e")]
    assert notes == [("mark", "17", 1)]
    clauses, notes = paneled(spark, [(451.0, n, "6"), (500.0, g, "a"), (500.0, n, "––– hier 7–8 in "), (500.0, n, "AlT"), (500.0, n, " –––"), (500.0, g, "b"), (451.0, n, "9 (vgl. V. 5!)"), (500.0, g, "logoj"), (500.0, n, "––– 8 –––"), (500.0, n, "8", "8"), (500.0, g, "––– no"), (500.0, n, "––– 7")], columns.scripts.to_greek)
    assert [(c[0], c[2], c[4]) for c in clauses] == [(0, 6, "α"), (1, 6, "β"), (2, 9, "λογος"), (3, 9, "νο")]
    assert notes == [("app", "vgl. V. 5!", 2), ("mark", "8", 2), ("order", "––– 8 –––", 2), ("order", "––– hier 7–8 in AlT –––", 0)]
    assert paneled(spark, []) == ([], [])


def test_panels_and_quotations_equal_a_walk(spark):
    """Random rows against a state held row by row."""
    rng = random.Random(5)
    spans = [(p, i, 451.0, float(i), k, t, "m" if k == "APP" and t == "7" and rng.random() < 0.3 else None) for p in range(60) for i in range(25) for k, t in [rng.choice([("GRK", "a"), ("GRK", " b\nc "), ("GRK", "\n"), ("APP", "7"), ("APP", "–––"), ("APP", "––– 8 –––"), ("APP", "\n")])]]
    want = []
    for p in range(60):
        verse, buf, rule, place = None, "", "", 0
        for _, _, _, _, k, t, mark in (s for s in spans if s[0] == p):
            feed, ends = [], False
            if k == "GRK":
                feed = t.split("\n")
                buf += " " * bool(buf and feed[0] and not buf[-1].isspace() and not feed[0][0].isspace()) + feed.pop(0)
            elif mark:
                want.append((p, "mark", mark, place - (not buf.strip())))
            elif rule or "–––" in t:
                rule += t
                ends = rule.count("–––") > 1
            else:
                ends = True
            for new in feed if k == "GRK" else [""] * ends:
                if buf.strip() and verse is not None:
                    want.append((p, str(verse), buf, place))
                    place += 1
                buf = new
            if ends and rule:
                want.append((p, "order", " ".join(rule.split()), place - 1))
                rule = ""
            elif ends and t == "7":
                verse = 7
        if buf.strip() and verse is not None:
            want.append((p, str(verse), buf, place))
    df = spark.createDataFrame(spans, SPAN)
    got = columns.panel(df, "page", "at", F.lit(5), F.lit(9), lambda c: c).collect()
    assert sorted((r.page, str(r.verse) if r.what == "clause" else r.what, r.text, r.place) for r in got) == sorted(want)
    notes = [(p, i, *rng.choice([("sigla", "»"), ("grk", "g"), ("margin", "x «"), ("sigla", "«"), ("app", "n")])) for p in range(60) for i in range(25)]
    want = []
    for p in range(60):
        here, waiting, out = [n[2:] for n in notes if n[0] == p], [], {}
        for i, (k, t) in enumerate(here):
            out[i] = (k, t)
            if t == "»" and i + 1 < len(here) and here[i + 1][0] == "grk":
                waiting.append(i)
            elif "«" in t and waiting:
                at = waiting.pop(0)
                out[at], out[at + 1] = None, ("grk", "«g»")
                out[i] = ("margin", "x") if k == "margin" else None
        want += [(p, *n) for _, n in sorted(out.items()) if n]
    got = columns.quotations(spark.createDataFrame(notes, "page int, at int, kind string, text string"), "page", "at").orderBy("page", "at", "part").collect()
    assert [(r.page, r.kind, r.text) for r in got] == want
