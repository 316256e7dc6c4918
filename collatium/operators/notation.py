"""A stateful notation parser: two editions of one text, printed as one line of marked words.

Marks: [ ] hold what only edition A has, { } what only edition B has; < > hold a place where both differ, A's words
before the bar and B's after it; ( ) hold apparatus, which neither has. Plus marks are flags, not depths: a second [
changes nothing. Variant depth is a counter that never falls below 0. A place left open goes on in the next clause of
its page only if that clause has the bar; the bar itself is never carried. Apparatus ends with its line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = "[]{}<>|()"
SEGMENT = "page long, clause_ord int, seg_ord int, cls string, text string, notation int"
#: Classes that each edition has.
KEEP = {"a": ("common", "plus", "mtvar"), "b": ("common", "minus", "ogvar")}


@dataclass
class Carry:
    depth: int = 0
    notation: int = 0


def has_bar(lines: list[str]) -> bool:
    return any("|" in line for line in lines)


def parse_clause(lines: list[str], carry: Carry) -> tuple[list[tuple[str, str, int]], Carry]:
    """Segments (class, text, notation) of a clause, and the state it leaves."""
    only_a = only_b = bar = False
    depth, notation = carry.depth, carry.notation
    out: list[list] = []

    def add(text: str) -> None:
        if not text:
            return
        if depth:
            cls = "ogvar" if bar else "mtvar"
        elif only_a != only_b:
            cls = "plus" if only_a else "minus"
        else:
            cls = "common"
        at = notation if depth else 0
        if out and out[-1][0] == cls and out[-1][2] == at:
            out[-1][1] += text
        else:
            out.append([cls, text, at])

    for line in lines:
        apparatus, start = 0, 0
        for i, c in enumerate(line):
            if c not in MARKS:
                continue
            if not apparatus:
                add(line[start:i])
            start = i + 1
            if c == "(":
                apparatus += 1
            elif c == ")":
                apparatus = max(0, apparatus - 1)
            elif apparatus:
                pass
            elif c in "[]":
                only_a = c == "["
            elif c in "{}":
                only_b = c == "{"
            elif c == "<":
                if not depth:
                    notation, bar = notation + 1, False
                depth += 1
            elif c == ">":
                depth = max(0, depth - 1)
                bar = bar and depth > 0
            elif c == "|":
                bar = depth > 0
        if not apparatus:
            add(line[start:])
        add(" ")
    return resolved(out), Carry(depth, notation)


def resolved(segments: list[list]) -> list[tuple[str, str, int]]:
    """A place without a bar is common text: nothing answers it."""
    answered = {n for cls, _, n in segments if cls == "ogvar"}
    out: list[list] = []
    for cls, text, n in segments:
        if cls == "mtvar" and n not in answered:
            cls, n = "common", 0
        if out and (out[-1][0], out[-1][2]) == (cls, n):
            out[-1][1] += text
        else:
            out.append([cls, text, n])
    clean = [(cls, " ".join(text.split()), n) for cls, text, n in out]
    return [s for s in clean if s[1]]


def parse_page(clauses: list[list[str]]) -> Iterator[tuple[int, int, str, str, int]]:
    carry = Carry()
    for k, lines in enumerate(clauses):
        segments, left = parse_clause(lines, carry)
        goes_on = k + 1 < len(clauses) and left.depth > 0 and has_bar(clauses[k + 1])
        carry = Carry(left.depth if goes_on else 0, left.notation)
        for j, (cls, text, n) in enumerate(segments):
            yield k, j, cls, text, n


def parse(lines: DataFrame) -> DataFrame:
    """lines (page, clause_ord, line_ord, text) as segments. A page is the unit: all state stays within it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["clause_ord", "line_ord"], kind="stable")
        groups = [(int(k), g["text"].fillna("").tolist()) for k, g in pdf.groupby("clause_ord", sort=True)]
        page = pdf["page"].iloc[0]
        rows = [(page, groups[k][0], j, cls, text, n) for k, j, cls, text, n in parse_page([g for _, g in groups])]
        return pd.DataFrame(rows, columns=["page", "clause_ord", "seg_ord", "cls", "text", "notation"])

    return lines.groupBy("page").applyInPandas(run, SEGMENT)


def edition(segments: DataFrame, which: str) -> DataFrame:
    """(page, clause_ord, text): the running text of edition a or b."""
    kept = segments.filter(F.col("cls").isin(*KEEP[which]))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", "text"))), lambda s: s["text"]), " ")
    return kept.groupBy("page", "clause_ord").agg(text.alias("text"))


def marked(text: Column, ord_: Column) -> Column:
    """Notation put into plain text by a rule, for whole-table runs: words of certain endings become marks."""
    out = F.regexp_replace(F.regexp_replace(text, r"[\[\]{}<>|()]", ""), r"\b(\p{L}+(?:tion|ment|heit|ción))\b", "<$1|x>")
    out = F.regexp_replace(F.regexp_replace(out, r"\b(the|der|la)\b", "[$1]"), r"\b(of|und|de)\b", "{$1}")
    return F.when(ord_ % 4 == 1, F.concat(out, F.lit(" <open"))).when(ord_ % 4 == 2, F.concat(F.lit("end|other> "), out)).otherwise(out)
