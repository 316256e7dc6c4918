"""Normal forms of text as Column functions: equality in collation is equality after a fold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and their bases, accented Greek letters and theirs.
LATIN = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
GREEK = ("άὰᾶἀἁέὲἐἑήὴῆἠἡίὶῖἰἱϊόὸὀὁύὺῦὐὑϋώὼῶὠὡςϲ", "αααααεεεεηηηηηιιιιιιοοοουυυυυυωωωωωσσ")
HEBREW = "[^א-ת]"
ACCENTS = "[֑-֯]"


def letters(text: Column) -> Column:
    """Lower-case letters only."""
    return F.regexp_replace(F.lower(text), r"\P{L}", "")


def unaccented(text: Column) -> Column:
    """Lower case with accented letters folded to their bases (folded first: filtering first would delete them)."""
    return F.translate(F.lower(text), *LATIN)


def skeleton(text: Column) -> Column:
    """Consonants of the folded text: what is left without vowels and marks."""
    return F.regexp_replace(unaccented(text), r"[^\p{L}]|[aeiouy]", "")


def hebrew_skeleton(text: Column) -> Column:
    """Hebrew consonants only."""
    return F.regexp_replace(text, HEBREW, "")


def greek_norm(text: Column) -> Column:
    """Lower case, accents and breathings folded, both sigmas as one, then Greek letters only."""
    return F.regexp_replace(F.translate(F.lower(text), *GREEK), "[^α-ω]", "")


def plain(text: Column) -> Column:
    """Pointed text without cantillation; a holam before a vav stands on it."""
    return F.replace(without_accents(text), F.lit("\u05b9\u05d5"), F.lit("\u05d5\u05b9"))


def without_accents(text: Column) -> Column:
    """Pointed text without cantillation."""
    return F.regexp_replace(text, ACCENTS, "")


def words(text: Column) -> Column:
    """Letter runs of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def chars(text: Column) -> Column:
    """The characters of a text; none for an empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def digits_up(text: Column) -> Column:
    return F.translate(text, "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")


def digits_down(text: Column) -> Column:
    return F.translate(text, "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉", "01234567890123456789")


def single_marks(text: Column) -> Column:
    """A doubled mark is one mark."""
    return F.regexp_replace(text, r"([.,;:!?])\1+", "$1")


def visible_width(text: Column) -> Column:
    """Width by character class: narrow letters count half, capitals one and a half, in tenths of a letter."""
    n = lambda rx: F.length(F.regexp_replace(text, f"[^{rx}]", ""))
    return 10 * F.length(text) - 5 * n("ijlt.,") + 5 * n("A-Z")


def edge(text: Column, last: bool = False) -> Column:
    """The first (last) token between blanks and hyphens."""
    return F.regexp_extract(text, r"([^ \-]+)[ \-]*$" if last else r"^[ \-]*([^ \-]+)", 1)


def mostly(run: Column, other: Column) -> Column:
    """One of the two is within the other, and the longer is at most twice as long; false for an empty or null one."""
    n, m = F.length(run), F.length(other)
    within = (F.instr(other, run) > 0) | (F.instr(run, other) > 0)
    return F.coalesce((n > 0) & (m > 0) & within & (2 * F.least(n, m) >= F.greatest(n, m)), F.lit(False))


def located(run: Column, masoretic: Column, alexandrian: Column, notes: Column, parsed: Column) -> Column:
    """Where a missing run of letters is: six places, the first that holds counts. Common text stands in both editions, so
    the first is asked before the second."""
    has = lambda c: F.instr(c, run) > 0
    return (
        F.when(F.length(run) < 3, "short").when(has(masoretic), "misordered").when(has(alexandrian), "alexandrian")
        .when(F.exists(notes, lambda n: mostly(run, n)), "margin").when(has(parsed), "parsed").otherwise("lost")
    )


def context(text: Column, at: Column, n: Column, width: int = 12) -> Column:
    """The run of n characters at place ``at`` (from 1) between marks, with what stands around it."""
    start = F.greatest(at - width, F.lit(1))
    return F.concat(F.substring(text, start, at - start), F.lit("["), F.substring(text, at, n), F.lit("]"), F.substring(text, at + n, F.lit(width)))


def unspaced(text: Column) -> Column:
    """Letter-spaced groups closed up: between gaps of two blanks, three or more parts of one letter each."""
    groups = F.split(text, r" {2,}")
    return F.array_join(F.transform(groups, lambda g: F.when(g.rlike(r"^\p{L}( \p{L}){2,}$"), F.replace(g, F.lit(" "), F.lit(""))).otherwise(g)), "  ")


def escaped(text: Column) -> Column:
    """Text for HTML."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def script_runs(text: Column) -> Column:
    """Text for HTML with each run of Hebrew isolated."""
    return F.regexp_replace(escaped(text), r"([֐-׿][֐-׿ \t-\r]*[֐-׿]|[֐-׿])", '<bdi class="heb">$1</bdi>')


def inline(text: Column) -> Column:
    """A note set in the line."""
    return F.concat(F.lit('<bdi class="inl" dir="ltr">'), script_runs(text), F.lit("</bdi>"))


def symbols(text: Column) -> Column:
    """Two private-use glyphs of the symbol font as arrows: fixed values."""
    return F.translate(text, "\uf0dc\uf0de", "⇐⇒")


def tight(text: Column) -> Column:
    """Blanks out after an opening bracket and before stops and a closing one."""
    return F.regexp_replace(F.regexp_replace(text, r"\([ \t-\r]+", "("), r"[ \t-\r]+([,;.)])", "$1")


def cell(html: Column) -> Column:
    """Tags out, entities decoded, blanks folded."""
    text = F.regexp_replace(html, "(?s)<[^>]*>", " ")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def continental(n: Column) -> Column:
    """1,234 as 1.234."""
    return F.translate(F.format_number(n, 0), ",", ".")
