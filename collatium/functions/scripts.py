"""Two legacy fonts: visual-order Hebrew and transliterated Greek, as Unicode; and what is asked of visual Hebrew words."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The Hebrew font's letters (with their dagesh, dots or vowel where one glyph has both), marks and signs.
HEBREW = {
    "a": "א", "b": "ב", "g": "ג", "d": "ד", "h": "ה", "w": "ו", "z": "ז", "x": "ח", "j": "ט", "y": "י", "k": "כ",
    "l": "ל", "m": "מ", "n": "נ", "s": "ס", "[": "ע", "p": "פ", "c": "צ", "q": "ק", "r": "ר", "t": "ת",
    "v": "שׁ", "f": "שׂ",
    "%": "ךְ", "$": "ך", "~": "ם", "!": "ן", "@": "ף", "#": "ץ",
    "B": "בּ", "G": "גּ", "D": "דּ", "H": "הּ", "W": "וּ", "Z": "זּ", "J": "טּ", "Y": "יּ", "K": "כּ",
    "L": "לּ", "M": "מּ", "N": "נּ", "S": "סּ", "P": "פּ", "C": "צּ", "Q": "קּ", "R": "רּ", "T": "תּ",
    "V": "שּׁ", "F": "שּׂ", "&": "ךּ", "A": "וֹ", "^": "ךָ",
}
HEBREW_MARKS = {
    "'": "ָ", '"': "ָ", ";": "ַ", ":": "ַ", ",": "ֶ", "<": "ֶ", "e": "ֵ", "E": "ֵ", "i": "ִ", "I": "ִ",
    "o": "ֹ", "O": "ֹ", "{": "ֹ", "u": "ֻ", "U": "ֻ", ">": "ְ", ".": "ְ", "]": "ֲ", "/": "ֱ", "\\": "ֳ",
}
HEBREW_SIGNS = {"-": "־", "`": "׃"}
#: The Greek font's letters, marks after a letter, marks before a word's first letter, and the elision sign.
GREEK = dict(zip("abgdezhqiklmnxoprsjtufcywABGDEZHQIKLMNXOPRSTUFCYW", "αβγδεζηθικλμνξοπρσςτυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", strict=True))
GREEK_MARKS = {
    "v": "̓", "`": "̔", ";": "̓́", "[": "̔́", "]": "̔̀", "=": "̓͂", "~": "̔͂", ",": "́", ".": "̀",
    "/": "͂", "-": "̔͂", "'": "̓̀", "|": "ͅ", "+": "̈", "<": "̈", "?": "̈",
}
GREEK_BEFORE = {"V": "̓", "+": "̓͂"}
ELISION, GREEK_SIGNS = "᾿", ".,;:!?()-0123456789"

BLANK = r"[ \t-\r]"
FINAL, PROCLITIC = "ךםןףץ", "ובלכמהש"
POINTS = r"[\x{0591}-\x{05bd}\x{05bf}-\x{05c2}\x{05c4}-\x{05c7}]"


def one_of(signs, more: str = "", without: bool = False) -> str:
    """A character class that Java, RE2 and DuckDB read alike."""
    return f"[{'^' if without else ''}{''.join(rf'\x{{{ord(c):04x}}}' for c in signs)}{more}]"


BASE, MARK, SIGN = one_of(HEBREW), one_of(HEBREW_MARKS), one_of(HEBREW_SIGNS)
STRAY = one_of("".join([*HEBREW, *HEBREW_MARKS, *HEBREW_SIGNS]), r" \t-\r", without=True)
UNIT = rf"(?:{BASE}{MARK}*|{SIGN}|{BLANK})"
#: What of a visual text makes its last word in reading order: all up to the first blank after a letter or sign.
LAST_WORD = rf"^{one_of([*HEBREW, *HEBREW_SIGNS], without=True)}*[^ \t-\r]*"
TABLE = HEBREW | HEBREW_MARKS | HEBREW_SIGNS
SINGLE = {k: v for k, v in TABLE.items() if len(v) == 1}
MANY = {k: v for k, v in TABLE.items() if len(v) > 1}


def to_hebrew(visual: Column) -> Column:
    """Visual order as logical: units of a letter and its marks, or a sign, or a blank, are reversed and then spelled out.

    Signs that the font doesn't use for text are dropped first, so that no markup passes for text.
    """
    units = F.regexp_extract_all(F.regexp_replace(visual, STRAY, ""), F.lit(UNIT), 0)
    text = F.array_join(F.reverse(units), "")
    for sign, value in MANY.items():
        text = F.replace(text, F.lit(sign), F.lit(value))
    text = F.translate(text, "".join(SINGLE), "".join(SINGLE.values()))
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def bare_hebrew(visual: Column) -> Column:
    """to_hebrew without points, its blanks as they are: without marks every unit is one sign, and the text is turned as a whole."""
    kept = HEBREW | HEBREW_SIGNS | dict.fromkeys(" \t\n\x0b\x0c\r", " ")
    text = F.reverse(F.regexp_replace(visual, one_of(kept, without=True) + "+", ""))
    return F.trim(F.translate(text, "".join(kept), "".join(v[0] for v in kept.values())))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def to_hebrew_sql(column: str) -> str:
    text = f"array_to_string(list_reverse(regexp_extract_all(regexp_replace({column}, '{STRAY}', '', 'g'), '{UNIT}')), '')"
    for sign, value in MANY.items():
        text = f"replace({text}, {quoted(sign)}, '{value}')"
    return f"trim(regexp_replace(translate({text}, {quoted(''.join(SINGLE))}, '{''.join(SINGLE.values())}'), '{BLANK}+', ' ', 'g'))"


def _python_class(signs) -> str:
    return "[" + "".join(map(re.escape, signs)) + "]"


#: A letter with the marks that belong to it, also past blanks within a broken word; or what stands by itself.
_LETTER, _MARKS = _python_class(GREEK), _python_class(GREEK_MARKS)
_IN_WORD = _python_class([m for m in GREEK_MARKS if m not in GREEK_BEFORE])
GREEK_PIECE = re.compile(rf"(?P<letter>{_LETTER})(?P<near>{_MARKS}*)(?P<far>(?:\s+{_IN_WORD}+)*)|(?P<blank>\s+)|(?P<other>.)", re.S)


_UNKNOWN = re.compile(_python_class([*GREEK, *GREEK_MARKS, *GREEK_BEFORE, *GREEK_SIGNS])[:-1].replace("[", "[^", 1) + r"\s]+")
#: Blanks that no mark follows: a mark of the word after them can't belong to a letter before them, so that words are apart.
_APART = re.compile(rf"\s+(?!\s|{_IN_WORD})")
#: Signs that ask for what came before them, and runs of letters with their marks, where these have no such sign among them.
_WAITING = re.compile(r"[V+\s]")
_RUN, _WHOLE = re.compile(rf"({_LETTER}(?:{_LETTER}|{_MARKS})*)|(.)"), re.compile(rf"{_LETTER}(?:{_LETTER}|{_MARKS})*")
_SPELL = str.maketrans(GREEK | GREEK_MARKS)
#: Words spelled out before; texts repeat most of theirs. Only words that neither meet nor leave a mark that waits for a letter.
_WORDS: dict[str, str] = {}
MOST_WORDS, LONGEST = 100_000, 40


def greek(text: str) -> str:
    """Transliterated Greek, composed. A mark belongs to the last letter, even past a blank that broke the word in two."""
    out, before, known = [], "", _WORDS.get
    for word in _APART.split(_UNKNOWN.sub("", text)):
        spelled = None if before else known(word)
        if spelled is None:
            met = before
            spelled, before = _greek_word(word, met) if met or _WAITING.search(word) else (_plain_word(word), "")
            if not met and not before and len(word) <= LONGEST:
                if len(_WORDS) >= MOST_WORDS:
                    _WORDS.clear()
                _WORDS[word] = spelled
        if spelled:
            out.append(spelled)
    return " ".join(out)


def _plain_word(known: str) -> str:
    """A word without blanks and without signs that wait."""
    if _WHOLE.fullmatch(known):
        return unicodedata.normalize("NFC", known.translate(_SPELL))
    parts = [m[1].translate(_SPELL) if m[1] else m[2] if m[2] in GREEK_SIGNS else "" for m in _RUN.finditer(known)]
    return unicodedata.normalize("NFC", "".join(parts))


def _greek_word(known: str, before: str) -> tuple[str, str]:
    out, inside = [], False
    for m in GREEK_PIECE.finditer(known):
        if m["letter"]:
            marks = "".join(GREEK_MARKS[c] for c in m["near"] + m["far"] if not c.isspace())
            out.append(GREEK[m["letter"]] + before + marks + " " * bool(m["far"]))
            before, inside = "", not m["far"]
        elif m["blank"]:
            out.append(" ")
            inside = False
        elif m["other"] in GREEK_BEFORE:
            out.append(ELISION if inside and m["other"] == "V" else "")
            before = before if inside else GREEK_BEFORE[m["other"]]
        else:
            out.append(m["other"] if m["other"] in GREEK_SIGNS else "")
            inside = inside and not out[-1]
    return unicodedata.normalize("NFC", re.sub(" +", " ", "".join(out))).strip(), before


to_greek = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else greek(t)), T.StringType())


def consonants(text: Column) -> Column:
    """How many Hebrew consonants a text has."""
    return F.length(F.regexp_replace(text, "[^א-ת]", ""))


def last_letter(hebrew: Column) -> Column:
    """The last letter with its points, if the text ends in one; else empty."""
    return F.regexp_extract(hebrew, rf"([א-ת]{POINTS}*)$", 1)


def first_unit(visual: Column) -> Column:
    """The word's first letter in reading order, the last one in visual order, with its points."""
    return to_hebrew(F.regexp_extract(visual, f"({BASE}{one_of(HEBREW, without=True)}*)$", 1))


def without_first(visual: Column) -> Column:
    """The word without that letter; empty where it has no letter."""
    return F.regexp_extract(visual, f"^(?s)(.*){BASE}{one_of(HEBREW, without=True)}*$", 1)


def open_head(hebrew: Column) -> Column:
    """Whether a piece can't stand as a word: a single letter, or one that ends on a pointed letter.

    Four pointed endings are whole words: a final form, a dagesh in he, a patah under het or under ayin.
    """
    return _open(hebrew, last_letter(hebrew), consonants(hebrew))


def _open(hebrew: Column, last: Column, n: Column) -> Column:
    ends = (F.length(last) == 1) | last.rlike(f"^[{FINAL}]") | last.rlike("^ה.*ּ") | last.rlike("^[חע].*ַ")
    return (last != "") & ~hebrew.endswith("־") & ((n == 1) | ~ends)


def supplied(mt: Column, og: Column) -> Column:
    """What completes an abbreviated first form from the second (both visual), else null: the second without its first letter.

    Where the head ends in a sheva and the tail begins with one, that letter is said twice and is left out too.
    """
    head, tail = to_hebrew(mt), without_first(og)
    return _supplied(consonants(head) < consonants(to_hebrew(og)), open_head(head), head, tail)


def _supplied(shorter: Column, is_open: Column, head: Column, tail: Column) -> Column:
    twice = head.endswith("ְ") & F.contains(first_unit(tail), F.lit("ְ"))
    cut = F.when(twice, without_first(tail)).otherwise(tail)
    return F.when(shorter & is_open & (F.trim(tail) != "") & (F.trim(cut) != ""), cut)


def tail_only(mt: Column, og: Column) -> Column:
    """Whether the second form of a pair set inside a word is the abbreviated one: shorter, not bound, and no proclitic."""
    first, second = to_hebrew(mt), to_hebrew(og)
    return supplied(mt, og).isNull() & _tail_only(consonants(first), consonants(second), first, second)


def _tail_only(n: Column, m: Column, first: Column, second: Column) -> Column:
    last = last_letter(second)
    proclitic = (m == 1) & ~last.rlike(f"^[{FINAL}]") & F.contains(last, F.lit("ְ"))
    return (m < n) & ~first.endswith("־") & ~second.endswith("־") & ~proclitic


def spelled(pairs: DataFrame) -> DataFrame:
    """pairs (mt, og, both visual) with the columns that supplied_of and tail_only_of ask for.

    Each is a projection of its own, so that a word is spelled out once and not at every mention in an expression.
    """
    rows = pairs.withColumns({"_first": to_hebrew(F.col("mt")), "_second": to_hebrew(F.col("og"))})
    rows = rows.withColumns({"_n": consonants(F.col("_first")), "_m": consonants(F.col("_second")), "_last": last_letter(F.col("_first"))})
    return rows.withColumn("_tail", F.when((F.col("_n") < F.col("_m")) & _open(F.col("_first"), F.col("_last"), F.col("_n")), without_first(F.col("og"))))


def supplied_of() -> Column:
    """supplied(mt, og) of spelled pairs."""
    tail = F.col("_tail")
    return _supplied(tail.isNotNull(), F.lit(True), F.col("_first"), tail)


def tail_only_of() -> Column:
    """tail_only(mt, og) of spelled pairs for which supplied_of gives nothing."""
    return _tail_only(F.col("_n"), F.col("_m"), F.col("_first"), F.col("_second"))


def bound_fragment(hebrew: Column) -> Column:
    """Whether a text's last word is a prefix left hanging: one or two consonants, all of them proclitic."""
    return F.regexp_replace(F.regexp_extract(hebrew, "([^ ]+) *$", 1), "[^א-ת]", "").rlike(f"^[{PROCLITIC}]{{1,2}}$")


#: A single proclitic consonant with its vowels.
LONE = rf"[{PROCLITIC}][\x{{0591}}-\x{{05af}}\x{{05b0}}-\x{{05b8}}\x{{05bb}}-\x{{05bd}}\x{{05bf}}\x{{05c1}}-\x{{05c2}}\x{{05c4}}-\x{{05c7}}]*"


def bound(words: Column, joined: Column) -> Column:
    """Words (an array) with every lone proclitic bound to the Hebrew word after it; the first word of a joined piece is the end of another and isn't."""
    return bound_text(F.array_join(words, " "), joined)


def bound_text(text: Column, joined: Column) -> Column:
    """The same of words that single blanks part."""
    inside = bound_inside(text)
    return F.when(joined, inside).otherwise(bound_first(inside))


def bound_inside(text: Column) -> Column:
    """Lone proclitics bound, but not the first word, which no blank is before."""
    return F.regexp_replace(text, f"(?<= )({LONE}) (?=[א-ת])", "$1")


def bound_first(text: Column) -> Column:
    return F.regexp_replace(text, f"^({LONE}) (?=[א-ת])", "$1")
