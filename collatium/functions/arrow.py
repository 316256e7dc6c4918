"""Functions that no built-in expresses, as pandas UDFs over whole sequences."""

from __future__ import annotations

import difflib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


def lcs_pairs(left: list[str], right: list) -> list[tuple[int, int]]:
    """Order-preserving alignment of greatest length; a right element may be a list of alternative keys.

    Empty keys match nothing. Where leaving out the left item loses nothing it is left out. O(n m) in time, a byte for each cell in memory.
    """
    n, m = len(left), len(right)
    keys = [{k for k in (r if isinstance(r, (list, tuple, set, np.ndarray)) else (r,)) if k} for r in right]
    of: dict[str, list[int]] = {}
    for j, ks in enumerate(keys):
        for k in ks:
            of.setdefault(k, []).append(j)
    below = np.zeros(m + 1, dtype=np.int32)
    steps = np.zeros((n, m + 1), dtype=np.int8)  # 0: leave out the left item, 1: the right one, 2: take both
    for i in range(n - 1, -1, -1):
        take = np.zeros(m + 1, dtype=np.int32)
        at = np.array(of.get(left[i], []), dtype=np.int64)
        take[at] = below[at + 1] + 1
        here = np.maximum.accumulate(np.maximum(below, take)[::-1])[::-1]
        steps[i, :m] = np.where(below[:m] >= here[1:], 0, 1)
        steps[i, at] = 2
        below = here
    out, i, j = [], 0, 0
    while i < n and j < m:
        step = steps[i, j]
        if step == 2:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif step == 0:
            i += 1
        else:
            j += 1
    return out


@F.pandas_udf(_rows(l=T.IntegerType(), r=T.IntegerType()))
def lcs_align(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([[] if a is None or b is None else [{"l": i, "r": j} for i, j in lcs_pairs(list(a), list(b))] for a, b in zip(left, right, strict=True)])


def diff_runs(want: str, got: str) -> list[tuple[str, int, str, str]]:
    """(op, place in want, wanted run, run got) of what differs, by matching blocks of greatest length (not LCS)."""
    match = difflib.SequenceMatcher(None, want, got, autojunk=False)
    return [(op, a, want[a:b], got[c:d]) for op, a, b, c, d in match.get_opcodes() if op != "equal"]


@F.pandas_udf(_rows(op=T.StringType(), at=T.IntegerType(), want=T.StringType(), got=T.StringType()))
def sequence_diff(want: pd.Series, got: pd.Series) -> pd.Series:
    """The parts that differ, in order."""
    out = []
    for a, b in zip(want, got, strict=True):
        a, b = a or "", b or ""
        out.append([{"op": op, "at": at, "want": x, "got": y} for op, at, x, y in diff_runs(a, b)])
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def nfd_fold(text: pd.Series) -> pd.Series:
    """Lower case without any combining mark."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def rejoined(tokens: list[str], known: set[str], most: int = 5) -> list[str]:
    """Parts of a broken word joined: the longest run of up to ``most`` tokens whose join is known and of which a part is not."""
    out, i = [], 0
    while i < len(tokens):
        for k in range(min(most, len(tokens) - i), 1, -1):
            run = tokens[i : i + k]
            if "".join(run) in known and any(t not in known for t in run):
                out.append("".join(run))
                i += k
                break
        else:
            out.append(tokens[i])
            i += 1
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def rejoin(tokens: pd.Series, joins: pd.Series, parts: pd.Series) -> pd.Series:
    """tokens with broken words joined; joins and parts: those of the row's candidates and tokens that are known.

    The vocabulary is joined as a table beforehand, so a task holds no more of it than a row needs.
    """
    return pd.Series([[] if t is None else rejoined(list(t), set(() if j is None else j) | set(() if p is None else p)) for t, j, p in zip(tokens, joins, parts, strict=True)])
