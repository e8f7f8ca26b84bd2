"""String similarity: indel ratio, token-set ratio and metaphone, from their published definitions.

The pandas functions work on Arrow batches; a batch computes each distinct pair once.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of one number."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        match = row & at.get(c, 0)
        row = (row + match | row - match) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / total length)."""
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the common tokens, and these with each side's own tokens; 100 if one side's tokens hold the other's; 0 if a side is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, other = " ".join(filter(None, (both, left))), " ".join(filter(None, (both, right)))
    best = ratio(one, other)
    return max(best, ratio(both, one), ratio(both, other)) if both else best


_VOWELS = "AEIOU"


def metaphone(word: str) -> str:
    """Lawrence Philips' original metaphone code of a word."""
    w = re.sub("[^A-Z]", "", word.upper())
    w = re.sub(r"([^C])\1+", r"\1", w)
    if not w:
        return ""
    if w[:2] in ("KN", "GN", "PN", "AE", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out, i, n = [], 0, len(w)
    while i < n:
        c, prev, nxt, after = w[i], w[i - 1] if i else "", w[i + 1] if i + 1 < n else "", w[i + 2] if i + 2 < n else ""
        step = 1
        if c in _VOWELS:
            out.append(c if i == 0 else "")
        elif c == "B":
            out.append("" if prev == "M" and not nxt else "B")
        elif c == "C":
            if nxt and nxt in "IEY":
                out.append("X" if nxt == "I" and after == "A" else "" if prev == "S" else "S")
            elif nxt == "H":
                out.append("K" if prev == "S" or (i == 0 and after not in _VOWELS) else "X")
                step = 2
            else:
                out.append("K")
                step = 2 if nxt == "C" and after not in ("I", "E", "Y") else 1
        elif c == "D":
            if nxt == "G" and after and after in "IEY":
                out.append("J")
                step = 3
            else:
                out.append("T")
        elif c == "G":
            if nxt == "H":
                if i + 2 < n and after not in _VOWELS:
                    out.append("")
                else:
                    out.append("K" if i == 0 or (after and after in _VOWELS) else "")
                step = 2
            elif nxt == "N":
                out.append("" if i + 2 >= n or w[i + 1 :] == "NED" else "K")
            elif nxt and nxt in "IEY" and prev != "G":
                out.append("J")
            else:
                out.append("K")
        elif c == "H":
            out.append("H" if nxt and nxt in _VOWELS and prev not in ("C", "S", "P", "T", "G") else "")
        elif c == "K":
            out.append("" if prev == "C" else "K")
        elif c == "P":
            out.append("F" if nxt == "H" else "P")
            step = 2 if nxt == "H" else 1
        elif c == "Q":
            out.append("K")
        elif c == "S":
            if nxt == "H":
                out.append("X")
                step = 2
            elif nxt == "I" and after in ("O", "A"):
                out.append("X")
            elif nxt == "C" and after == "H":
                out.append("SK")
                step = 3
            else:
                out.append("S")
        elif c == "T":
            if nxt == "I" and after in ("A", "O"):
                out.append("X")
            elif nxt == "H":
                out.append("0")
                step = 2
            elif nxt == "C" and after == "H":
                out.append("")
            else:
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            out.append(c if nxt and nxt in _VOWELS else "")
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        else:  # F J L M N R
            out.append(c)
        i += step
    return "".join(out)


def _pairs(fn, a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict = {}
    out = []
    for p in zip(a, b, strict=True):
        if p not in known:
            known[p] = None if p[0] is None or p[1] is None else fn(*p)
        out.append(known[p])
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(ratio, a, b)


@F.pandas_udf(T.DoubleType())
def token_set_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(token_set_ratio, a, b)


@F.pandas_udf(T.StringType())
def metaphone_udf(word: pd.Series) -> pd.Series:
    known = {w: metaphone(w) for w in set(word.dropna())}
    return word.map(lambda w: known.get(w))
