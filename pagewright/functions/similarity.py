"""Sequence similarity that SQL cannot express, as Arrow batches over distinct pairs."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    matcher, held, out = difflib.SequenceMatcher(None, autojunk=False), None, []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if y != held:
            matcher.set_seq2(held := y)
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def ratio(a: str | Column, b: str | Column) -> Column:
    """Twice the matched characters (longest blocks first) over both lengths; null if either is."""
    return _ratio(a, b)


@F.pandas_udf(DoubleType())
def ratio_above(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """``ratio`` where it exceeds ``least``, else 0: letter counts rule most pairs out first."""
    matcher, held, out = difflib.SequenceMatcher(None, autojunk=False), None, []
    for x, y, m in zip(a, b, least, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if y != held:
            matcher.set_seq2(held := y)
        matcher.set_seq1(x)
        out.append(r if matcher.real_quick_ratio() > m and matcher.quick_ratio() > m and (r := matcher.ratio()) > m else 0.0)
    return pd.Series(out, dtype="float64")


#: Places of the table of trigrams; one more stands for none.
TRIGRAMS = 4096


def trigram_codes(texts: list[str]) -> np.ndarray:
    """A row a text: a place of the table for each trigram, ``TRIGRAMS`` beyond the end."""
    longest = max(map(len, texts), default=0)
    out = np.full((len(texts), max(longest - 2, 0)), TRIGRAMS, np.uint16)
    for k, text in enumerate(texts):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(c) > 2:
            out[k, : len(c) - 2] = ((c[:-2] * 40503 + c[1:-1] * 30011 + c[2:] * 60013) >> 3) % TRIGRAMS
    return out


def trigram_bound(total: np.ndarray, least: float) -> np.ndarray:
    """How many trigrams of one text the other has at least, if the ratio of texts of ``total`` letters exceeds ``least``.

    M matched letters lie in at most total - 2M + 1 blocks, as a letter of either text stands
    between two of them, and a block of n letters has n - 2 trigrams.
    """
    matched = np.floor(least * total / 2 - 1e-9)
    return matched - 2 * (total - 2 * matched + 1)


def earliest_like(texts: list[str], place: np.ndarray, group: np.ndarray, begin: int, wanted: np.ndarray, back: int, least: float, letters: int) -> np.ndarray:
    """For each row from ``begin`` on that is wanted the first row before it of its group, at a lower place within ``back``, whose ``ratio`` exceeds ``least``; else -1.

    Rows are in order of group and place.
    """
    n = len(texts)
    size, codes = np.array([len(t) for t in texts]), trigram_codes(texts)
    has = np.zeros((n, TRIGRAMS + 1), bool)
    has[np.arange(n)[:, None], codes] = True
    has[:, TRIGRAMS] = False
    found: list[tuple[int, int]] = []
    asked = np.flatnonzero(wanted & (size > letters) & (np.arange(n) >= begin))
    for lag in range(1, n):
        asked = asked[asked >= lag]
        asked = asked[(group[asked] == group[asked - lag]) & (place[asked] - place[asked - lag] <= back)]
        if not len(asked):
            break
        total = size[asked] + size[asked - lag]
        near = asked[(place[asked - lag] < place[asked]) & (2 * np.minimum(size[asked], size[asked - lag]) > least * total)]
        shared = has[(near - lag)[:, None], codes[near]].sum(axis=1)
        near = near[shared >= trigram_bound(size[near] + size[near - lag], least)]
        found += zip(near.tolist(), (near - lag).tolist(), strict=True)
    out, seen = np.full(n, -1), {}
    for i, j in sorted(found):
        if out[i] < 0 and in_order(texts[i], seen.get(j) or seen.setdefault(j, letter_places(texts[j]))) > least * (len(texts[i]) + len(texts[j])) / 2 - 1e-9:
            if difflib.SequenceMatcher(None, texts[i], texts[j], autojunk=False).ratio() > least:
                out[i] = j
    return out


def letter_places(text: str) -> dict[str, int]:
    """The places of each letter of a text, as bits."""
    out: dict[str, int] = {}
    for k, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << k
    return out


def in_order(text: str, places: dict[str, int]) -> int:
    """The longest common subsequence of two texts, by bits; matched blocks are one, so it bounds their letters."""
    every = 0
    for bits in places.values():
        every |= bits
    v = every
    for c in text:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & every
    return (every ^ v).bit_count()


@F.pandas_udf(DoubleType())
def best_ratio(a: pd.Series, others: pd.Series) -> pd.Series:
    """The largest ``ratio`` with a string of an array; null if there is none."""
    out = []
    for x, ys in zip(a, others, strict=True):
        best = None
        for y in ys if x is not None and ys is not None else ():
            if y is not None:
                m = difflib.SequenceMatcher(None, x, y, autojunk=False)
                if best is None or m.real_quick_ratio() > best and m.quick_ratio() > best:
                    best = max(best or 0.0, m.ratio())
        out.append(best)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(ArrayType(DoubleType()))
def ratios(a: pd.Series, others: pd.Series) -> pd.Series:
    """The ``ratio`` with each string of an array; null where either is."""
    one = lambda x, y: None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
    return pd.Series([None if ys is None else [one(x, y) for y in ys] for x, ys in zip(a, others, strict=True)])


@F.pandas_udf(DoubleType())
def matched_letters(a: pd.Series, b: pd.Series) -> pd.Series:
    """The characters of a that the longest common blocks match in b; null if either is."""
    blocks = lambda x, y: sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
    return pd.Series([None if x is None or y is None else float(blocks(x, y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """An upper bound of ``ratio`` by lengths alone, to spare Python the hopeless pairs."""
    return F.try_divide(2.0 * F.least(F.length(a), F.length(b)), F.length(a) + F.length(b))
