"""Suffix arrays by linear grouping construction.

Phase 1 sorts suffixes into groups by their Lyndon prefix. It starts with one group per first
symbol and handles groups in descending order. For each suffix of a group it follows
previous-smaller pointers to the nearest suffix on the left in a lower group; that suffix's
Lyndon prefix goes on with the group's, so it is split off to the end of its own group (those
that are followed by more copies of the prefix go further to the end). Phase 2 emits the order
in each group in one ascending sweep: the suffixes whose Lyndon prefix ends where the current
suffix starts are next in their groups, and are found along the same pointers. Nothing is
renamed and sorted again recursively.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """The start places of the suffixes of an integer sequence in ascending order."""
    n = len(symbols)
    if n == 0:
        return []
    # places by group, in text order within a group
    values = np.asarray(symbols)
    order = np.argsort(values, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(values[order]) != 0]))
    place, start, size = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    place[order] = np.arange(n)
    size[first] = np.diff(np.concatenate([first, [n]]))
    start[order] = np.repeat(first, size[first])
    start = start.tolist()
    previous = _group(order.tolist(), place.tolist(), start, size.tolist())
    return _emit(n, start, previous)


def _group(sa: list[int], place: list[int], start: list[int], size: list[int]) -> list[int]:
    """Splits groups until they are the Lyndon groups; the previous-smaller pointers."""
    n = len(sa)
    previous = [-1] * n
    end = n
    while end > 0:
        group = start[sa[end - 1]]
        if end - group == 1:  # the common case, a group of one, without counting
            s = sa[group]
            end = group
            p = s - 1
            while p >= 0 and start[p] > group:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                g = start[p]
                m = size[g]
                if m > 1:
                    at, to = place[p], g + m - 1
                    if at != to:
                        other = sa[to]
                        sa[at], place[other] = other, at
                        sa[to], place[p] = p, to
                    size[g], size[to], start[p] = m - 1, 1, to
            continue
        counts: dict[int, int] = {}
        for s in sorted(sa[group:end]):
            p = s - 1
            while p >= 0 and start[p] > group:
                p = previous[p]
            if p >= 0 and start[p] == group:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                if p in counts:
                    counts[p] += 1
                else:
                    counts[p] = 1
        end = group
        if not counts:
            continue
        # those followed by more copies of the prefix are moved first, so they end up further to the end
        if max(counts.values()) == min(counts.values()):
            levels = [counts]
        else:
            by: dict[int, list[int]] = {}
            for p, c in counts.items():
                by.setdefault(c, []).append(p)
            levels = [by[c] for c in sorted(by, reverse=True)]
        for level in levels:
            moved: dict[int, int] = {}
            for p in level:
                g = start[p]
                m = moved[g] + 1 if g in moved else 1
                moved[g] = m
                at, to = place[p], g + size[g] - m
                if at != to:
                    other = sa[to]
                    sa[at], place[other] = other, at
                    sa[to], place[p] = p, to
            for g, m in moved.items():
                if m == size[g]:
                    continue
                new = g + size[g] - m
                size[g] -= m
                size[new] = m
                for k in range(new, new + m):
                    start[sa[k]] = new
    return previous


def _emit(n: int, start: list[int], previous: list[int]) -> list[int]:
    out, done, free = [0] * n, [False] * n, list(range(n))
    j = n - 1
    while j >= 0:
        g = start[j]
        out[free[g]] = j
        free[g] += 1
        done[j] = True
        j = previous[j]
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = start[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = previous[j]
    return out


def common_prefixes(symbols: Sequence[int], sa: Sequence[int], most: int) -> list[int]:
    """Length, up to ``most``, of the common prefix of each suffix with the one before it in sa."""
    n, out = len(sa), [0] * len(sa)
    place = [0] * n
    for k, s in enumerate(sa):
        place[s] = k
    h = 0
    for s in range(n):
        if place[s] == 0:
            h = 0
            continue
        p = sa[place[s] - 1]
        while h < most and s + h < n and p + h < n and symbols[s + h] == symbols[p + h]:
            h += 1
        out[place[s]] = h
        h = max(0, h - 1)
    return out
