"""Removal of repeated byte strings, and repeated passages of words, decided by suffix arrays.

A byte is removed if a string of ``size`` bytes that covers it also starts anywhere else in the
corpus, in the same document or another; strings never cross documents. Beside the removal, a
document's passages are counted: maximal runs of words covered by ``passage_words`` words in a
row that also start anywhere else. Bytes and words are two kinds of symbols of one procedure:

1. Windows of a size are put into classes: neighbouring windows of a text with the same
   minimiser (the least hash among the short grams of the window). Equal windows have equal
   minimisers at the same distance, so a window can only be repeated within its minimiser's
   group, and only groups found twice or more are looked at again.
2. Classes of one content are one entry with a number of copies: with two or more, all its
   windows are repeated. Content and group make 128 bits of hash.
3. Groups with several contents are decided by suffix arrays. A class is cut to the symbols
   around the minimiser that it shares with some other member on either side; equal remainders
   (compared whole) are one. Over the remainders a suffix array is built (linear grouping
   construction, see suffix_array.py). A window is repeated if the common prefix with a neighbour
   in suffix order covers it. A hash rules neighbours out; those left are compared symbol by
   symbol, so no hash decides that windows are equal. Equal windows lie alike around their
   minimiser, so the array of bytes is built over cells of eight bytes counted from it.
4. A group with more than HOT different members is not gathered in one task: its windows are
   put in order by a shuffle and counted there.

Defined results for odd input: a null text is empty; texts shorter than ``size`` stay; very long
texts are handled in overlapping pieces; identical rows repeat each other; an empty table gives
an empty table; a null doc_id stays null; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialise, table, text_or_empty
from .line_dedup import LAST
from .minhash_dedup import WordHashes
from .suffix_array import suffix_array
from .windows import Hashed, classes, mix


class Kind(NamedTuple):
    """A kind of symbols: windows of ``size``, grams of ``gram``; its number is the last bit of its groups."""

    number: int
    size: int
    gram: int
    dtype: type


def kinds(size: int, passage_words: int | None) -> list[Kind]:
    return [Kind(0, size, min(64, size), np.uint8)] + ([Kind(1, passage_words, min(12, passage_words), np.uint64)] if passage_words else [])


#: Bytes of text handled at a time, and bytes of remainders per suffix array, about.
BATCH_BYTES, ARRAY_BYTES = 1 << 20, 1 << 18
#: Groups with more different members than this are counted by shuffled windows.
HOT = 8192
_words = WordHashes(150_000)


def _symbols(text: bytes, kind: Kind) -> np.ndarray:
    return np.frombuffer(b"".join(map(_words.__getitem__, text.split())) if kind.number else text, kind.dtype)


def _pieces(texts: list[bytes], kind: Kind) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, first symbol, symbols) in pieces that overlap by a window less one, so that each window is in one piece."""
    for k, t in enumerate(texts):
        x = _symbols(t, kind)
        for a in range(0, max(1, len(x) - kind.size + 1), BATCH_BYTES):
            yield k, a, x[a : a + BATCH_BYTES + kind.size - 1]


def _runs(pieces: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    held, size = [], 0
    for p in pieces:
        held.append(p)
        size += len(p[2])
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _classes(docs: DataFrame, every: list[Kind]) -> DataFrame:
    """One row per class of a text: group g, content c, and where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            d, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for kind in every:
                for held in _runs(_pieces(texts, kind)):
                    ends = np.cumsum([len(x) for _, _, x in held], dtype=np.int64)
                    r = classes(np.concatenate([x for _, _, x in held]), ends, kind.size, kind.gram)
                    of, at = (np.array([p[k] for p in held], np.int64)[r["doc"]] for k in (0, 1))
                    a = r["a"] - np.concatenate([[0], ends[:-1]])[r["doc"]] + at
                    g = r["g"] & ~np.uint64(1) | np.uint64(kind.number)
                    yield pa.RecordBatch.from_arrays([pa.array(d[of]), pa.array(t[of]), *(pa.array(x.astype(np.int32)) for x in (a, r["n"], r["off"])), _signed(g), _signed(r["c"])], names=["d", "t", "a", "n", "off", "g", "c"])

    return docs.select("d", "t", "text").mapInArrow(run, "d long, t long, a int, n int, off int, g long, c long")


def _contexts(docs: DataFrame, mixed: DataFrame, every: list[Kind]) -> DataFrame:
    """(g, c, n, off, copies, members, bytes): the symbols of one occurrence of each class of mixed groups."""
    wanted = materialise(mixed.groupBy("d", "t").agg(F.collect_list(F.struct("g", "c", "n", "off", "copies", "members", "a")).alias("rows")), "repeat-wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, rows in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in (("g", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("copies", pa.int64()), ("members", pa.int64()))]
                of = {k.number: (k, _symbols(text, k)) for k in every if any(r["g"] & 1 == k.number for r in rows)}
                parts = [of[r["g"] & 1][1][r["a"] : r["a"] + r["n"] - 1 + of[r["g"] & 1][0].size].tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())], names=["g", "c", "n", "off", "copies", "members", "bytes"])

    return docs.join(wanted, ["d", "t"]).select("text", "rows").mapInArrow(run, "g long, c long, n int, off int, copies long, members long, bytes binary")


def _shared(g: np.ndarray, parts: list[bytes], width: int, hashed: Hashed, anchor: np.ndarray, side: int) -> np.ndarray:
    """How many symbols on a side of the anchor each context shares with some other of its group, at least.

    Among sorted strings the longest common prefix with any other is that with a neighbour; it
    is found by bisection on range hashes. parts are the bytes of that side, read off the anchor.
    """
    groups = g.tolist()
    order = np.array(sorted(range(len(parts)), key=lambda i: (groups[i], parts[i])))
    group, length = g[order], np.array([len(x) // width for x in parts], np.int64)[order]
    one, two = anchor[order[:-1]], anchor[order[1:]]
    low = np.zeros(len(one), np.int64)
    high = np.where(group[1:] == group[:-1], np.minimum(length[1:], length[:-1]), 0)
    while (low < high).any():
        mid = (low + high + 1) // 2
        if side > 0:
            same = hashed.ranges(one, one + mid) == hashed.ranges(two, two + mid)
        else:
            same = hashed.ranges(one - mid, one) == hashed.ranges(two - mid, two)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    out = np.zeros(len(parts), np.int64)
    out[order[:-1]] = low
    out[order[1:]] = np.maximum(out[order[1:]], low)
    return out


def _equal(text: np.ndarray, one: np.ndarray, two: np.ndarray, size: int) -> np.ndarray:
    """Are the windows that start at one and at two equal, symbol by symbol?

    Pairs at one distance that follow each other are compared as one stretch.
    """
    order = np.lexsort((one, one - two))
    a, b = one[order], two[order]
    first = np.ones(len(a), bool)
    first[1:] = (np.diff(a) > size) | (np.diff(a - b) != 0)
    heads = np.flatnonzero(first)
    last = np.concatenate([heads[1:], [len(a)]]) - 1
    length = a[last] - a[heads] + size
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    stretch = np.repeat(np.arange(len(heads)), length)
    at = np.arange(int(length.sum())) - begin[stretch] + a[heads][stretch]
    wrong = np.concatenate([[0], np.cumsum(text[at] != text[at - (a - b)[heads][stretch]])])
    k = np.cumsum(first) - 1
    place = begin[k] + a - a[heads][k]
    out = np.zeros(len(a), bool)
    out[order] = wrong[place + size] == wrong[place]
    return out


def _suffix_classes(text: np.ndarray, order: np.ndarray, room: np.ndarray, size: int) -> np.ndarray:
    """A number for each place with ``size`` symbols of its string ahead: equal where those symbols are.

    They stand side by side in suffix order, so a new class begins where the common prefix with
    the neighbour before is shorter than ``size``.
    """
    order = order[room[order] >= size]
    out = np.full(len(text), -1, np.int64)
    if not len(order):
        return out
    hashes = Hashed(mix(text.astype(np.uint64) + np.uint64(1))).windows(size)
    near = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    new = np.ones(len(order), bool)
    if len(near):
        new[near[_equal(text, order[near + 1], order[near], size)] + 1] = False
    out[order] = np.cumsum(new) - 1
    return out


def _met_again(fields: list[np.ndarray]) -> np.ndarray:
    """Rows whose values in all fields some other row has too."""
    key = np.zeros(len(fields[0]), np.uint64)
    for x in fields:
        key = mix(key + x.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    order = np.argsort(key)
    close = key[order[1:]] == key[order[:-1]]
    same = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in fields])
    if (close & ~same).any():  # different rows of one hash stand between equal ones
        order = np.lexsort(fields)
        same = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in fields])
    out = np.zeros(len(key), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def repeated_windows(parts: list[np.ndarray], anchors: list[int], size: int) -> list[np.ndarray]:
    """For each of several different strings, which of its windows stand anywhere else in them.

    Equal windows lie alike around the anchors, so bytes are read as cells of eight from the anchor
    on. The suffix array of the strings of cells, parted by symbols of their own, brings windows
    with equal cells side by side; the up to seven bytes before and behind them are compared too.
    """
    pack = 8 if parts[0].dtype == np.uint8 and size >= 64 else 1
    count, left = np.array([len(x) for x in parts]), np.array(anchors, np.int64)
    before, cells = left // pack, left // pack + (count - left) // pack
    inner = [x[k - pack * q : k - pack * q + pack * n] for x, k, q, n in zip(parts, left.tolist(), before.tolist(), cells.tolist(), strict=True)]
    ends = np.cumsum(cells + 1)
    begin = ends - cells - 1
    flat = np.concatenate(inner)
    _, symbols = np.unique(flat.view(np.uint64) if pack == 8 else flat, return_inverse=True)
    text, inside = np.zeros(int(ends[-1]), np.int64), np.ones(int(ends[-1]), bool)
    inside[ends - 1] = False
    text[inside] = symbols
    text[ends - 1] = len(flat) + 1 + np.arange(len(parts))
    room = np.repeat(ends - 1, cells + 1) - np.arange(len(text))
    order = np.array(suffix_array(text))
    # every window: its string, its place from the anchor, the cells within it, and the bytes left over at either end
    windows = np.maximum(count - size + 1, 0)
    of = np.repeat(np.arange(len(parts)), windows)
    place = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    at = place - left[of]
    first, last = -((-at) // pack), (at + size) // pack
    lead, tail, many = pack * first - at, at + size - pack * last, last - first
    id_ = np.full(len(at), -1, np.int64)
    for m in np.unique(many).tolist():
        mine = many == m
        id_[mine] = _suffix_classes(text, order, room, m)[(begin[of] + first + before[of])[mine]] * (size + 1) + m
    if pack == 1:
        twice = np.bincount(id_)[id_] > 1
    else:
        data = np.concatenate([*parts, np.zeros(8, np.uint8)]).astype(np.uint64)
        word = np.zeros(len(data) - 8, np.uint64)
        for k in range(8):
            word |= data[k : k + len(word)] << np.uint64(8 * k)
        word = np.concatenate([word, np.zeros(1, np.uint64)])
        mask = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)
        start = (np.cumsum(count) - count)[of] + place
        twice = np.zeros(len(at), bool)
        _, back, times = np.unique(id_, return_inverse=True, return_counts=True)
        some = np.flatnonzero(times[back] > 1)
        if len(some):
            fields = [id_[some], lead[some], word[start[some]] & mask[lead[some]], word[(start + size - tail)[some]] & mask[tail[some]]]
            twice[some] = _met_again(fields)
    return np.split(twice, np.cumsum(windows)[:-1])


def edge_windows(g: list[int], contexts: list[bytes], off: list[int], kind: Kind) -> list[np.ndarray]:
    """For each context of whole groups, which of its windows another context of its group has too."""
    size, width = kind.size, np.dtype(kind.dtype).itemsize
    parts = [np.frombuffer(x, kind.dtype) for x in contexts]
    ends = np.cumsum([len(x) for x in parts])
    starts, data = np.concatenate([[0], ends[:-1]]), np.concatenate(parts)
    hashed, anchor, group = Hashed(data), starts + np.array(off, np.int64), np.array(g, np.int64)
    right = _shared(group, [x[o:].tobytes() for x, o in zip(parts, off, strict=True)], width, hashed, anchor, 1)
    left = _shared(group, [x[:o][::-1].tobytes() for x, o in zip(parts, off, strict=True)], width, hashed, anchor, -1)
    lo, hi = anchor - left, anchor + right
    out = [np.zeros(max(0, len(x) - size + 1), bool) for x in parts]
    live = np.flatnonzero(hi - lo >= size)
    if not len(live):
        return out
    distinct: dict[tuple[bytes, int], int] = {}
    of = [distinct.setdefault((data[lo[i] : hi[i]].tobytes(), int(left[i])), len(distinct)) for i in live.tolist()]
    count = np.bincount(of)
    if (count > 1).all():
        flags = [np.ones(len(x) // width - size + 1, bool) for x, _ in distinct]
    else:
        flags = repeated_windows([np.frombuffer(x, kind.dtype) for x, _ in distinct], [k for _, k in distinct], size)
        flags = [np.ones_like(f) if n > 1 else f for f, n in zip(flags, count.tolist(), strict=True)]
    for i, k in zip(live.tolist(), of, strict=True):
        at = int(lo[i] - starts[i])
        out[i][at : at + len(flags[k])] = flags[k]
    return out


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


VERDICT = "g long, c long, spans array<struct<lo:int,hi:int>>"


def _verdict_batch(g: list[int], c: list[int], spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array([[{"lo": a, "hi": b} for a, b in s] for s in spans], kind)], names=["g", "c", "spans"])


def _edges(contexts: DataFrame, every: list[Kind]) -> DataFrame:
    """Verdicts (g, c, spans of repeated windows) for classes that occur once in mixed groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        length, last = 0, None

        def flush() -> pa.RecordBatch:
            found = []
            for kind in every:
                mine = [r for r in held if r[0] & 1 == kind.number]
                flags = edge_windows([r[0] for r in mine], [r[4] for r in mine], [r[2] for r in mine], kind) if mine else []
                found += [(r[0], r[1], _spans(f)) for r, f in zip(mine, flags, strict=True) if r[3] == 1 and f.any()]
            return _verdict_batch([g for g, _, _ in found], [c for _, c, _ in found], [s for _, _, s in found])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held and row[0] != held[-1][0] and length >= ARRAY_BYTES:
                    yield flush()
                    held, length = [], 0
                if last == (row[0], row[1]):  # identical rows give a class twice
                    continue
                last = (row[0], row[1])
                held.append(row)
                length += len(row[4])
        if held:
            yield flush()

    ordered = contexts.select("g", "c", "off", "copies", "bytes").repartition("g").sortWithinPartitions("g", "c")
    return ordered.mapInArrow(run, VERDICT)


def _hot_edges(contexts: DataFrame, every: list[Kind]) -> DataFrame:
    """The same verdicts for hot groups, by counting windows in a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, c, off, copies, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                kind = every[g & 1]
                w = Hashed(np.frombuffer(raw, kind.dtype)).windows(kind.size)
                at = np.arange(len(w))
                key = mix(w + (at - off).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), g)), _signed(key), pa.array(np.full(len(w), c)), pa.array(np.full(len(w), copies)), pa.array(at.astype(np.int32))], names=["g", "key", "c", "copies", "at"])

    windows = contexts.select("g", "c", "off", "copies", "bytes").mapInArrow(run, "g long, key long, c long, copies long, at int").distinct()
    twice = windows.groupBy("g", "key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("g", "key")
    hit = windows.filter("copies = 1").join(twice, ["g", "key"]).groupBy("g", "c").agg(F.array_sort(F.collect_list("at")).alias("at"))
    return hit.select("g", "c", F.transform("at", lambda x: F.struct(x.alias("lo"), (x + 1).alias("hi"))).alias("spans"))


def repeated_spans(docs: DataFrame, every: list[Kind]) -> DataFrame:
    """(d, t, spans0, spans1) of documents (d, t, text): spans of repeated bytes and of words, not yet merged."""
    found = materialise(_classes(docs, every), "repeat-classes")
    place = F.struct("d", "t", "a", "n", "off")
    contents = found.groupBy("g", "c").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("p"))
    # a group with one class occurrence has nothing repeated; counted per group before any row is kept
    groups = contents.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.sum("copies").alias("all")).filter("all > 1").select("g", "members")
    repeated = materialise(contents.join(groups, "g").select("g", "c", "copies", "members", "p.*"), "repeat-groups")
    whole = repeated.filter("copies > 1").select("g", "c", F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi"))).alias("spans"))
    contexts = materialise(_contexts(docs, repeated.filter("members > 1"), every), "repeat-contexts")
    verdicts = whole.union(_edges(contexts.filter(F.col("members") <= HOT), every))
    hot = contexts.filter(F.col("members") > HOT)
    if not hot.isEmpty():
        verdicts = verdicts.union(_hot_edges(hot, every))
    verdicts = materialise(verdicts, "repeat-verdicts")
    drop_table(docs.sparkSession, contexts)
    word, byte = F.col("g").bitwiseAND(F.lit(1)) == 1, F.col("g").bitwiseAND(F.lit(1)) == 0
    reach = F.when(word, F.lit(every[-1].size)).otherwise(F.lit(every[0].size)) - 1
    moved = F.transform("spans", lambda s: F.struct((s["lo"] + F.col("a")).alias("lo"), (s["hi"] + F.col("a") + reach).alias("hi")))
    spans = found.select("g", "c", "d", "t", "a").join(verdicts, ["g", "c"]).select("d", "t", F.when(byte, moved).alias("s0"), F.when(word, moved).alias("s1"))
    return spans.groupBy("d", "t").agg(F.flatten(F.collect_list("s0")).alias("spans0"), F.flatten(F.collect_list("s1")).alias("spans1"))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["lo"], s["hi"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, size: int = 400, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False, passage_words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, unless digests_only, the kept bytes and the spans.

    With passage_words also n_passages and n_passage_words: the runs of words covered by so many
    words in a row that stand anywhere else too, and the words in them.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text_or_empty(text_col)).alias("t"), text_or_empty(text_col).alias("text"))
    spans = repeated_spans(keyed.select("d", "t", "text"), kinds(size, passage_words))
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    fields = [("n_bytes", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("n_spans", "long", pa.int64()), ("kept_sha256", "string", pa.string())]
    fields += [] if digests_only else [("kept", "binary", pa.binary()), ("spans", "array<struct<lo:int,hi:int>>", span)]
    fields += [("n_passages", "long", pa.int64()), ("n_passage_words", "long", pa.int64())] if passage_words else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, raw, words in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                gone, passages = _merged(raw or []), _merged(words or [])
                at, parts = 0, []
                for a, b in gone:
                    parts.append(text[at:a])
                    at = b
                kept = b"".join([*parts, text[at:]])
                row = [len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()]
                row += [] if digests_only else [kept, [{"lo": a, "hi": b} for a, b in gone]]
                row += [len(passages), sum(b - a for a, b in passages)] if passage_words else []
                rows.append(row)
            columns = [pa.array([r[k] for r in rows], kind) for k, (_, _, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(f[0] for f in fields)])

    schema = ", ".join(["doc_id long", *(f"{name} {kind}" for name, kind, _ in fields)])
    return keyed.join(spans, ["d", "t"], "left").select("doc_id", "text", "spans0", "spans1").mapInArrow(run, schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed at 400; beside them the passages of over 50 words, many of which are shorter than 400 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"), size=400, digests_only=True, passage_words=51)
