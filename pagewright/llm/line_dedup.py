"""Line dedup by a deletion-neighbourhood join.

A line (trimmed, not blank) is removed if an earlier line of the corpus lies within the edit bound,
in code points: it equals it, or both have at least ``min_chars`` code points and differ by one
insertion, deletion or substitution (bound 1). One edit is much of a short line, so below
``min_chars`` only equal lines go. Earlier means smaller (doc_id, text hash, line number); it does
not matter whether the earlier line is removed itself.

1. Equal lines are reduced to their first place by hash.
2. Two lines one edit apart have equal halves on one side of the edit. Lines that share no half
   with another line have no partner and emit nothing.
3. The others emit every variant with one character of the other half deleted, as a hashed key:
   with the place of deletion (equal keys: a substitution) and without (equal to a whole line:
   an insertion). Equal variants are joined through the earliest line of each key, so a key that
   very many lines share costs one row per line, not per pair.
4. The edit distance of each pair found is verified on the texts, and the earliest line is kept.

Defined results for odd input: a null text is empty; null doc_ids come last in corpus order;
identical rows (doc_id and text) count as one document and get the same result; documents are
never dropped, only lines; very long lines are compared whole; an empty table gives an empty
table; columns called n_lines or n_removed give way to the new ones, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, table, text_or_empty

#: White space trimmed from lines.
TRIM = " \t\x0b\x0c\r"
#: Largest tables of keys (two or three numbers a row) that are broadcast.
BROADCAST_ROWS = 500_000
#: Documents turned into Python values, and lines put out, at a time: what a worker holds.
ROWS_AT_ONCE, LINES_AT_ONCE = 64, 8_192
LAST = (1 << 63) - 1
POSITION = ["d", "t", "line_no"]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _hash(kind: str, s: str) -> int:
    return _signed(xxhash.xxh64_intdigest(kind + s))


def lines_of(text: str, min_chars: int = 1) -> list[tuple[int, str]]:
    """(number, trimmed line) of the lines that take part."""
    return [(k, x) for k, x in enumerate(x.strip(TRIM) for x in text.split("\n")) if len(x) >= min_chars]


def half_keys(line: str) -> list[int]:
    """Halves as the equal or shorter partner would cut them, then as the longer one would."""
    n, out = len(line), []
    for s in (n, n - 1):
        out += [_hash(f"P{s} ", line[: s // 2]), _hash(f"S{s} ", line[n - (s - s // 2) :])]
    return out


def deletion_keys(line: str, left: bool, right: bool) -> tuple[int, np.ndarray, np.ndarray]:
    """(hash of the line, hashes of its variants, hashes of variants with their place).

    One character is deleted at each place of the half that may hold the edit.
    """
    n = len(line)
    with np.errstate(over="ignore"):
        codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        codes = codes * np.uint64(0x9E3779B97F4A7C15)
        codes ^= codes >> np.uint64(31)
        codes *= np.uint64(0xC2B2AE3D27D4EB4F)
        base, back = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
        power = np.ones(n, np.uint64)
        power[1:] = np.multiply.accumulate(np.full(n - 1, base))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power)])
        cut = n // 2 - 1  # the shorter partner's cut is here or one later
        lo, hi = (0 if left else max(cut, 0)), (n if right else min(n, n - (n - 1 - n // 2) + 1))
        at = np.arange(lo, hi)
        gone = sums[at] + (sums[-1] - sums[at + 1]) * back
        variants = gone ^ (gone >> np.uint64(32))
        variants *= np.uint64(0xE7037ED1A0B428DB)
        whole = np.uint64(int(sums[-1]))
        whole = (whole ^ (whole >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)
        placed = (variants ^ (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x8EBC6AF09C88C6E3)) * np.uint64(0x589965CC75374CC3)
    return int(whole.view(np.int64)), variants.view(np.int64), placed.view(np.int64)


def _small(written: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if it has few rows (counted from its files); else as it is, for a shuffled join."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches one by one, a few turned into Python values at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield from zip(*(c.to_pylist() for c in batch.slice(lo, ROWS_AT_ONCE).columns), strict=True)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def _occurrences(docs: DataFrame, min_chars: int, max_edits: int) -> DataFrame:
    kinds = {"d": pa.int64(), "t": pa.int64(), "line_no": pa.int32(), "h": pa.int64(), "keys": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for doc, th, text in _each(batches):
            for k, line in lines_of(text):
                rows.append((doc, th, k, _hash("L", line), half_keys(line) if max_edits and len(line) >= min_chars else []))
                if len(rows) >= LINES_AT_ONCE:
                    yield _batch(rows, kinds)
                    rows = []
        yield _batch(rows, kinds)

    return docs.select("d", "t", "text").mapInArrow(run, "d long, t long, line_no int, h long, keys array<long>")


def _texts(docs: DataFrame, places: DataFrame, min_chars: int) -> DataFrame:
    """(h, position, left, right, line) of the given places."""
    wanted = materialise(places.groupBy("d", "t").agg(F.collect_list(F.struct("line_no", "h", "left", "right")).alias("lines")), "line-places")

    kinds = {"h": pa.int64(), "d": pa.int64(), "t": pa.int64(), "line_no": pa.int32(), "left": pa.bool_(), "right": pa.bool_(), "line": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for doc, th, text, lines in _each(batches):
            own = dict(lines_of(text, min_chars))
            rows += [(x["h"], doc, th, x["line_no"], x["left"], x["right"], own[x["line_no"]]) for x in lines]
            if len(rows) >= LINES_AT_ONCE:
                yield _batch(rows, kinds)
                rows = []
        yield _batch(rows, kinds)

    joined = docs.join(broadcast_if_small(wanted, "lines"), ["d", "t"]).select("d", "t", "text", "lines")
    return joined.mapInArrow(run, "h long, d long, t long, line_no int, left boolean, right boolean, line string").dropDuplicates(["h"])


def _variants(texts: DataFrame) -> DataFrame:
    """(key, kind, h, position): kind 0 variants with their place, 1 variants, 2 whole lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                h, d, t, no, left, right, line = (batch.column(c)[k].as_py() for c in range(7))
                whole, variants, placed = deletion_keys(line, left, right)
                key = np.concatenate([placed, variants, [whole]])
                m = len(key)
                kind = np.concatenate([np.zeros(len(placed), np.int8), np.ones(len(variants), np.int8), [np.int8(2)]]).astype(np.int8)
                fixed = [pa.array(np.full(m, v, kind_)) for v, kind_ in ((h, np.int64), (d, np.int64), (t, np.int64), (no, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), *fixed], names=["key", "kind", "h", "d", "t", "line_no"])

    return texts.select("h", "d", "t", "line_no", "left", "right", "line").mapInArrow(run, "key long, kind byte, h long, d long, t long, line_no int")


def _later_of_pairs(firsts: DataFrame, occurrences: DataFrame, docs: DataFrame, min_chars: int) -> DataFrame:
    """h of lines whose first place has an earlier line one edit away."""
    halves = occurrences.select("h", F.posexplode("keys").alias("k", "key"))
    shared = halves.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("key")
    shared = materialise(shared, "line-halves")
    # keys at even places are left halves: the edit is on the right, and the other way round
    sides = halves.join(_small(shared), "key", "left_semi").groupBy("h").agg(F.bool_or(F.col("k") % 2 == 0).alias("right"), F.bool_or(F.col("k") % 2 == 1).alias("left"))
    texts = materialise(_texts(docs, _small(materialise(sides, "line-sides")).join(firsts, "h"), min_chars), "line-texts")
    place = F.struct("d", "t", "line_no", "h")
    variants = _variants(texts)
    groups = variants.groupBy("key").agg(*(F.min(F.when(F.col("kind") == k, place)).alias(f"first{k}") for k in range(3)), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    met = variants.join(_small(materialise(groups, "line-variants")), "key")
    other = F.when(F.col("kind") == 0, F.col("first0")).when(F.col("kind") == 1, F.col("first2")).otherwise(F.col("first1"))
    pairs = met.select("h", place.alias("own"), other.alias("other")).filter("other < own and other.h <> h").select("h", F.col("other.h").alias("g")).distinct()
    one, two = texts.select("h", F.col("line").alias("x")), texts.select(F.col("h").alias("g"), F.col("line").alias("y"))
    return pairs.join(one, "h").join(two, "g").filter(F.levenshtein("x", "y", 1) == 1).select("h").distinct()


def kept_lines(docs: DataFrame, min_chars: int = 20, max_edits: int = 1) -> DataFrame:
    """(d, t, kept_lines): numbers of the lines that stay, per document with lines that are not blank."""
    if max_edits not in (0, 1):
        raise ValueError("the edit bound is 0 or 1")
    occurrences = materialise(_occurrences(docs, min_chars, max_edits), "line-occurrences")
    firsts = occurrences.groupBy("h").agg(F.min(F.struct(*POSITION)).alias("p")).select("h", "p.*")
    kept = firsts
    if max_edits:
        firsts = materialise(firsts, "line-firsts")
        later = materialise(_later_of_pairs(firsts, occurrences, docs, min_chars), "line-later")
        kept = firsts.join(_small(later), "h", "left_anti")
    return kept.groupBy("d", "t").agg(F.collect_list("line_no").alias("kept_lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, max_edits: int = 1, length_col: str | None = None) -> DataFrame:
    """docs with the removed lines cut from the text, n_lines and n_removed; length_col is brought up to date."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("d"),
        F.xxhash64(text_or_empty(text_col)).alias("t"),
        text_or_empty(text_col).alias("text"),
        *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names) if c not in (text_col, length_col)),
    )
    kept = kept_lines(keyed.select("d", "t", "text"), min_chars, max_edits)
    carried = [c for c in keyed.columns if c not in ("d", "t", "text")]
    types = {f.name: f.dataType.simpleString() for f in keyed.schema.fields}
    schema = ", ".join(["text string", "n_chars long", "n_lines long", "n_removed long", *(f"{c} {types[c]}" for c in carried)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part, rows = batch.slice(lo, ROWS_AT_ONCE), []
                for text, lines in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    stay, every, open_ = set(lines or ()), text.split("\n"), {k for k, _ in lines_of(text)}
                    out = [x for k, x in enumerate(every) if k not in open_ or k in stay]
                    new = "\n".join(out)
                    rows.append((new, len(new), len(every), len(every) - len(out)))
                new = _batch(rows, {"text": pa.string(), "n_chars": pa.int64(), "n_lines": pa.int64(), "n_removed": pa.int64()})
                yield pa.RecordBatch.from_arrays([*new.columns, *part.columns[2:]], names=[*new.schema.names, *carried])

    cut = keyed.join(kept, ["d", "t"], "left").select("text", "kept_lines", *carried).mapInArrow(run, schema)
    columns = [F.col("text" if c == text_col else "n_chars" if c == length_col else f"c{k}").alias(c) for k, c in enumerate(names)]
    return cut.select(*columns, F.col("n_lines").alias("n_lines"), F.col("n_removed").alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS raw FROM d),
n AS (SELECT doc_id, k, raw, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS x FROM l),
f AS MATERIALIZED (SELECT x, length(x) AS n, min(doc_id * 1000000 + k) AS p FROM n WHERE x <> '' GROUP BY x),
k AS MATERIALIZED (
  SELECT x, n, p, unnest(['P' || n || ' ' || left(x, n // 2), 'S' || n || ' ' || right(x, n - n // 2),
                          'P' || (n - 1) || ' ' || left(x, (n - 1) // 2), 'S' || (n - 1) || ' ' || right(x, n - 1 - (n - 1) // 2)]) AS key FROM f WHERE n >= 20),
near AS (
  SELECT DISTINCT b.x FROM k a JOIN k b ON a.key = b.key AND a.p < b.p
  WHERE CASE WHEN a.n = b.n THEN list_sum(list_transform(range(1, a.n + 1), lambda i: (a.x[i] <> b.x[i])::INT)) = 1
             WHEN a.n > b.n THEN list_bool_or(list_transform(range(1, a.n + 1), lambda i: left(a.x, i - 1) || substr(a.x, i + 1) = b.x))
             ELSE list_bool_or(list_transform(range(1, b.n + 1), lambda i: left(b.x, i - 1) || substr(b.x, i + 1) = a.x)) END),
kept AS (
  SELECT n.doc_id, n.k, n.raw FROM n LEFT JOIN f ON n.x = f.x
  WHERE f.x IS NULL OR (f.p = n.doc_id * 1000000 + n.k AND n.x NOT IN (SELECT x FROM near))),
t AS (SELECT doc_id, count(*) AS c, string_agg(raw, chr(10) ORDER BY k) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(c, 0))::BIGINT AS n_removed,
       length(coalesce(t.text, ''))::BIGINT AS n_chars, sha256(coalesce(t.text, '')) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
