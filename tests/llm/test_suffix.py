import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import suffix_dedup
from pagewright.llm.suffix_array import common_prefixes, suffix_array

SF = "/root/testdata/sf0.001"


def test_suffix_array_against_sorting():
    rng = random.Random(4)
    for _ in range(2000):
        s = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(40))] * rng.choice([1, 1, 3])
        sa = suffix_array(s)
        assert sa == sorted(range(len(s)), key=lambda i: s[i:])
        lcp = common_prefixes(s, sa, 10)
        for k in range(1, len(sa)):
            a, b = s[sa[k - 1] :], s[sa[k] :]
            n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert lcp[k] == min(n, 10)


def passages(rows, size):
    """(doc_id, runs of words covered by repeated word windows, words in them)."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[p : p + size]) for _, w in words for p in range(len(w) - size + 1))
    out = []
    for i, w in words:
        hit = [False] * (len(w) + 1)
        for p in range(len(w) - size + 1):
            if seen[tuple(w[p : p + size])] > 1:
                hit[p : p + size] = [True] * size
        out.append((i, sum(b and not a for a, b in zip([False, *hit], hit)), sum(hit)))
    return sorted(out, key=str)


def brute(rows, size):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + size] for _, b in raw for p in range(len(b) - size + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, size):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted([tuple(r) for r in suffix_dedup.remove_repeats(df, size, digests_only=True).collect()], key=str)


def made_up(seed, size):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))
    text = lambda n: "".join(word() for _ in range(n))
    passages = [text(rng.randrange(size // 4, size)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "a" * (3 * size)), (4, "a" * (size - 1)), (5, "ab" * size), (None, text(60))]
    for i in range(10, 60):
        rows.append((i, "".join(rng.choice([text(rng.randrange(40)), rng.choice(passages), rng.choice(passages)[rng.randrange(20) :]]) for _ in range(rng.randrange(1, 6)))))
    return rows + rows[12:20] + [(200 + i, t) for i, (_, t) in enumerate(rows[15:25])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_made_up_repeats(spark, seed):
    rows = made_up(seed, 100)
    assert run(spark, rows, 100) == brute(rows, 100)


def test_hot_groups_and_small_batches(spark, monkeypatch):
    for name, value in (("HOT", 1), ("BATCH_BYTES", 150), ("ARRAY_BYTES", 300)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = made_up(7, 100)
    assert run(spark, rows, 100) == brute(rows, 100)


def test_passages(spark):
    rows = [(i, t and " ".join(t)) for i, t in made_up(9, 60)]  # a word a letter
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 100, passage_words=30).collect()
    assert sorted([(r.doc_id, r.n_passages, r.n_passage_words) for r in got], key=str) == passages(rows, 30)
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == brute(rows, 100)


def test_windows_that_only_suffix_order_finds():
    rng = random.Random(2)
    parts = [bytes(rng.choices(b"ab", k=rng.randrange(40, 90))) for _ in range(60)]
    parts = list(dict.fromkeys(parts + [p[5:45] for p in parts[:20]]))
    seen = Counter(p[k : k + 12] for p in parts for k in range(len(p) - 11))
    got = suffix_dedup.repeated_windows([np.frombuffer(p, np.uint8) for p in parts], [0] * len(parts), 12)
    assert [f.tolist() for f in got] == [[seen[p[k : k + 12]] > 1 for k in range(len(p) - 11)] for p in parts]


def test_windows_around_anchors_by_cells():
    rng = random.Random(6)
    sides = [bytes(rng.choices(b"ab", k=120)) for _ in range(4)]
    parts, anchors = [], []
    for _ in range(80):
        left, right = rng.choice(sides)[rng.randrange(60) :], rng.choice(sides)[: rng.randrange(60, 121)]
        if rng.random() < 0.5:
            k = rng.randrange(len(left))
            left = left[:k] + b"c" + left[k + 1 :]
        parts.append(left + b"anchor" + right)
        anchors.append(len(left))
    parts, anchors = zip(*dict(zip(parts, anchors)).items())
    for size in (64, 70, 71, 96):
        seen = Counter(p[k : k + size] for p in parts for k in range(len(p) - size + 1))
        got = suffix_dedup.repeated_windows([np.frombuffer(p, np.uint8) for p in parts], list(anchors), size)
        for p, a, f in zip(parts, anchors, got, strict=True):
            whole = [k for k in range(len(p) - size + 1) if k <= a and k + size >= a + 6]  # windows around the anchor
            assert [bool(f[k]) for k in whole] == [seen[p[k : k + size]] > 1 for k in whole]


def test_rows_met_again():
    a, b = np.array([1, 1, 2, 1, 3]), np.array([5, 6, 5, 5, 5], np.uint64)
    assert suffix_dedup._met_again([a, b]).tolist() == [True, False, False, True, False]


def test_equal_windows_are_compared_by_symbols():
    text = np.array(list(b"abcabcabdabcabc"), np.int64)
    pairs = [(a, b) for a in range(1, 12) for b in range(a)]
    one, two = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    want = [text[a : a + 4].tolist() == text[b : b + 4].tolist() for a, b in pairs]
    assert suffix_dedup._equal(text, one, two, 4).tolist() == want


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = suffix_dedup.op6_suffix_dedup(spark, SF).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute(rows, 400)
    assert sorted([(r.doc_id, r.n_passages, r.n_passage_words) for r in got], key=str) == passages(rows, 51)
    empty = suffix_dedup.remove_repeats(docs.limit(0), passage_words=51)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans", "n_passages", "n_passage_words"]


def test_clashing_columns(spark):
    rows = [(1, "x" * 300, 1, 2), (2, "x" * 300, 1, 2), (2, "x" * 300, 1, 2)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_bytes long, spans long"), 100).collect()
    assert [(r.n_bytes, r.n_removed, r.spans[0].hi) for r in got] == [(300, 300, 300)] * 3
