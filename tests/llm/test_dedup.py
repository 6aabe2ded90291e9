import random

import pytest

from pagewright.llm import line_dedup, minhash_dedup
from pagewright.llm.components import components


def words(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in low.replace("\t", " ").replace("\n", " ").split(" ") if w]


def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(500)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE Two"), (4, "\t\n"), (None, "a b c d e f g"), (None, "A b c d e f g"), (5, "x " * 5000)]
    for g in range(6):
        base = [rng.choice(vocab) for _ in range(rng.choice([30, 100, 200]))]
        for k in range(rng.choice([2, 5, 30])):
            t = list(base)
            for _ in range(rng.randrange(1 + len(base) // 20)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((100 * g + k + 10, " ".join(t)))
    rows += rows[10:13]
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    got = minhash_dedup.near_duplicates(df, size=4, percent=80)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=str) == brute_components(rows, 4, 80)
    kept = minhash_dedup.keep_one(df, size=4, percent=80)
    assert kept.columns == df.columns
    heads = {c for d, _, c in brute_components(rows, 4, 80) if d is not None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == heads


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_dedup.near_duplicates(df).count() == 0
    one = minhash_dedup.near_duplicates(spark.createDataFrame([(7, "just one text here now")], df.schema)).first()
    assert (one.doc_id, one.component_id, one.kept) == (7, 7, True)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def brute_lines(rows, least, edits):
    def near(a, b):
        if a == b:
            return True
        if not edits or abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < least:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, seen = [], []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        kept = []
        for raw in (t or "").split("\n"):
            x = raw.strip(" \t\x0b\x0c\r")
            if x:
                gone = any(near(x, y) for y in seen)
                seen.append(x)
                if gone:
                    continue
            kept.append(raw)
        out.append((d, "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("edits", [0, 1])
def test_line_dedup(spark, edits):
    rng = random.Random(edits)
    pool = ["".join(rng.choice("abcé 漢") for _ in range(rng.randrange(1, 14))) for _ in range(12)]

    def variant():
        s = rng.choice(pool)
        i = rng.randrange(len(s) + 1)
        return rng.choice([s, s, s[:i] + s[i + 1 :], s[:i] + "x" + s[i:], s[:i] + "y" + s[i + 1 :], "  " + s + "\r"])

    rows = [(k, "\n".join(variant() for _ in range(rng.randrange(6)))) for k in range(40)] + [(90, None), (91, ""), (None, "abcabcabc\n\nabcabcabc"), (92, "z" * 3000 + "\n" + "z" * 2999)]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_removed int")
    got = line_dedup.dedup_lines(df, min_chars=5, max_edits=edits)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    found = got.collect()
    assert sorted([(r.doc_id, r.text) for r in found], key=str) == brute_lines(rows, 5, edits)
    assert all(r.n_lines - r.n_removed == len(r.text.split("\n")) for r in found if r.n_lines > r.n_removed)
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    rows = [(2, "same line\nown"), (2, "same line\nown"), (None, "same line\nlast"), (1, "same line")]
    got = line_dedup.dedup_lines(spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, new string, d int, kept_lines int")).collect()
    # repeated rows are one document; a null id comes last
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted([(1, "same line"), (2, "own"), (2, "own"), (None, "last")], key=str)
    assert {(r.new, r.d, r.kept_lines) for r in got} == {("x", 1, 2)}


def test_links_that_no_pivot_sees(spark, monkeypatch):
    # a chain: each text shares most with the next, little with those further on
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    monkeypatch.setattr(minhash_dedup, "GROUP", 2)
    words_ = [f"c{k}" for k in range(400)]
    rows = [(k, " ".join(words_[8 * k : 8 * k + 120])) for k in range(30)] + [(100 + k, " ".join(words_[8 * k : 8 * k + 121])) for k in range(0, 30, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_dedup.near_duplicates(df, size=4, percent=80)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=str) == brute_components(rows, 4, 80)


def test_blocks_see_the_same_pairs():
    import numpy as np

    rng = np.random.default_rng(2)
    sigs = [rng.integers(0, 3, 256, dtype=np.uint32) for _ in range(4)]
    nodes = [(k, k, 100 + k % 3, [k % 5, 10 + k % 2], sigs[k % 4].tobytes()) for k in range(24)]
    whole = {frozenset(r[:2]) for r in minhash_dedup._near_in_cluster([(*n, n[0] % 3, 0, 0) for n in nodes], 80, 128)}
    split = set()
    for i in range(3):
        for j in range(i, 3):
            some = [(*n, n[0] % 3, i, j) for n in nodes if n[0] % 3 in (i, j)]
            split |= {frozenset(r[:2]) for r in minhash_dedup._near_in_cluster(some, 80, 128)}
    assert whole == split and whole
