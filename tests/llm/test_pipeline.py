import hashlib

import duckdb
import pytest

import corpus_pipeline
from pagewright.llm import bpe, registry

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = docs.checkpoint() if spark.sparkContext.getCheckpointDir() else docs
        rows = docs.collect()
        counts.append(len(rows))
        assert all(r.n_chars == len(r.text) for r in rows)
    assert counts[0] > counts[1] == counts[2] >= counts[3] >= counts[4] > 0
    encoder = bpe.WordBpe(bpe.default_vocabulary())
    texts = {r.doc_id: r.text for r in rows}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == set(texts)
    for r in out:
        ids = encoder.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(encoder.decode(ids).encode()).hexdigest()


def test_line_stage_removes_short_repeats(spark):
    long = "a line of more than twenty characters"
    texts = ["Short.\n\nOther\n" + long, " Short.\r\n\nShort!\n" + long + "s\nOther", "Other", None]
    docs = spark.createDataFrame([(k, t, "en", "src1", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_stage(spark, docs, SF).collect()}
    want = ["Short.\n\nOther\n" + long, "\nShort!", "", ""]
    assert got == {k: (t, len(t)) for k, t in enumerate(want)}


def test_stages_on_odd_rows(spark):
    """Nulls, repeated rows and further columns of clashing names pass through every stage but the last."""
    good = "The committee met on the first day of the month, and all of its members agreed on the plan of the year."
    rows = [(1, good, "en", "src1", len(good), 1, 2, 3), (1, good, "en", "src1", len(good), 1, 2, 3), (None, good + " So it did.", None, None, None, 1, 2, 3), (3, None, "en", "src2", 0, 1, 2, 3), (4, "", None, "src3", 0, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_removed int, kept int, component_id int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert [c for c in out.columns if c != "n_removed"] == [c for c in docs.columns if c != "n_removed"], name
        assert len(out.collect()) <= len(rows)


def test_near_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r.doc_id: shingle_set(r.text or "", 5) for r in docs.collect()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 10 * n >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect()}
    assert kept == {find(d) for d in ids}


def shingle_set(text, size):
    w = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(registry.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[k]) for k in at) for r in want.fetchall())
