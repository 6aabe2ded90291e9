import difflib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pagewright.operators import discourse, linkage, network, pages, search, tables
from pagewright.plans import registry


def test_page_consensus_as_the_loop(spark):
    cand = [None if k % 7 == 3 else k + 310 if k % 11 == 5 else k + 12 if k % 5 == 1 else k + 10 for k in range(90)]
    votes = [(i, c - i) for i, c in enumerate(cand) if c is not None]
    mid = statistics.median(o for _, o in votes)
    votes = [v for v in votes if abs(v[1] - mid) <= 20]
    want = [i + int(statistics.median(o for _, o in sorted(votes, key=lambda v: (abs(v[0] - i), v[0]))[:7])) for i in range(90)]
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(cand)] + [(2, 0, None)], "k int, pos int, cand int")
    got = {(r.k, r.pos): r.page for r in pages.page_consensus(df, "k", "pos", "cand").collect()}
    assert [got[1, i] for i in range(90)] == want and got[2, 0] is None


def test_steady_runs(spark):
    # 53-58 read as 68 64 55 66 57 68, worked through by hand; and 350-352 read as 360 361 362 among right ones
    rows = [(1, 52 + i, r - 52 - i) for i, r in enumerate([52, 68, 64, 55, 66, 57, 68, 59, 60])]
    rows += [(2, p, (10 if 350 <= p <= 352 else 0)) for p in range(345, 358)]
    got = pages.steady_runs(spark.createDataFrame(rows, "k int, pos int, off int"), "k", "pos", "off").collect()
    assert {r.off for r in got if r.k == 2} == {0} and {r.pos for r in got if r.k == 2} == {*range(345, 350), *range(353, 358)}
    assert {(r.pos, r.off) for r in got if r.k == 1} == {(54, 10), (56, 10), (58, 10), (59, 0), (60, 0)}
    assert pages.steady_runs(spark.createDataFrame([], "k int, pos int, off int"), "k", "pos", "off").count() == 0


def test_restarts_islands_and_merge(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([5, 6, 1, None, 2, 3, 1, 9])], "k int, pos int, v int")
    assert [r.run for r in pages.restart_runs(df, "k", "pos", "v").orderBy("pos").collect()] == [0, 0, 1, 1, 1, 1, 1, 1]
    runs = pages.islands(df.filter("v is not null"), "k", "v").orderBy("first").collect()
    assert [(r["first"], r["last"], r.n) for r in runs] == [(1, 3, 3), (5, 6, 2), (9, 9, 1)]
    paras = spark.createDataFrame([(1, 0, "and so"), (1, 1, "on we"), (1, 2, "Then"), (1, 3, "it ended")], "k int, p int, t string")
    merged = pages.merge_continued(paras, "k", "p", "t", F.col("t").rlike("^[a-z]")).orderBy("para").collect()
    assert [m.t for m in merged] == ["and so on we", "Then it ended"]


def test_sentences_keep_abbreviations(spark):
    df = spark.createDataFrame([(1, "Fr. Ryan, S. J. Came here. Then he left! \"So\" it was.")], "id int, text string")
    got = [r.text for r in pages.sentences(df, ["id"], "text").orderBy("sent").collect()]
    assert got == ["Fr. Ryan, S. J. Came here.", "Then he left!", "\"So\" it was."]


def test_near_duplicate_window(spark):
    rows = [("i", 1, "ABCDEFGHIJ" * 20), ("i", 10, "XYZ" * 60), ("i", 25, "ABCDEFGHIJ" * 19 + "ABCDEFGHIX"), ("i", 70, "ABCDEFGHIJ" * 20), ("i", 71, "")]
    got = pages.near_duplicate_window(spark.createDataFrame(rows, "k string, pos int, s string"), "k", "pos", "s").collect()
    assert [(r.pos, r.like) for r in got] == [(25, 1)]


def test_near_duplicate_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("source", "doc_id").collect():
        rows.setdefault(r.source, []).append("".join(c for c in (r.text or "").upper().replace("ß", "SS") if "A" <= c <= "Z")[:240])
    want = set()
    for source, sigs in rows.items():
        for k, sig in enumerate(sigs):
            like = [j for j in range(max(0, k - 30), k) if len(sig) > 120 and difflib.SequenceMatcher(None, sig, sigs[j], autojunk=False).ratio() > 0.9]
            want |= {(source, k + 1, like[0] + 1)} if like else set()
    got = {(r.source, r.pos, r.like) for r in registry.QUERIES["near_duplicate_window"](spark, sf).collect()}
    assert got == want


def test_person_mentions(spark):
    text = "Father Sabetti met Fr. J. J. Ryan and Cardinal Gibbons; Pope Pius X spoke. Father General and Father Rector De Smet came."
    df = spark.createDataFrame([(1, text), (2, None)], "id int, t string")
    got = {(r.cls, r.surname, r.first) for r in network.person_mentions(df, ["id"], "t", offices=["General", "Rector"]).collect()}
    assert got == {("father", "Sabetti", ""), ("father", "Ryan", "J"), ("prelate", "Gibbons", ""), ("pope", "Pius X", ""), ("father", "De Smet", "")}


def test_pair_edges_discount_lists(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "a"), (3, "d")], "p int, i string")
    got = {(r.s, r.t): (r.f, r.w, r.fs, r.ft, r.baskets) for r in network.pair_edges(df, "p", "i").collect()}
    assert got[("a", "b")] == (2, 1.5, 2, 2, 3) and got[("b", "c")] == (1, 0.5, 2, 1, 3)


def test_generator(spark):
    row = spark.range(1).select(*(discourse.generator_value(F.lit(k).cast("bigint")).alias(f"k{k}") for k in (1, 2, 3, 5000))).first()
    s, out = 7, []
    for _ in range(5000):
        s = s * 16807 % 2147483647
        out.append(s)
    assert list(row) == [out[0], out[1], out[2], out[4999]] and out[:3] == [117649, 1977326743, 621132276]


def test_bootstrap_bands_as_the_loop(spark):
    groups = {"a": [(1.0, 2), (5.0, 1), (9.0, 4)], "b": [(3.0, 1)], "c": [(2.0, 1), (4.0, 3)]}
    s, want = 7, {}
    for g in sorted(groups):
        rows = groups[g]
        if len(rows) < 2:
            continue
        means = []
        for _ in range(200):
            pick = []
            for _ in rows:
                s = s * 16807 % 2147483647
                pick.append(rows[s * len(rows) // 2147483647])
            means.append(sum(v * w for v, w in pick) / sum(w for _, w in pick))
        means.sort()
        want[g] = (means[10], means[189])
    df = spark.createDataFrame([(g, i, v, w) for g, rows in groups.items() for i, (v, w) in enumerate(rows)], "g string, i int, v double, w int")
    got = {r.g: (r.lo, r.hi) for r in discourse.bootstrap_bands(df, ["g"], "i", "v", "w").collect()}
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g]) for g in want)


def test_kwic_and_phrase(spark):
    df = spark.createDataFrame([(1, "one Two three two THREE four"), (2, "")], "id int, t string")
    words = search.postings(df, "id", "t")
    assert [r.pos for r in search.phrase(words, "id", ["two", "three"]).orderBy("pos").collect()] == [1, 3]
    found = search.hits(df, "id", "t", ["two", "three"])
    assert [(r["first"], r["last"]) for r in found.collect()] == [(1, 4)]
    line = search.kwic(df, "id", "t", ["two", "three"], around=1).first()
    assert (line.left, line.hit, line.right) == ("one", "Two three two THREE", "four")


def test_fuzzy_join_and_linkage(spark):
    e = spark.createDataFrame([(1, 5, ["Maryland", "of"]), (2, 6, ["Jamaica"])], "entry int, page int, words array<string>")
    p = spark.createDataFrame([(5, 0, ["Other"]), (5, 1, ["Marvland"]), (6, 0, ["Ceylon"])], "page int, seq int, words array<string>")
    assert [tuple(r) for r in linkage.fuzzy_page_join(e, p, "entry", "page").collect()] == [(1, 5, 1)]


def test_index_edits(spark):
    """Updates take the first entry with a prefix of any length, additions come after, drops take all."""
    entries = spark.createDataFrame([(1, "Obit of A", "x"), (2, "Obit of B", "y"), (3, "Manila, Letter", None), (4, "Plain", None)], "ord int, entry string, author string")
    updates = spark.createDataFrame([(1, "Obit", "Obituary of A", None), (2, "Obit of A", None, "Fr. Z"), (3, "Man", "Manila", "Br. M"), (4, "Nothing here", "y", None)], "edit int, prefix string, entry string, author string")
    added = spark.createDataFrame([(9, "Plainly added")], "ord int, entry string")
    drops = spark.createDataFrame([("Pl",), ("No",)], "prefix string")
    out, unmet = linkage.index_edits(entries, updates, added, drops)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "Obituary of A", "Fr. Z"), (2, "Obit of B", "y"), (3, "Manila", "Br. M")]
    assert sorted(tuple(r) for r in unmet.collect()) == [("drop", "No"), ("update", "Nothing here")]
    assert linkage.index_edits(entries)[0].count() == 4 and linkage.index_edits(entries.limit(0), updates)[1].count() == 4


def test_basket_edges_as_pair_edges(spark):
    rng = random.Random(3)
    baskets = [(k, sorted({rng.choice("abcdefgh") for _ in range(rng.randrange(5))})) for k in range(60)]
    df = spark.createDataFrame(baskets, "p int, i array<string>")
    kept = spark.createDataFrame([(x,) for x in "abcdef"], "item string")
    flat = df.select("p", F.explode("i").alias("item"))
    want = {(r.s, r.t): (r.f, round(r.w, 9), r.fs, r.ft, r.baskets) for r in network.pair_edges(flat, "p", "item", 2, kept).collect()}
    got = {(r.s, r.t): (r.f, round(r.w, 9), r.fs, r.ft, r.baskets) for r in network.basket_edges(df, "i", list("abcdef"), 2).collect()}
    assert got == want and len(got) > 5


def test_fuzzy_join_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé😀") for _ in range(rng.randrange(2, 9)))
    entries = [(k, k % 3, [word() for _ in range(rng.randrange(3))]) for k in range(60)]
    pages = [(k % 3, k, [word() for _ in range(rng.randrange(4))]) for k in range(90)]
    close = lambda x, y: len(x) >= 4 and len(y) >= 4 and difflib.SequenceMatcher(None, y, x).ratio() >= 0.75
    want = []
    for e, p, own in entries:
        seqs = [s for q, s, theirs in pages if q == p and any(close(x, y) for x in own for y in theirs)]
        want += [(e, p, min(seqs))] if seqs else []
    e = spark.createDataFrame(entries, "entry int, page int, words array<string>")
    p = spark.createDataFrame(pages, "page int, seq int, words array<string>")
    assert sorted(tuple(r) for r in linkage.fuzzy_page_join(e, p, "entry", "page").collect()) == want and 10 < len(want) < 60


def test_fuzzy_query_against_brute_force(spark, tmp_path):
    long = "rome " + "x " * 50  # 105 characters
    docs = [(1, "src1", "en", "Nothing here\nTHE " + "A " * 60 + "GENOA\n" + "the " + "a " * 60 + "milan"), (2, "src1", "en", long), (3, "src2", "en", "pisa\nPISE")]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "Genoa"), (21, "Rome."), (41, "Milan"), (2, "Pise"), (22, "of it")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.QUERIES["fuzzy_page_join"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(1, "1", 1, 1), (2, "2", 3, 0), (21, "1", 2, 0)]


def test_repair(spark):
    ref = spark.createDataFrame([("them", 6.0), ("fact", 5.0), ("lancy", 1.0)], "term string, zipf double")
    toks = spark.createDataFrame([("thern",), ("fadl",), ("thern",), ("keep",), ("eye",)], "w string")
    found = tables.repair_candidates(toks, "w", ref)
    fixed = tables.repair(toks, "w", found, fix={"eye": "aye"}, keep=["keep"])
    assert sorted(tuple(r) for r in tables.repair_log(fixed, "w").collect()) == [("eye", "aye", 1), ("fadl", "fact", 1), ("thern", "them", 2)]
