"""Steps whose work must grow with their input, on rows enough to tell."""

import random
import time

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import articles, layout, linkage, network, pages, search
from pagewright.plans import registry

SF = "/root/testdata/sf0.001"


def seconds(df):
    start = time.time()
    return df.collect(), time.time() - start


def test_sentences_of_a_long_text(spark):
    """A text of 12,000 sentences; each piece used to read the whole text again."""
    text = "Fr. Ryan came to it. He left! " * 6_000
    rows, took = seconds(spark.createDataFrame([(1, text)], "id int, text string").select(F.size(T.sentences(F.col("text"))).alias("n"), T.sentences(F.col("text"))[0].alias("s")))
    assert rows[0].n == 12_000 and rows[0].s == "Fr. Ryan came to it." and took < 30
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "J. J. Ryan, p. A"), (4, "No. A. B␟C")], "id int, text string")
    assert [(r.id, r.sent, r.text) for r in pages.sentences(odd, ["id"], "text").orderBy("id", "sent").collect()] == [(2, 1, ""), (3, 1, "J. J. Ryan, p. A"), (4, 1, "No. A. B"), (4, 2, "C")]


def test_pairs_are_read_from_one_stored_table(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["b", "a", "a"],), (["x"],), ([],), (None,)], "i array<string>")
    pairs = network.basket_pairs(df, "i", ["a", "b", "c"])
    assert {(r.s, r.t): r.f for r in pairs.collect()} == {("", ""): 3, ("a", "a"): 2, ("b", "b"): 2, ("c", "c"): 1, ("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert {r.item: r.n for r in network.pair_counts(pairs).collect()} == {"a": 2, "b": 2, "c": 1}
    assert network.basket_edges(df, "i", []).count() == 0


def test_neighbours_of_one_long_run(spark):
    """Forty thousand leaves of one run; those from a row on used to be read again for each row."""
    rows = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id").alias("pos"), F.when(F.col("id") % 10_000 == 0, F.col("id")).alias("page"))
    got, took = seconds(pages.nearest_anchor(rows, "k", "pos", "page").filter("pos in (4999, 5000, 5001, 39999)").orderBy("pos").select("anchor"))
    assert [r.anchor for r in got] == [0, 0, 10_000, 30_000] and took < 20
    got, took = seconds(layout.between_read(rows, "k", "pos", "page").filter("pos in (10000, 10001, 30000)").orderBy("pos").select("before_page", "after_page"))
    assert [tuple(r) for r in got] == [(0, 20_000), (10_000, 20_000), (20_000, None)] and took < 20


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_broadcast_of_rows_that_grow(spark):
    """Draws are rows times 200, and every issue has a row: the planner takes them for small and sent them to the driver."""
    for name in ("bootstrap_band", "layout_rules"):
        plan = planned(registry.QUERIES[name](spark, SF))
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_articles_beyond_page_999(spark):
    """Ids have three places of the page; articles with like ids stay apart."""
    rows = [(1, "i", k, 1_000 + k // 2, title, True, "title-page") for k, title in ((0, "THE QUICK FOXES"), (2, "A LAZY DOG"), (4, "NINE BLUE JUGS"))]
    rows += [(1, "i", k, 1_000 + k // 2, "prose", False, None) for k in (1, 3, 5)]
    done = articles.assign_articles(spark.createDataFrame(rows, "vol int, issue string, seq int, page int, t string, is_head boolean, start string"))
    assert sorted((r.article, r.p0, r.paragraphs) for r in articles.article_ranges(done).collect()) == [("1-100", 1_000, 2), ("1-100", 1_001, 2), ("1-100", 1_002, 2)]
    merged = articles.merge_articles(done, spark.createDataFrame([(1, 2)], "vol int, opened int"))
    assert sorted((r.opened, r["count"]) for r in merged.groupBy("opened").count().collect()) == [(0, 4), (4, 2)]


def loop(offs, sizes):
    """The first transient run goes, again and again."""
    runs = [(o, s, [i]) for i, (o, s) in enumerate(zip(offs, sizes, strict=True))]
    while True:
        for k, (_, n, _) in enumerate(runs):
            beside = [runs[j][1] for j in (k - 1, k + 1) if 0 <= j < len(runs)]
            between = 0 < k < len(runs) - 1 and runs[k - 1][0] == runs[k + 1][0] and n < sum(beside)
            if between or (n == 1 and max(beside, default=0) > 1):
                break
        else:
            return [any(i in own for _, _, own in runs) for i in range(len(offs))]
        del runs[k]
        if 0 < k < len(runs) and runs[k - 1][0] == runs[k][0]:
            runs[k - 1 : k + 1] = [(runs[k][0], runs[k - 1][1] + runs[k][1], runs[k - 1][2] + runs[k][2])]


def test_steady_runs_as_the_loop(spark):
    rng = random.Random(4)
    for _ in range(400):
        offs = [rng.randrange(4)]
        while len(offs) < rng.randrange(1, 12):
            offs.append((offs[-1] + rng.randrange(1, 4)) % 4)
        sizes = [rng.choice([1, 1, 1, 2, 3]) for _ in offs]
        assert pages.steady(offs, sizes, [True] + [False] * (len(offs) - 1)) == loop(offs, sizes)
    # 60,000 readings of one run, every third of them off; and many keys over several batches
    rows = spark.range(60_000).select(F.lit(1).alias("k"), F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("off"))
    got, took = seconds(pages.steady_runs(rows, "k", "pos", "off").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("m")))
    assert (got[0].n, got[0].m) == (40_000, -1) and took < 20
    many = spark.range(50_000).select((F.col("id") % 7_000).cast("string").alias("k"), F.col("id").alias("pos"), F.when(F.floor(F.col("id") / 7_000) == 2, 9).otherwise(1).alias("off"))
    assert pages.steady_runs(many, "k", "pos", "off").count() == 43_000


def test_hits_as_terms(spark):
    """Words are matched as they stand; the terms of all words, folded, tell which must be met."""
    odd = ["Whtion", "w-h(ti", "xwhti", "WH´TI", "ẂHTÏ", "ẃhti", "ébwhti", "é whti", "he'st", "«HEST»", "́ hest", "whé hest-", "ohne", "", "wh ti", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "id int, t string")
    words = search.postings(df, "id", "t").collect()
    want = {(r.id, r.pos) for r in words if r.term.startswith(("whti", "hest"))}
    got = {(r.id, p) for r in search.hits(df, "id", "t", ["whti", "hest"]).collect() for p in range(r["first"], r["last"] + 1)}
    assert got == want and len(want) == 9
    assert {r.id for r in search.with_a_hit(df, "t", ["whti", "hest"]).collect()} == {i for i, _ in want}
    assert search.hits(df, "id", "t", []).count() == 0


def test_hits_of_a_long_text(spark):
    """All of a million words; each of them used to be folded."""
    df = spark.createDataFrame([(1, "The plain word. " * 330_000 + "hest")], "id int, t string")
    got, took = seconds(search.hits(df, "id", "t", ["hest"]))
    assert [tuple(r) for r in got] == [(1, 990_000, 990_000)] and took < 20


def test_link_between_as_pairs(spark):
    rng = random.Random(7)
    persons = [(i, rng.randrange(3), rng.randrange(-50, 900) / 100) for i in range(300)] + [(900, None, 1.0), (901, 1, None)]
    records = [(i, rng.randrange(3), rng.randrange(0, 900) / 100) for i in range(40)] + [(99, 1, None)]
    p = spark.createDataFrame(persons, "pid long, stem int, a double")
    r = spark.createDataFrame(records, "rid long, stem int, b double")
    want = linkage.link_persons(p, r, F.col("a") > F.col("b"), F.col("b") >= F.col("a") - 1.5, F.col("rid") % 2 == 0)
    got = linkage.link_between(p.select("pid", "stem", (F.col("a") - 1.5).alias("lo"), F.col("a").alias("hi")), r.select("rid", "stem", F.col("b").alias("at"), (F.col("rid") % 2 == 0).alias("preferred")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    # 1.6 thousand million pairs, were they made
    many = spark.range(40_000)
    got, took = seconds(linkage.link_between(many.select(F.col("id").alias("pid"), F.lit(1).alias("stem"), F.col("id").alias("lo"), (F.col("id") + 1).alias("hi")), many.select(F.col("id").alias("rid"), F.lit(1).alias("stem"), F.col("id").alias("at"), F.lit(False).alias("preferred"))).agg(F.count_if(F.col("pid") == F.col("rid")).alias("n")))
    assert got[0].n == 40_000 and took < 20


def test_near_duplicates_stream(spark):
    """Random letters in runs longer than a batch, some again within the window; pairs of one run were 60,000 rows of two texts."""
    rng = random.Random(9)
    sigs = ["".join(rng.choice("ABCDEFGHIKLMNOPQ") for _ in range(192)) for _ in range(3_000)]
    for k in range(100, 3_000, 100):
        sigs[k] = sigs[k - 7 if k % 200 else k - 31][:100] + "XYZ" + sigs[k - 7 if k % 200 else k - 31][103:]
    df = spark.createDataFrame([("a", k, x) for k, x in enumerate(sigs)] + [("b", 5, sigs[0]), (None, 6, sigs[0]), ("b", 6, None)], "k string, pos int, s string")
    got, took = seconds(pages.near_duplicate_window(df, "k", "pos", "s"))
    assert sorted((r.k, r.pos, r.like) for r in got) == [("a", k, k - 7) for k in range(100, 3_000, 200)] and took < 30


def test_shares_of_tasks_stay(spark):
    """The parts that order operators work on grow in number with the parts that are read; islands count repeated values once."""
    rows = spark.range(0, 6_000, 1, 20).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 6).alias("v"))
    assert pages.spread(rows, "k").rdd.getNumPartitions() == 160
    some = rows.filter("v <> 500").unionByName(rows.limit(1)).unionByName(spark.createDataFrame([(1, None)], "k long, v long"))
    assert sorted((r.k, r["first"], r["last"], r.n) for r in pages.islands(some, "k", "v").collect()) == sorted((k, a, b, b - a + 1) for k in range(3) for a, b in ((0, 499), (501, 999)))
    edges = network.pair_edges(rows.unionByName(spark.createDataFrame([(None, 1), (None, 2)], "k long, v long")).filter("v < 3"), "k", "v")
    assert {(r.s, r.t): r.f for r in edges.collect()} == {(0, 1): 3, (0, 2): 3, (1, 2): 3}
