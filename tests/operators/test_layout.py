from pyspark.sql import functions as F

from pagewright.operators import layout as L


def frame(spark, pages):
    return spark.createDataFrame([("a", i, p) for i, p in enumerate(pages)], "k string, pos int, page int")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_inserts_and_fills(spark):
    df = frame(spark, [None, 282, None, None, 283, None, 285, None, 290, None])
    assert rows(L.inserts(df, "k", "pos", "page"), "pos", "after") == [(2, 282), (3, 282)]
    assert rows(L.gap_fills(df, "k", "pos", "page"), "pos", "page") == [(5, 284)]
    tail = L.trailing(frame(spark, [1, 2, None, None]), "k", "pos", "page", F.col("pos") == 2, F.lit(True))
    assert [(r.pos, r.kind, r.page) for r in tail.orderBy("pos").collect()] == [(2, "plate", None), (3, "text", 4)]
    assert L.inserts(df.limit(0), "k", "pos", "page").count() == 0


def test_sections(spark):
    df = spark.createDataFrame([("a", i, c, i >= 6) for i, c in enumerate([100, 101, None, 103, 104, 105, 1, 2, 3])] + [("b", i, 50 + i, i >= 3) for i in range(6)], "k string, pos int, cand int, sec boolean")
    assert rows(L.goes_on_numbering(df, "k", "pos", "cand", F.col("sec")), "k", "goes_on") == [("a", False), ("b", True)]
    assert rows(L.section_votes(df, "k", F.col("sec"), F.col("cand") < 4, F.col("cand") > 99), "k", "starred", "roman") == [("a", True, False), ("b", True, False)]
    lone = spark.createDataFrame([("a", 0, 453, 453, 0), ("a", 1, 455, None, 1), ("a", 2, 499, None, 0)], "k string, pos int, cand int, page int, blanks int")
    assert rows(L.lone_readings(lone, "k", "pos", "cand", "page", "blanks"), "pos", "page") == [(1, 455)]


def test_labels_and_fronts(spark):
    df = spark.createDataFrame([("a", i, lab, like) for i, (lab, like) in enumerate([(None, True), ("29", True), (None, True), (None, False), (None, True), ("30", False), (None, True)])], "k string, pos int, lab string, like boolean")
    got = L.carried_label(df, "k", "pos", "lab", F.col("like")).orderBy("pos").collect()
    assert [r.carried for r in got] == [None, "29", "29", None, None, "30", "30"]
    assert [r.front for r in L.before_last_head(df, "k", "pos", F.col("lab").isNotNull(), within=4).orderBy("pos").collect()] == [True] + [False] * 6
    ranges = spark.createDataFrame([("v", 1, 1, 80, 2), ("v", 2, 83, 160, 1), ("v", 3, 160, 200, 0)], "k string, no int, lo int, hi int, tail int")
    assert rows(L.room_before_next(ranges, "k", "no", "hi", "lo", "tail"), "no", "verdict") == [(1, "text"), (2, "insert"), (3, "text")]


def test_titles(spark):
    df = spark.createDataFrame([("a", 0, "s", True, "TITLE"), ("a", 1, None, True, "LINE"), ("a", 2, None, False, "prose"), ("a", 3, None, True, "HEAD"), ("a", 4, "s", True, "NEXT")], "k string, pos int, st string, h boolean, t string")
    assert rows(L.title_blocks(df, "k", "pos", F.col("st").isNotNull(), F.col("h"), "t"), "pos", "title") == [(0, "TITLE · LINE"), (4, "NEXT")]
    names = spark.createDataFrame([("Fr. John Cunningham.", "p" * 200, "end."), ("Fr. John Cunningham.", "p" * 200, "Yours,"), ("Fr. John came.  It was", "p" * 200, ""), ("Mr. X Y.", "short", None)], "t string, n string, b string")
    assert [r[0] for r in names.select(L.name_line(F.col("t"), F.col("n"), F.col("b"))).collect()] == [True, False, False, False]
