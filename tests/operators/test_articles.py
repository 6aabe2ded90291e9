from pyspark.sql import functions as F

from pagewright.functions import repair as R
from pagewright.operators import articles as A


def values(spark, f, items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_repairs(spark):
    assert values(spark, R.ordinal, ["io6th", "i6tli", "16th", "th"]) == ["106th", "16th", None, None]
    assert values(spark, R.ligature, ["fa6l", "subje6ted", "06lober", "io6th", "plain"]) == ["fact", "subjected", "October", None, None]
    assert values(spark, R.misread_years, ["in i898 and i8gg", "igo6", None]) == ["in 1898 and 1899", "1906", None]
    assert values(spark, R.join_years, ["1 861", "EXECUTI0N", "VVhitemarsh"]) == ["1861", "EXECUTION", "Whitemarsh"]
    assert values(spark, R.drop_signature, ["the end. Vol. XXIX. No. i. 2"]) == ["the end."]
    six = lambda x: R.accented_six(x, F.when(x == "subje6", 4.0), F.when(x == "th6", 7.0))
    assert values(spark, six, ["Jos6", "Le6n", "th6", "subje6", "tb6k", "ij6o"]) == ["José", "León", "the", "subject", None, None]
    assert values(spark, R.title_case, ["THE DEATH OF PIUS IX.", "THE 16th DAY", "MCDONALD, S. J.", None]) == ["The Death of Pius IX", "The 16th Day", "McDonald, S. J", None]
    assert values(spark, R.strip_marks, ["Notes from Vigan^^", "Plain"]) == ["Notes from Vigan", "Plain"]
    assert values(spark, R.spoiled, ["D U R a N Q U E T", "Refu(ie", "A R ILLATION", "A Relation"]) == [True, True, True, False]
    assert values(spark, R.inverted, ["Holland, The Province of", "Letters of", "The Union"]) == [True, True, False]


def test_hyphens(spark):
    t, f = F.lit(True), F.lit(False)
    row = spark.createDataFrame([("some", "thing", "BALTI", "MORE", "J", "F")], "a string, b string, c string, d string, e string, g string").select(
        R.join_hyphen(F.col("a"), F.col("b"), f, f, f).alias("x"), R.join_hyphen(F.col("a"), F.col("b"), f, t, t).alias("y"), R.join_hyphen(F.col("c"), F.col("d"), t, f, f).alias("z"), R.join_hyphen(F.col("e"), F.col("g"), t, t, t).alias("w")
    ).first()
    assert tuple(row) == ("something", "some-thing", "BALTIMORE", "J- F")
    assert [(p.a, p.b) for p in values(spark, R.hyphen_pairs, ["a some- thing and re- read"])[0]] == [("some", "thing"), ("re", "read")]


def test_heads(spark):
    rows = [["21 8 THE UNION", "x"], ["1 68"], ["BOSTON, MASS. 1 868-1 876.", "y"], ["THE UNION OF ALL", "218", "text"], ["12", "THE UNION", "text"], ["THE UNION 12"], ["plain prose here"], []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, lines array<string>")
    got = [(r.h.title, r.h.cand, r.h.used) for r in df.select("i", A.split_head(F.col("lines")).alias("h")).orderBy("i").collect()]
    assert got[0] == ("THE UNION", 218, 1) and got[1] == ("", 168, 1) and got[2] == (None, None, 0)
    assert got[3] == ("THE UNION OF ALL", 218, 2) and got[4] == ("THE UNION", 12, 2) and got[5] == ("THE UNION", 12, 1) and got[6:] == [(None, None, 0)] * 2
    romans = spark.createDataFrame([(0, ["V"]), (1, ["JOSEPH P., S. J.", "VI"]), (2, ["THE LIFE iV"]), (3, ["none"])], "i int, lines array<string>")
    assert [r.h.n for r in romans.select("i", A.roman_head(F.col("lines")).alias("h")).orderBy("i").collect()] == [5, 6, 4, None]
    f = A.leaf_features(spark.createDataFrame([(0, ["12", "THE UNION", "p" * 300]), (1, ["short"]), (2, [])], "i int, lines array<string>")).orderBy("i").collect()
    assert [(r.head, r.cand, r.chars, r.text) for r in f] == [("THE UNION", 12, 300, True), (None, None, 5, False), (None, None, 0, False)]


def paras(spark):
    rows = [
        (1, "a", 0, 3, "stray", False, None), (1, "a", 1, 5, "THE NATCHEZ INDIANS", True, "title"), (1, "a", 2, 5, "body", False, None), (1, "a", 3, 6, "THE NATCHEZ INDIANS.", True, "title"),
        (1, "a", 4, 6, "more", False, None), (1, "a", 5, 6, "OUR MISSION IN MANILA", True, "title"), (1, "a", 6, 6, "A THIRD PIECE", True, "title"), (1, "a", 7, 9, "end", False, None),
    ]
    return spark.createDataFrame(rows, "vol int, issue string, seq int, page int, t string, is_head boolean, start string")


def test_articles(spark):
    done = A.assign_articles(paras(spark))
    assert [r.article for r in done.orderBy("seq").collect()] == [None, "1-005", "1-005", "1-005", "1-005", "1-006", "1-006-2", "1-006-2"]
    ranges = {r.article: (r.title, r.p0, r.p1, r.paragraphs) for r in A.article_ranges(done).collect()}
    assert ranges["1-005"] == ("The Natchez Indians", 5, 6, 4) and ranges["1-006-2"] == ("A Third Piece", 6, 9, 2)
    merged = A.merge_articles(done, spark.createDataFrame([("1-006",), ("1-006-2",)], "article string"))
    assert {r.article for r in merged.collect()} == {None, "1-005"}
    assert A.assign_articles(paras(spark).limit(0)).count() == 0


def test_edits(spark):
    cut = A.split_paragraphs(paras(spark), spark.createDataFrame([(9, "nd")], "page int, mark string"))
    assert [(r.t, r.start) for r in cut.filter("seq = 7").orderBy("part").collect()] == [("e", None), ("nd", "manual")] and cut.count() == 9
    left = A.drop_lines(paras(spark), spark.createDataFrame([(6, "THE NATCHEZ")], "page int, prefix string"), ["vol", "seq"])
    assert left.count() == 7 and left.filter("seq = 3").count() == 0


def test_index_and_register(spark):
    lines = ["Colombia, Our Missions in — Fr. J. Ryan . . . 24o", "Dead, List of Our,", "in United States and Canada ... 191", "OBITUARY", "Fr. John Verdin, 97", "no page here"]
    df = spark.createDataFrame([(30, i, x) for i, x in enumerate(lines)], "vol int, seq int, line string")
    got = [(r.entry, r.author, r.pages, r.section) for r in A.parse_index(df).orderBy("ord").collect()]
    assert got == [("Colombia, Our Missions in", "Fr. J. Ryan", [240], "Articles"), ("Dead, List of Our, in United States and Canada", None, [191], "Articles"), ("Fr. John Verdin", None, [97], "Obituary")]
    e = values(spark, A.register_entries, ["AHERN, M. J. (auth.) 12, 34. SEE ALSO Boston; ST. MARY'S College 3, 4 XIV BOSTON, 5, 6"])[0]
    assert [x.head for x in e] == ["AHERN", "ST. MARY'S", "BOSTON"] and e[2].rest == "5, 6"
