import pytest
from pyspark.sql import functions as F

from pagewright.functions import repair as R
from pagewright.functions import text as T
from pagewright.operators import headings as H
from pagewright.operators import search


def values(spark, f, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_headings_and_sections(spark):
    assert values(spark, H.is_heading, ["THE UNION", "Varia.", "prose", "A" * 130, None]) == [True, True, False, False, None]
    assert values(spark, H.section_of, ["V a R I a", "Obituarv", "SUPPLEMENT.", "THE UNION", "", None]) == ["Varia", "Obituary", "Supplement", None, None, None]
    assert values(spark, H.person_name, ["FATHER JOHN P. RYAN", "Br. A. Smith", "THE UNION"]) == ["JOHNPRYAN", "ASMITH", "THEUNION"]
    assert values(spark, lambda x: H.plate_caption(F.split(x, "/")), ["The Pulpit/in St. Gudule", "x" * 400]) == ["The Pulpit in St. Gudule", "x" * 300]


def test_alike_and_shortened(spark):
    df = spark.createDataFrame([("THEUNION", "THEUNLON", True), ("MISSIONS", "OURMISSIONSINMANILA", True), ("VARIA", "OBITUARY", False), ("", "A", False), (None, "A", False)], "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", H.alike(F.col("a"), F.col("b")).alias("got")).collect())
    pair = spark.createDataFrame([("FIFTIETHANNIVERSARYOFTHEPROVINCE", "FIFTIETHANNIVYOFTHEPROVCELEBRATION"), ("SHORT", "SHORTER")], "a string, b string")
    assert [r.v for r in pair.select(H.shortened(F.col("a"), F.col("b")).alias("v")).collect()] == [True, False]


def test_join_title(spark):
    cases = [["THE INCEPTION OF THE", "SEMINARY NEWS", "BY FR. X"], ["THREE YEARS OF A BROTHER", "IN ALASKA.", "More"], ["A WHOLE TITLE.", "IN PART"], ["ONE"], [], ["LETTERS FROM", "by Fr. X"]]
    want = [["THE INCEPTION OF THE SEMINARY NEWS", "BY FR. X"], ["THREE YEARS OF A BROTHER IN ALASKA.", "More"], ["A WHOLE TITLE.", "IN PART"], ["ONE"], [], ["LETTERS FROM", "by Fr. X"]]
    assert values(spark, H.join_title, cases, "array<string>") == want


def test_run_in_title_and_starts(spark):
    got = values(spark, H.run_in_title, ["OUR COLLEGE AT BATON ROUGE, LOUISIANA. A Letter from Father Gache.", "Plain prose. It goes on.", "A B. Then"])
    assert (got[0].title, got[0].rest) == ("OUR COLLEGE AT BATON ROUGE, LOUISIANA.", "A Letter from Father Gache.") and got[1:] == [None, None]
    rows = [(False, True, False, False, False, True), (False, True, False, True, False, True), (False, True, True, True, True, False), (False, True, False, True, True, False), (True, True, False, False, False, False), (False, False, False, False, False, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a boolean, b boolean, c boolean, d boolean, e boolean, f boolean")
    got = [r.v for r in df.select("i", H.start_kind(*(F.col(c) for c in "abcdef")).alias("v")).orderBy("i").collect()]
    assert got == ["issue-opening", "insert", "supplement", "title-page", None, None]
    assert values(spark, lambda x: H.opens_issue(F.lit(True), F.lit(False), x), ["irn /iDemonam", "12", "x" * 80]) == [True, False, False]


def test_masthead(spark):
    cases = [
        (["A. M. D. G.", "THE VILLAGE LETTERS", "VOL. XXX. No. 2.", "THE UNION", "text"], False), (["VILLAGE LETTFRS.", "VOL. XXXIIL No. I.", "text"], False), (["tKfje Wobj", "| VOL. LVII, No. 3. |", "A TITLE", "text"], True),
        (["A TITLE", "text", "VOL. II. No. 1"], False), ([], True), (["THE", "VOL. IV. No. 2."], False),
    ]
    df = spark.createDataFrame([(i, b, o) for i, (b, o) in enumerate(cases)], "i int, b array<string>, o boolean")
    got = [r.v for r in df.select("i", H.without_masthead(F.col("b"), "VILLAGELETTERS", F.col("o")).alias("v")).orderBy("i").collect()]
    assert got[1:] == [["text"], ["A TITLE", "text"], ["A TITLE", "text", "VOL. II. No. 1"], [], []]
    assert got[0] in (["THE UNION", "text"],)


def test_titles(spark):
    rows = [("Some impressions", "Impressions, Letter of", "Some impressions"), ("D U R a N Q U E T", "Father Duranquet", "Father Duranquet"), ("THE UNION", "Union, The", "THE UNION"), ("THE UNION^", None, "THE UNION"), ("x", "Missions in Alaska", "Missions in Alaska")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h string, e string, want string")
    assert [(r.v, r.want) for r in df.select("i", "want", H.title_of(F.col("h"), F.col("e")).alias("v")).orderBy("i").collect()] == [(w, w) for _, _, w in rows]
    arts = [("OBITUARY", None, None, "title", "Father Edward V. Boursaud."), ("SUPPLEMENT", "A NATIVE CLERGY · Part one", None, "title", ""), ("V a R I a", None, None, "title", ""), ("Father Smith", None, "Obituary", "title", ""), ("Fr. Y", None, None, "name", ""), ("THE UNION", "sub", None, "title", "")]
    out = H.sections(spark.createDataFrame([(i, *r) for i, r in enumerate(arts)], "i int, t string, s string, e string, start string, nxt string"), "t", "s", "e", "start", "nxt").orderBy("i").collect()
    assert [(r.t, r.s, r.section) for r in out] == [("Father Edward V. Boursaud", None, "Obituary"), ("A NATIVE CLERGY", "Part one", "Supplement"), ("Varia", None, "Varia"), ("Father Smith", None, "Obituary"), ("Fr. Y", None, "Obituary"), ("THE UNION", "sub", None)]


def test_listed_heads(spark):
    rows = [(1, 0, "Tbe Iroquois Misslon.", None), (1, 1, "117", None), (1, 2, "Prose that goes on.", None), (1, 3, "The Iroquois Mission.", None), (2, 0, "THE IROQUOIS MISSION", "title"), (2, 1, "118", None)]
    got = H.listed_heads(spark.createDataFrame(rows, "p int, k int, t string, start string"), ["p"], "k", "t", "start", ["THEIROQUOISMISSION"])
    assert sorted((r.p, r.k) for r in got.collect()) == [(1, 2), (1, 3), (2, 0), (2, 1)]


def test_confirmed_starts(spark):
    heads = spark.createDataFrame([(1, p, h) for p, h in [(1, "THEUNION"), (2, "THEUNION"), (3, ""), (4, "OURMISSIONS"), (5, "OURMISSIONS")]], "v int, p int, head string")
    rows = [(1, 3, 0, "THE UNION", True, "title-page"), (1, 3, 1, "prose", False, None), (1, 3, 2, "OUR MISSIONS", True, None), (1, 5, 0, "ANOTHER THING", True, "title-page"), (1, 4, 0, "NAMED BY INDEX", True, "title-page")]
    df = spark.createDataFrame(rows, "v int, p int, k int, t string, h boolean, start string")
    got = {(r.p, r.k): r.start for r in H.confirmed_starts(df, "v", "p", "k", "t", "h", "start", heads, spark.createDataFrame([(1, 4)], "v int, p int")).collect()}
    assert got == {(3, 0): None, (3, 1): None, (3, 2): "running-head", (5, 0): None, (4, 0): "title-page"}


def test_section_starts(spark):
    rows = [
        (1, 0, "prose " * 30, False, None, "X", None), (1, 1, "VARIA", True, None, "X", None), (2, 0, "V A A /A", True, "title-page", "", "Varia"), (3, 0, "OBITUARY", True, "title-page", "", "Obituary"),
        (4, 0, "VARIA", True, None, "", None), (4, 1, "p " * 100, False, None, "", None), (5, 0, "VARIA", True, None, "", None), (5, 1, "short", False, None, "", None), (6, 0, "VARIA", True, "insert", "", "Varia"),
    ]
    df = spark.createDataFrame([("i", *r) for r in rows], "i string, p int, k int, t string, h boolean, start string, head string, sec string")
    got = {(r.p, r.k): r.start for r in H.section_starts(df, ["i"], "p", "k", "t", "h", "start", "head", "sec").collect() if r.h}
    assert got == {(1, 1): "section", (2, 0): None, (3, 0): None, (4, 0): "section", (5, 0): None, (6, 0): "insert"}


def test_leaf_rules(spark):
    tops = [(1, "THE UNION", None), (2, "Tbe Unlon", "THE UNION OF"), (3, "The Union.", None), (4, "Quite another line", None)]
    got = H.agreeing_heads(spark.createDataFrame([("i", *r) for r in tops], "i string, p int, t string, head string"), "i", "p", "t", "head").orderBy("p").collect()
    assert [r.agrees for r in got] == [True, True, True, False]
    leaves = [(p, "x", "H", p + 19, None) for p in range(1, 13)] + [(13, "x", None, None, None), (14, "x", "H", 2, None), (15, "x", "H", 3, None)]
    df = spark.createDataFrame([("i", *r) for r in leaves], "i string, p int, f string, head string, cand int, r int")
    assert [(r.p, r.how) for r in H.section_start(df, "i", "p", "f", "head", "cand", "r").collect()] == [(13, "figures")]
    titled = df.union(spark.createDataFrame([("i", 16, "Supplemcnt", None, None, None)], df.schema))
    assert [(r.p, r.how) for r in H.section_start(titled, "i", "p", "f", "head", "cand", "r").collect()] == [(16, "heading")]
    roman = spark.createDataFrame([("i", p, "x", "H", p + 30, None) for p in range(1, 12)] + [("i", 12, "x", "H", None, None), ("i", 13, "x", "H", None, 2), ("i", 14, "x", "H", None, 3)], df.schema)
    assert [(r.p, r.how) for r in H.section_start(roman, "i", "p", "f", "head", "cand", "r").collect()] == [(12, "roman")]
    p = [(1, True, 3000, 5, 5, "THE UNION"), (2, True, 300, 99, 6, None), (3, True, 900, None, 7, None), (4, True, 2000, 7, 7, None), (5, True, 300, 111, 8, "STATISTICS")]
    got = H.plates(spark.createDataFrame([("i", *r) for r in p], "i string, p int, text boolean, chars int, cand int, page int, head string"), "i", "p", "text", "chars", "cand", "page", "head").orderBy("p").collect()
    assert [r.text for r in got] == [True, False, False, True, True]
    s = [(1, ["THE UNION"], "THE UNION", None, 119), (2, ["4", "RETREAT AT ST. IGNATIUS"], "RETREAT AT ST. IGNATIUS", 4, 120), (3, ["5", "THE UNION"], "THE UNION", 5, 121)]
    got = H.signatures(spark.createDataFrame([("i", *r) for r in s], "i string, p int, lines array<string>, head string, cand int, page int"), "i", "p", "lines", "head", "cand", "page").orderBy("p").collect()
    assert [r.signature for r in got] == [False, True, False]
    c = [(1, "text", False, "VARIA", "x", 515), (2, "blank", False, None, None, None), (3, "text", True, None, "VARlA", None), (4, "text", True, None, "more", None), (5, "plate", False, None, None, None)]
    df = spark.createDataFrame([("i", *r) for r in c], "i string, p int, kind string, ins boolean, head string, f string, page int")
    assert sorted((r.p, r.page) for r in H.closing_pages(df, "i", "p", "kind", "ins", "head", "f", "page").collect()) == [(3, 516), (4, 517)]


def test_index_sections(spark):
    rows = [("A piece", "Articles", False), *((f"Fr. {x}", "Articles", True) for x in "abc"), ("Alaska", "Articles", True), ("Manila", "Articles", True), ("Br. Z", "Obituary", True)]
    got = H.index_sections(spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "v int, o int, e string, s string, c boolean"), "v", "o", "e", "s", "c").orderBy("o").collect()
    assert [r.s for r in got] == ["Articles", "Obituary", "Obituary", "Obituary", "Varia", "Varia", "Obituary"]
    rows = [("Fr. A", "Obituary", True), ("Alaska", "Obituary", True), ("Rome", "Obituary", True), ("Cuba", "Obituary", True), ("Spain", "Obituary", True), ("Sanctus Traverso", "Obituary", True), ("Br. B", "Obituary", True), ("Lone Place", "Obituary", True)]
    got = H.index_sections(spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "v int, o int, e string, s string, c boolean"), "v", "o", "e", "s", "c").orderBy("o").collect()
    assert [r.s for r in got] == ["Obituary", "Varia", "Varia", "Varia", "Varia", "Varia", "Obituary", "Obituary"]


def test_records_and_dates(spark):
    df = spark.createDataFrame([("i", k, p, lab) for k, (p, lab) in enumerate([(1, None), (2, None), (2, None), (9, "Suppl. 9"), (3, None), (None, None), (1, None)])], "i string, k int, p int, lab string")
    assert sorted(tuple(r) for r in H.page_order_breaks(df, "i", "k", "p", "lab").collect()) == [("i", 2, 2), ("i", 3, 1)]
    got = values(spark, H.life_dates, ["1835; Cork – 1901; Georgetown", "; Cork – 1901;", "no dates", None])
    assert (got[0].born, got[0].born_at, got[0].died, got[0].died_at) == (1835, "Cork", 1901, "Georgetown") and (got[1].born, got[1].died, got[1].died_at) == (None, 1901, None) and got[2:] == [None, None]
    arts = spark.createDataFrame([("a1", "i", 5, 1900), ("a2", "i", 3, 1900), ("a0", "j", 3, 1901)], "id string, iss string, p int, y int")
    assert sorted(tuple(r) for r in H.first_articles(arts, "iss", "p", "id").collect()) == [("i", "a2"), ("j", "a0")]
    study = H.texts_by_year(arts, "id", "y", spark.createDataFrame([("a2",), ("a2",)], "id string"))
    assert sorted(tuple(r) for r in study.collect()) == [(1900, 2, ["a2"]), (1901, 1, [])]
    assert [r.n for r in H.record_numbers(arts, "iss", "p", "id").orderBy("id").collect()] == [1, 2, 1]
    assert values(spark, H.leading_number, ["12", "vii", "1 2", "house"]) == [12, 7, None, None]
    assert search.long_enough("Of the Él Niño x1 y") == ["the", "nino"]


def test_doubtful_readings(spark):
    rows = [("objedls", None, None, None, None, "objects"), ("Moedling", 3.0, None, None, None, None), ("adling", None, None, None, None, "acting"), ("Miiller", None, None, 1.0, 4.0, "Müller"), ("Jesiiit", None, None, 5.0, None, None), ("fadl", None, 5.0, None, None, "fact")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, z double, c double, u double, g double, want string")
    got = df.select("i", "want", R.doubtful_reading(*(F.col(x) for x in "tzcug")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [r.want for r in got]


@pytest.mark.parametrize("text, want", [("őłčāé", "ołcae"), ("Å ñ ü", "A n u"), ("é", "e"), (None, None)])
def test_fold(spark, text, want):
    assert values(spark, T.fold, [text]) == [want]


def test_references_and_marks(spark):
    assert values(spark, T.strip_tags, ["<b>a &amp; b</b> &eacute;&#233;&#xE9; &nosuch; & &lt;i&gt; &amp;lt;", "plain", None]) == ["a & b ééé &nosuch; & <i> &lt;", "plain", None]
    assert values(spark, lambda x: T.highlight(x, ["a.b", "c("]), ["a.bc axb"]) == ["<mark>a.bc</mark> axb"]
    assert values(spark, R.capital_heads, ["ST. MARY'S COLLEGE"]) == ["St. Mary's College"]
