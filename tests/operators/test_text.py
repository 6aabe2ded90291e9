import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T


def values(spark, f, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "f, cases",
    [
        (T.digits, {"lO": 10, "lOI": 101, "12": 12, "--": None, "x1": None, None: None}),
        (T.pageish, {"Ill": True, "S4t": True, "15»": True, "1730": False, "\\^": True, "word": False}),
        (T.index_numeral, {"XLVIil": 48, "Xllt": 13, "57": 57, "abc": None}),
        (T.roman_page, {"vii": 7, "Ill": 3, "11": 2, "XIV": 14, "house": None}),
        (T.clean_line, {"a  b , c": "a b, c", " x�y ": "x—y", "": ""}),
        (T.is_upper, {"THE UNION": True, "ab": False, "A B": False, "THE union OF": False}),
        (T.norm_head, {"The Union, 12": "THEUNION"}),
        (T.uninvert, {"Colombia, Our Missions in": "Our Missions in Colombia", "Kenny Father, Letter of": "Letter of Father Kenny", "Plain": "Plain"}),
        (T.stem_name, {"Joannes": "ioannes", "Aloysius": "aloisi", "Jülius": "iuli"}),
        (T.year_in, {"in 1898 and 1900": 1898, "1860": None, "": None}),
        (T.sentence_count, {"Fr. Ryan came. He left!": 2, "J. J. Ryan spoke... Then? No.": 3, "": 0}),
        (T.strip_tags, {"<b>a &amp; b</b>": "a & b"}),
    ],
)
def test_written_cases(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_numerals_round_trip(spark):
    n = list(range(1, 90))
    romans = values(spark, T.to_roman, n, "int")
    assert romans[:6] == ["i", "ii", "iii", "iv", "v", "vi"] and romans[39] == "xl" and romans[48] == "xlix"
    assert values(spark, T.roman, romans) == n


def test_sentence_pieces_and_mattr(spark):
    assert values(spark, T.sentence_pieces, ["A b. C d! e? \"F\""]) == [["A b.", "C d! e?", "\"F\""]]
    for n in (0, 5, 199, 200, 219, 220, 1000):
        words = [str(k * k % 37) for k in range(n)]
        want = (len(set(words)) / n if n else 0) if n < 200 else sum(len(set(words[i : i + 200])) / 200 for i in range(0, n - 199, 20)) / len(range(0, n - 199, 20))
        assert values(spark, T.mattr, [words], "array<string>")[0] == pytest.approx(want)


def test_numeric_row(spark):
    got = values(spark, T.numeric_row, ["Boston College . 1,200 34, 5", "1 2 3", "no numbers", "... 4", None])
    assert (got[0].label, got[0].nums) == ("Boston College", ["1,200", "34", "5"]) and got[1:] == [None] * 4


def test_forename_fits(spark):
    rows = [("John", "Ioannes", ["john", "ioannes"], True), ("Aloysius", "Aloisius", None, True), ("T.", "Thomas", None, True), ("J.", "Ioannes", None, True), ("Peter", "Paulus", None, False), ("", "Paulus", None, True)]
    df = spark.createDataFrame(rows, "a string, b string, f array<string>, want boolean")
    assert all(r.got == r.want for r in df.select("want", T.forename_fits(F.col("a"), F.col("b"), F.col("f")).alias("got")).collect())


def test_keep_paragraph_and_headlike(spark):
    assert values(spark, T.keep_paragraph, ["THE WHOLE HEADING", "A line of plain prose, as it was.", "12 34 56 | 78", "x " * 40, None]) == [False, True, False, False, None]
    assert values(spark, T.headlike, ["THE UNION", "Recollections of the Rocky Mountains.", "a sentence of prose that runs on."]) == [True, True, False]
