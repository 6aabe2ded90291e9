import gzip
import json

import pytest
from pyspark.sql import functions as F

from pagewright.sources import readers, writers
from pagewright.streaming import increments


def test_leaves(spark, tmp_path):
    with gzip.open(tmp_path / "iss1_text.txt.gz", "wt") as f:
        f.write("HEAD  ,\n\nbodynext page")
    with gzip.open(tmp_path / "iss1_index.json.gz", "wt") as f:
        json.dump([[0, 13, 1], [13, 22]], f)
    got = readers.read_leaves(spark, str(tmp_path / "*_text.txt.gz"), str(tmp_path / "*_index.json.gz")).orderBy("leaf").collect()
    assert [(r.issue, r.leaf, r.lines) for r in got] == [("iss1", 0, ["HEAD,", "body"]), ("iss1", 1, ["next page"])]


def test_catalogue(spark):
    df = spark.createDataFrame([("a", "v.37[i.e.36]:no.2/3 (1907)"), ("b", "v.95:no.4 (1966:Fall)"), ("c", "index"), ("d", None)], "id string, s string")
    issues, extras = readers.parse_catalogue(df, "s")
    assert [(r.id, r.vol, r.printed_vol, r.no, r.year, r.season) for r in issues.collect()] == [("a", 36, 37, "2/3", 1907, None), ("b", 95, None, "4", 1966, "Fall")]
    assert {r.id for r in extras.collect()} == {"c", "d"}


def test_overrides_and_tables(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"_note": "x", "a": {"missing": [1]}}))
    assert [tuple(r) for r in readers.read_overrides(spark, str(tmp_path / "o.json")).collect()] == [("a", '{"missing":[1]}')]
    assert readers.read_overrides(spark, str(tmp_path / "none.json")).count() == 0
    df = spark.createDataFrame([(1, "<table><tr><th>A&amp;B</th><td> <b>c</b></td></tr>\n<tr></tr></table>")], "id int, html string")
    assert [r.cells for r in readers.html_rows(df, "id", "html").orderBy("row").collect()] == [["A&B", "c"], []]


def test_sinks(spark, tmp_path):
    paras = spark.createDataFrame([(1, 2, 1, "b"), (1, 2, 0, "a")], "vol int, page_seq int, para_seq int, t string")
    writers.write_volumes(writers.nest_paragraphs(paras, ["vol", "page_seq"]), str(tmp_path / "v"))
    back = spark.read.json(str(tmp_path / "v")).first()
    assert [p.t for p in back.paras] == ["a", "b"] and back.vol == 1
    report = writers.metric_report(spark.createDataFrame([("b", "2"), ("a", "1")], "name string, value string"), "QA")
    assert report.index("| a | 1 |") < report.index("| b | 2 |")
    issues = spark.createDataFrame([(1, 1900)], "vol int, year int")
    assert writers.refuse_recent(issues, today=2026).count() == 1
    with pytest.raises(Exception, match="too recent"):
        writers.refuse_recent(issues, today=1950).collect()


def test_streams(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    stream = increments.read_stream(spark, str(tmp_path / "in"), src.schema)
    q = increments.append_volumes(stream, lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = {r["event_type"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["event_type"]: r["count"] for r in src.groupBy("event_type").count().collect()}
    q = increments.windowed_counts(increments.read_stream(spark, str(tmp_path / "in"), src.schema), "ts", ["event_type"], "1 day", "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("w").agg(F.sum("n")).first()[0] == src.count()
