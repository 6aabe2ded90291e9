"""Readers of landed files: leaves, catalogue rows, overrides, marked-up tables, flat files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_line, strip_tags


def read_leaves(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """(issue, leaf, lines): one gz text per issue, sliced by a JSON index of [start, end, …] lists.

    Files are named <issue>_… ; the text is cut at its offsets and split into cleaned lines.
    """
    name = F.regexp_extract(F.input_file_name(), "([^/_]+)_[^/]*$", 1)
    text = spark.read.text(path, wholetext=True).select(name.alias("issue"), F.col("value").alias("txt"))
    index = spark.read.text(index_path, wholetext=True).select(name.alias("issue"), F.from_json("value", "array<array<int>>").alias("idx"))
    cut = text.join(index, "issue").select("issue", "txt", F.posexplode("idx").alias("leaf", "at"))
    part = F.substring("txt", F.element_at("at", 1) + 1, F.element_at("at", 2) - F.element_at("at", 1))
    return cut.select("issue", "leaf", F.filter(F.transform(F.split(part, "\n"), clean_line), lambda x: x != "").alias("lines"))


def viewer_positions(leaves: DataFrame, shown: DataFrame) -> DataFrame:
    """leaves with their ordinal and label in a viewer list (issue, pages of (leafNum, pageNumber))."""
    flat = shown.select("issue", F.posexplode("pages").alias("n", "p")).select("issue", F.col("p.leafNum").alias("leaf"), "n", F.nullif(F.col("p.pageNumber"), F.lit("")).alias("label"))
    return leaves.join(flat, ["issue", "leaf"], "left")


#: A catalogue statement: volume, corrected volume, number, year and season; fixed pattern.
STATEMENT = r"^v\.(\d+)(?:\[i\.e\.\s*(\d+)\])?:no\.(\S+)\s*\((\d{4})(?::([A-Za-z]+))?\)$"


def parse_catalogue(rows: DataFrame, statement: str) -> tuple[DataFrame, DataFrame]:
    """(issues, extras): rows whose statement parses, in catalogue order, and the others as they are."""
    s = F.col(statement)
    group = lambda k: F.nullif(F.regexp_extract(s, STATEMENT, k), F.lit(""))
    parsed = rows.filter(s.rlike(STATEMENT))
    printed = group(1).cast("int")
    issues = parsed.select("*", F.coalesce(group(2).cast("int"), printed).alias("vol"), F.when(group(2).isNotNull(), printed).alias("printed_vol"), group(3).alias("no"), group(4).cast("int").alias("year"), group(5).alias("season"))
    return issues.orderBy("vol", F.regexp_extract("no", r"^(\d+)", 1).try_cast("int")), rows.filter(~F.coalesce(s.rlike(STATEMENT), F.lit(False)))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(key, body): entries of a JSON object of overrides; keys that begin with _ are comments.

    A missing file gives no rows. Overrides are edited by hand, so the table is small.
    """
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "key string, body string")
    entries = raw.select(F.explode(F.json_object_keys("value")).alias("key"), "value").filter(~F.col("key").startswith("_"))
    return entries.select("key", F.element_at(F.from_json("value", "map<string,string>"), F.col("key")).alias("body"))


def html_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row, cells): the cells of each table row of a page."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit("(?s)<tr[^>]*>(.*?)</tr>"), 1)).alias("row", "_r"))
    cells = F.regexp_extract_all("_r", F.lit("(?s)<t[dh][^>]*>(.*?)</t[dh]>"), 1)
    return rows.select(key, "row", F.transform(cells, lambda c: F.trim(strip_tags(c))).alias("cells"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A flat file with a header, by a stated schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): whole text files by name."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("name"), F.col("value").alias("text"))
