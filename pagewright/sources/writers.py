"""Writers: nested volumes, manifest, flat and text files, search records, reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share; it is deleted when the application ends.

    Where spark.checkpoint.dir is unset, only a session whose executors are threads of this machine
    gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.sparkContext.setCheckpointDir(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def write_volumes(pages: DataFrame, path: str) -> None:
    """Rows (vol, page_seq, …) as one nested JSON partition per volume, pages in order.

    Each page is its own row in the volume's partition, so a volume is never one object in memory.
    """
    pages.repartition("vol").sortWithinPartitions("vol", "page_seq").write.mode("overwrite").partitionBy("vol").json(path)


def nest_paragraphs(paras: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, paras): the paragraphs of a page as an ordered array of structs."""
    rest = [c for c in paras.columns if c not in (*keys, "para_seq")]
    nested = F.array_sort(F.collect_list(F.struct("para_seq", *rest)))
    return paras.groupBy(*keys).agg(F.transform(nested, lambda x: F.struct(*(x[c].alias(c) for c in rest))).alias("paras"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_lines(leaves: DataFrame, path: str) -> None:
    """The lines of leaves, one file part per partition."""
    leaves.select(F.explode("lines").alias("value")).write.mode("overwrite").text(path)


def metric_report(metrics: DataFrame, title: str) -> str:
    """A report in Markdown of a table of (name, value) metrics, in order of name; rows are read part by part."""
    rows = metrics.orderBy("name").toLocalIterator()
    return "\n".join([f"# {title}", "", "| metric | value |", "|---|---|", *(f"| {r['name']} | {r['value']} |" for r in rows)]) + "\n"


def refuse_recent(issues: DataFrame, today: int, term: int = 96) -> DataFrame:
    """The issues, or an error when one is younger than the term allows; today is a parameter."""
    return issues.withColumn("_ok", F.when(F.col("year") > today - term, F.raise_error(F.concat(F.lit("too recent: "), F.col("year").cast("string")))).otherwise(F.lit(True))).filter("_ok").drop("_ok")
