"""Full-text search and concordance over postings."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, form, term): words with their places; terms are folded and in lower case."""
    placed = docs.select(key, F.posexplode(_forms(F.col(text))).alias("pos", "form"))
    return placed.withColumn("term", _term(F.col("form")))


def phrase(words: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, pos): where the terms stand one after another; one scan, no self-join per word."""
    w = Window.partitionBy(key).orderBy("pos")
    hit = F.col("term") == terms[0]
    following = words.select(key, "pos", "term", *(F.lead("term", k).over(w).alias(f"_t{k}") for k in range(1, len(terms))))
    for k in range(1, len(terms)):
        hit &= F.col(f"_t{k}") == terms[k]
    return following.filter(hit).select(key, "pos")


def _forms(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r\f\x0b]+"), lambda w: w != "")


def _term(form: Column) -> Column:
    return F.regexp_replace(F.lower(fold(form)), "[^a-z0-9']", "")


def _begins(term: Column, prefixes: list[str]) -> Column:
    return term.rlike("^(?:" + "|".join(re.escape(p) for p in prefixes) + ")")


#: Between words, and a character beyond ASCII.
BLANK, FOREIGN = r" \t\n\r\f\x0b", r"[^\x00-\x7f]"


def _opening(prefixes: list[str]) -> str:
    """How a word in lower case begins whose term begins with a prefix: characters that terms drop may stand between."""
    dropped = rf"[^{BLANK}a-z0-9']*"
    return "(?:" + "|".join("".join(dropped + re.escape(c) for c in p) for p in prefixes) + ")"


def with_a_hit(docs: DataFrame, text: str, prefixes: list[str]) -> DataFrame:
    """docs that have a word whose term begins with a query word; no text is cut into words."""
    low = F.lower(F.when(F.col(text).rlike(FOREIGN), fold(F.col(text))).otherwise(F.col(text)))
    return docs.filter(low.rlike(f"(?<![^{BLANK}])" + _opening(prefixes))) if prefixes else docs.limit(0)


def with_hits(docs: DataFrame, text: str, prefixes: list[str]) -> DataFrame:
    """docs that have words which begin with a query word, with ``words`` and ``runs`` of such words (first, last).

    All within the row: no word is shuffled, only texts with a hit are cut into words, and only
    words with letters beyond ASCII are folded. Arrays are bound once before lambdas read them.
    """
    begins = lambda w: F.when(w.rlike(FOREIGN), _begins(_term(w), prefixes)).otherwise(F.lower(w).rlike("^" + _opening(prefixes)))
    bound = lambda array, f: F.get(F.transform(F.array(array), f), F.lit(0))

    def runs(m: Column) -> Column:
        first = F.filter(m, lambda p, k: (k == 0) | (F.get(m, k - 1) != p - 1))
        last = F.filter(m, lambda p, k: (k == F.size(m) - 1) | (F.get(m, k + 1) != p + 1))
        return F.arrays_zip(first.alias("first"), last.alias("last"))

    def found(words: Column) -> Column:
        match = F.filter(F.transform(words, lambda w, i: F.when(begins(w), i)), lambda i: i.isNotNull())
        return F.struct(words.alias("words"), bound(match, runs).alias("runs"))

    return with_a_hit(docs, text, prefixes).withColumn("_f", bound(_forms(F.col(text)), found)).select(*docs.columns, "_f.words", "_f.runs")


def hits(docs: DataFrame, key: str, text: str, prefixes: list[str]) -> DataFrame:
    """(key, first, last): runs of consecutive words that begin with a query word."""
    return with_hits(docs, text, prefixes).select(key, F.explode_outer("runs").alias("r")).filter("r is not null").select(key, "r.first", "r.last")


def kwic(docs: DataFrame, key: str, text: str, prefixes: list[str], around: int = 14, width: int = 64) -> DataFrame:
    """(key, first, left, hit, right): each hit with its context, cut to a width on either side."""
    found = with_hits(docs, text, prefixes).select(key, "words", F.explode_outer("runs").alias("r")).filter("r is not null")
    first, last = F.col("r.first"), F.col("r.last")
    lo = F.greatest(first - around, F.lit(0))
    joined = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    left, right = joined(lo + 1, first - lo), joined(last + 2, F.lit(around))
    return found.select(key, first.alias("first"), F.right(left, F.lit(width)).alias("left"), joined(first + 1, last - first + 1).alias("hit"), F.left(right, F.lit(width)).alias("right"))


def sort_form(s: Column) -> Column:
    """Folded lower-case letters, anything else a space."""
    return F.trim(F.regexp_replace(F.lower(fold(s)), "[^a-z]+", " "))


def sorted_lines(lines: DataFrame, side: str, key: str, lead: int = 3) -> DataFrame:
    """Adds ``place``: the order by the words right of the hit, or left of it read backwards; empty ones last.

    Lines are ranked within groups of equal first letters, behind the lines of the groups before:
    only the table of groups is put in order in one place.
    """
    form = sort_form(F.col("right")) if side == "right" else F.array_join(F.reverse(F.split(sort_form(F.col("left")), " ")), " ")
    formed = lines.withColumn("form", form)
    group = F.struct((F.col("form") == "").alias("empty"), F.left("form", F.lit(lead)).alias("lead"))
    formed = formed.withColumn("_g", group)
    sizes = formed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = formed.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy("form", key, "first"))).join(before.drop("_n"), "_g")
    return ranked.withColumn("place", (F.col("_before") + F.col("_r")).cast("int")).drop("_g", "_r", "_before")


def collocates(docs: DataFrame, text: str, prefixes: list[str], stop: list[str], around: int = 5, min_length: int = 4, top: int = 24) -> DataFrame:
    """(term, n): words near the hits without query words and stop words."""
    found = with_hits(docs, text, prefixes).select("words", F.explode_outer("runs").alias("r")).filter("r is not null")
    lo = F.greatest(F.col("r.first") - around, F.lit(0))
    near = F.concat(F.slice("words", lo + 1, F.col("r.first") - lo), F.slice("words", F.col("r.last") + 2, F.lit(around)))
    terms = found.select(F.explode(F.transform(near, _term)).alias("term"))
    some = terms.filter((F.length("term") >= min_length) & ~F.col("term").isin(stop) & ~_begins(F.col("term"), prefixes))
    return some.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(top)


def distribution(found: DataFrame, docs: DataFrame, key: str, facet: str, per: int = 1000) -> DataFrame:
    """(facet, hits, docs, rate): documents with a hit by facet, per ``per`` documents."""
    totals = docs.groupBy(facet).agg(F.count(F.lit(1)).alias("docs"))
    got = docs.select(key, facet).join(found.select(key).distinct(), key, "left_semi").groupBy(facet).agg(F.count(F.lit(1)).alias("hits"))
    return totals.join(got, facet, "left").select(facet, F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"), "docs", (F.coalesce("hits", F.lit(0)) * per / F.col("docs")).alias("rate"))


def long_enough(query: str, least: int = 3) -> list[str]:
    """The words of a query that are searched: folded, and of so many letters at least."""
    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    return [w for w in re.findall("[a-z0-9']+", plain) if len(w) >= least]


def facets(found: DataFrame, docs: DataFrame, key: str, one: str, two: str) -> DataFrame:
    """(one, two, n): hits by either facet and by both, in one pass."""
    some = docs.select(key, one, two).join(found.select(key).distinct(), key, "left_semi")
    return some.groupingSets([[one], [two], [one, two]], one, two).agg(F.count(F.lit(1)).alias("n"), (F.grouping(one) * 2 + F.grouping(two)).cast("int").alias("level"))


def bm25(words: DataFrame, key: str, query: list[str], k1: float = 1.2, b: float = 0.75, top: int = 20) -> DataFrame:
    """(key, score): best documents for the query terms by the public BM25 formula."""
    lengths = words.groupBy(key).agg(F.count(F.lit(1)).alias("len"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))  # one row
    tf = words.filter(F.col("term").isin(query)).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row per query term
    rows = tf.join(F.broadcast(df), "term").join(lengths, key).crossJoin(F.broadcast(corpus))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return rows.groupBy(key).agg(F.sum(weight).alias("score")).orderBy(F.desc("score"), key).limit(top)
