"""Host-level quality rules (native: DataFrame functions only).

Each document gets rule measures and a rule verdict. Failures are then counted by host, each
host's failure rate is shrunk towards the corpus rate by an empirical beta prior, and the
host's verdict is joined back to its documents.

Defined results for odd input: a null text has no words (n_words 0, base_failed true); a null
host is a host of its own; repeated rows are judged one by one; an empty table gives an empty
table; a null doc_id stays null. Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPACE, materialise, table, text_or_empty

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Largest host table that is broadcast; beyond it the join is salted.
BROADCAST_HOSTS = 50_000
SALTS = 64

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def gram_hashes(hashes: Column) -> Column:
    """Hashes of all windows of five words, from word hashes: windows of 2, then 4, then 5 words."""

    def join(a: Column, b: Column, n: Column) -> Column:
        return F.zip_with(F.slice(a, 1, n), b, lambda x, y: F.xxhash64(x, y))

    n = F.size(hashes)
    two = join(hashes, F.slice(hashes, 2, n - 1), n - 1)
    four = F.zip_with(F.slice(two, 1, n - 3), F.slice(two, 3, n - 3), lambda x, y: F.xxhash64(x, y))
    return join(F.slice(four, 1, n - 4), F.slice(hashes, 5, n - 4), n - 4)


def _words_in(places: Column, window: int) -> Column:
    """Words covered by windows that start at the given places, in ascending order."""
    steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda p, q: F.least(F.lit(window), F.coalesce(q - p, F.lit(window))))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def _exact_places(grams: Column) -> Column:
    """Places of windows found twice or more, by sorting (hash, place) structs."""
    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    none = F.array(F.lit(None).cast("struct<g:bigint,i:int>"))
    around = F.arrays_zip(pairs.alias("x"), F.concat(none, F.slice(pairs, 1, F.size(pairs) - 1)).alias("before"), F.concat(F.slice(pairs, 2, F.size(pairs)), none).alias("after"))
    twice = F.filter(around, lambda z: (z["x"]["g"] == z["before"]["g"]) | (z["x"]["g"] == z["after"]["g"]))
    return F.array_sort(F.transform(twice, lambda z: z["x"]["i"]))


#: Bits of a packed long that hold the place; the others hold the hash's high bits.
PLACE_BITS = 24


def repeats(grams: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with an array column ``grams`` of window hashes.

    Hash and place are packed into one long, so that one sort of plain longs brings equal windows
    together. Where packing could merge different hashes (equal high bits, or a place that
    doesn't fit) the structs are sorted instead: the result is that of the full hashes.
    """
    mask = (1 << PLACE_BITS) - 1
    some = F.size(F.array_distinct("grams")) < F.size("grams")
    packed = F.sort_array(F.transform("grams", lambda g, i: g.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint"))))
    sorted_ = grams.withColumn("packed", F.when(some & (F.size("grams") <= mask), packed))

    def equal(a: Column, b: Column) -> Column:
        return F.shiftright(a.bitwiseXOR(b), PLACE_BITS) == 0

    rest = F.slice("packed", 2, F.size("packed") - 1)
    first = F.array_compact(F.zip_with("packed", rest, lambda a, b: F.when(equal(a, b), a)))
    second = F.array_compact(F.zip_with("packed", rest, lambda a, b: F.when(equal(a, b), b)))
    matched = sorted_.withColumn("first", first).withColumn("second", second)

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(mask)).cast("int")

    merged = F.exists(F.zip_with("first", "second", lambda a, b: F.element_at("grams", place(a) + 1) != F.element_at("grams", place(b) + 1)), lambda x: x)
    places = F.sort_array(F.array_distinct(F.transform(F.concat("first", "second"), place)))
    zero = F.lit(0).cast("bigint")
    count = F.when(F.col("grams").isNull(), zero).when(F.col("packed").isNull(), F.when(some, _words_in(_exact_places(F.col("grams")), 5)).otherwise(zero)).when(merged, _words_in(_exact_places(F.col("grams")), 5))
    return matched.withColumn("n_repeat_words", count.otherwise(_words_in(places, 5))).drop("grams", "packed", "first", "second")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: bool = False) -> DataFrame:
    """id, host and the measures of each document's whole text; with ``carry`` its row as ``row``.

    n_repeat_words counts words in windows of five that the text holds twice or more, first one
    included. Windows are compared by 64-bit hashes of 64-bit word hashes. Texts whose windows
    are all distinct stop after a hash set.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_or_empty(text_col).alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []))
    kept = ["row"] if carry else []
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{WORD_SPACE}]"))
    words = base.select(
        "doc_id",
        "host",
        *kept,
        F.array_remove(F.split("text", f"[{WORD_SPACE}]+"), "").alias("words"),
        F.char_length(F.regexp_replace("text", f"[{WORD_SPACE}]+", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        F.when(F.contains("text", F.lit("\n")), lines).alias("lines"),
    )
    hashed = words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    grams = hashed.withColumn("grams", F.when(F.size("hashes") >= 6, gram_hashes(F.col("hashes"))))
    counted = grams.select(
        "doc_id",
        "host",
        *kept,
        F.size("words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("bigint").alias("n_dup_lines"),
        "grams",
    )
    return repeats(counted)


def host_verdicts(judged: DataFrame, reject_above: float = 0.5, strength: tuple[float, float] = (2.0, 1000.0)) -> DataFrame:
    """host, n, failed, rate, shrunk_rate, host_rejected from (host, base_failed) rows.

    The beta prior is fitted by moments over hosts: mean m, weighted variance v of the rates,
    prior strength k = m(1-m)/v - 1, held within ``strength``. The shrunk rate is
    (failed + m k) / (n + k); a host is rejected above ``reject_above``.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failed"))
    total = hosts.agg(
        F.sum("n").alias("docs"),
        (F.sum("failed") / F.sum("n")).alias("m"),
        F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares"),
    ).select("m", (F.col("squares") / F.col("docs") - F.col("m") * F.col("m")).alias("v"))
    k = F.least(F.lit(strength[1]), F.greatest(F.lit(strength[0]), F.coalesce(F.try_divide(F.col("m") * (1 - F.col("m")), F.col("v")) - 1, F.lit(strength[1]))))
    shrunk = (F.col("failed") + F.col("m") * k) / (F.col("n") + k)
    return hosts.crossJoin(F.broadcast(total)).select("host", "n", "failed", (F.col("failed") / F.col("n")).alias("rate"), shrunk.alias("shrunk_rate"), (shrunk > reject_above).alias("host_rejected"))  # total is one row


def join_hosts(judged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each judged row with its host's verdict: broadcast if the host table is small, else salted."""
    verdicts = verdicts.select(F.col("host").alias("v_host"), "host_rejected")
    if verdicts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        return judged.join(F.broadcast(verdicts), F.col("host").eqNullSafe(F.col("v_host")), "left").drop("v_host")
    salted = verdicts.withColumn("v_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = judged.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return left.join(salted, F.col("host").eqNullSafe(F.col("v_host")) & (F.col("salt") == F.col("v_salt")), "left").drop("v_host", "v_salt", "salt")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 10, repeat_percent: int = 20, reject_above: float = 0.5, carry: bool = False) -> DataFrame:
    """doc_id, the measures, base_failed, host_rejected and kept for every row of docs (as ``row`` with ``carry``)."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    judged = materialise(measures(docs, id_col, text_col, host_col, carry).withColumn("base_failed", failed), "quality-measures")
    out = join_hosts(judged, materialise(host_verdicts(judged, reject_above), "quality-hosts"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))


def keep_good(docs: DataFrame, **rules) -> DataFrame:
    """The rows of docs that the rules keep."""
    return judge(docs, carry=True, **rules).filter("kept").select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(words) - 3)) AS p, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) AS gram
  FROM w WHERE len(words) >= 5),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source AS host, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM j GROUP BY host),
t AS (SELECT sum(failed) / sum(n) AS m, sum(failed * failed / n) / sum(n) AS sq FROM h),
k AS (SELECT m, CASE WHEN sq - m * m = 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0, m * (1 - m) / (sq - m * m) - 1)) END AS k FROM t),
v AS (SELECT host, (failed + m * k) / (n + k) > 0.5 AS host_rejected FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_rejected AS kept
FROM j JOIN v ON j.host IS NOT DISTINCT FROM v.host
"""
