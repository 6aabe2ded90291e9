"""Queries over lines, tokens, sentences, numerals and markup, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pages as P
from ..operators.tables import numeric_rows, ragged

QUERIES, ORACLE_SQL = {}, {}
FUNCTION = "the of and to a in that it for on with be by as this are at from".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


LINES = "SELECT doc_id, lang, source, unnest(range(len(ls)))::INT AS line_no, unnest(ls) AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents)"


def lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query(rf"""
WITH l AS ({LINES}),
c AS (SELECT doc_id, line_no, regexp_replace(trim(regexp_replace(replace(line, chr(65533), '—'), '[ \t]+', ' ', 'g')), ' ([,;:.!?])', '\1', 'g') AS line FROM l),
n AS (SELECT *, length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) AS n, length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) AS u, regexp_extract_all(line, '[A-Za-z]{{4,}}') AS w FROM c)
SELECT doc_id, line_no, length(line)::INT AS length, (n >= 3 AND u * 4 >= n * 3) AS is_upper, regexp_replace(upper(replace(line, 'ß', 'ss')), '[^A-Z]', '', 'g') AS head,
       (n >= 3 AND u * 4 >= n * 3) OR (length(line) < 70 AND regexp_matches(line, '^[A-Z]') AND regexp_matches(line, '[.,] *$') AND len(w) >= 2 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) * 10 >= len(w) * 6) AS headlike
FROM n""")
def line_features(spark, sf):
    c = lines(spark, sf).withColumn("line", T.clean_line(F.col("line")))
    line = F.col("line")
    return c.select("doc_id", "line_no", F.length("line").alias("length"), T.is_upper(line).alias("is_upper"), T.norm_head(line).alias("head"), T.headlike(line).alias("headlike"))


@query(r"""
WITH d AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
s AS (SELECT doc_id, ls, list_filter(ls, lambda x: length(x) >= 5) AS five FROM d)
SELECT doc_id, len(ls)::INT AS n_lines, len(ls) >= 10 AND len(list_filter(ls, lambda x: length(x) < 25)) * 10 >= len(ls) * 6 AS tabular,
       len(five) >= 5 AND len(list_filter(five, lambda x: regexp_matches(x, '[0-9]{1,3}\.?$'))) * 10 >= len(five) * 4 AS index_like
FROM s""")
def leaf_shapes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("ls"))
    return d.select("doc_id", F.size("ls").alias("n_lines"), T.tabular(F.col("ls")).alias("tabular"), T.index_like(F.col("ls")).alias("index_like"))


@query("""
SELECT DISTINCT p_size, CASE WHEN p_size // 10 >= 5 THEN 'l' || repeat('x', p_size // 10 - 5) WHEN p_size // 10 = 4 THEN 'xl' ELSE repeat('x', p_size // 10) END
  || CASE WHEN p_size % 10 = 9 THEN 'ix' WHEN p_size % 10 >= 5 THEN 'v' || repeat('i', p_size % 10 - 5) WHEN p_size % 10 = 4 THEN 'iv' ELSE repeat('i', p_size % 10) END AS numeral,
  p_size AS value, CASE WHEN p_size < 40 THEN p_size END AS page, p_size AS volume
FROM part WHERE length(CAST(p_size AS VARCHAR)) > 0""")
def numerals(spark, sf):
    n = table(spark, sf, "part").select("p_size").distinct().withColumn("numeral", T.to_roman(F.col("p_size")))
    # a page numeral has six characters at most and no l
    page = F.when(F.length("numeral") <= 6, T.roman_page(F.col("numeral")))
    return n.select("p_size", "numeral", T.roman(F.col("numeral")).alias("value"), F.when(F.col("p_size") < 40, F.coalesce(page, F.when(F.length("numeral") > 6, F.col("p_size")))).alias("page"), T.index_numeral(F.upper("numeral")).alias("volume"))


@query(r"""
WITH t AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS token FROM documents),
s AS (SELECT doc_id, token, regexp_replace(token, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') AS t FROM t WHERE regexp_matches(token, '[0-9lI|]') AND length(token) <= 6),
p AS (SELECT *, (length(t) = 0 AND length(token) BETWEEN 1 AND 3) OR (length(t) > 0 AND length(t) <= 4 AND NOT regexp_matches(t, '^1[5-9][0-9][0-9]$') AND (regexp_matches(t, '[0-9]') OR regexp_matches(t, '^[lI1|]{2,}$'))) AS pageish,
  translate(t, 'ilI|oOSsgf', '111100559') AS d FROM s)
SELECT token, pageish, CASE WHEN regexp_matches(d, '^[0-9]+$') THEN TRY_CAST(d AS INTEGER) END AS page, count(*) AS n FROM p GROUP BY ALL""")
def page_tokens(spark, sf):
    t = table(spark, sf, "documents").select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("token"))
    t = t.filter(F.col("token").rlike("[0-9lI|]") & (F.length("token") <= 6)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return t.select("token", T.pageish(F.col("token")).alias("pageish"), T.digits(F.col("token")).alias("page"), "n")


@query("""
SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z][a-z'']+[a-z]')) AS token FROM documents) GROUP BY lang, token HAVING count(*) >= 3""")
def folded_tokens(spark, sf):
    t = table(spark, sf, "documents").select("lang", F.explode(T.word_tokens(F.col("text"))).alias("token"))
    return t.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


SENTENCES = r"""
p AS (SELECT doc_id, lang, source, unnest(range(len(ps)))::INT AS piece, unnest(ps) AS part FROM (SELECT *, string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\x0b]+([A-Z"''(])', '\1␟\2', 'g'), '␟') AS ps FROM documents)),
f AS (SELECT *, lag(part) OVER (PARTITION BY doc_id ORDER BY piece) AS before FROM p),
g AS (SELECT *, sum(CASE WHEN regexp_matches(before, '(^|[^A-Za-z0-9_])([A-Z]|Fr|Br|Mr|Mrs|Rev|St|Dr|Very|Ven|Bl|Co|No|Vol|p|pp)[.]$') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY piece) AS sent FROM f),
s AS (SELECT doc_id, lang, source, sent::BIGINT AS sent, string_agg(part, ' ' ORDER BY piece) AS text FROM g GROUP BY ALL)"""


@query(f"WITH {SENTENCES} SELECT doc_id, sent, text FROM s")
def sentences(spark, sf):
    return P.sentences(table(spark, sf, "documents"), ["doc_id"], "text")


# lookahead is written as a group that the replacement puts back: neighbouring initials take two rounds
MASKED = r"""
m1 AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\b([A-Z])\.([ \t\n\r\f\x0b]*)([A-Z]\b|[^A-Za-z0-9_]*[a-z])', '\1@\2\3', 'g'), '\b([A-Z])\.([ \t\n\r\f\x0b]*)([A-Z]\b|[^A-Za-z0-9_]*[a-z])', '\1@\2\3', 'g') AS t FROM documents),
m2 AS (SELECT doc_id, regexp_replace(t, '\b(Fr|St|Rev|Mr|Mrs|Dr|Prof|Hon|Bro|Sr|Jr|vs|etc|viz|cf|Vol|No|pp)\.', '\1@', 'g') AS t FROM m1)"""


@query(f"WITH {MASKED} SELECT doc_id, len(regexp_extract_all(t, '[.!?]+'))::INT AS n_sentences FROM m2")
def sentence_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.sentence_count(F.col("text")).alias("n_sentences"))


@query(rf"""
WITH l AS ({LINES}),
m AS (SELECT doc_id, trim(line) AS s, length(regexp_replace(trim(line), '[^\p{{L}}]', '', 'g')) AS n, length(regexp_replace(trim(line), '[^\p{{Lu}}]', '', 'g')) AS u,
  length(regexp_replace(trim(line), '[^\p{{L}} \t]', '', 'g')) AS p, regexp_extract_all(lower(trim(line)), '[A-Za-z'']+') AS w FROM l),
k AS (SELECT doc_id, len(w) AS words, n > 0 AND NOT (u * 10 > n * 7 AND length(s) < 95) AND p * 4 >= length(s) * 3
  AND NOT (len(w) > 30 AND len(list_filter(w, lambda x: x IN ({", ".join(repr(w) for w in T.FUNCTION_WORDS)}))) * 10 < len(w)) AS keep FROM m)
SELECT doc_id, count(*) FILTER (keep) AS kept, count(*) AS paragraphs, (sum(words) - coalesce(sum(words) FILTER (keep), 0))::BIGINT AS foreign_words, sum(words)::BIGINT AS words FROM k GROUP BY doc_id""")
def paragraph_filter(spark, sf):
    m = lines(spark, sf).select("doc_id", T.keep_paragraph(F.col("line")).alias("keep"), F.size(F.regexp_extract_all(F.lower(F.trim("line")), F.lit("[A-Za-z']+"), 0)).alias("words"))
    return m.groupBy("doc_id").agg(F.count_if("keep").alias("kept"), F.count(F.lit(1)).alias("paragraphs"), F.sum(F.when(F.col("keep"), 0).otherwise(F.col("words"))).cast("bigint").alias("foreign_words"), F.sum("words").cast("bigint").alias("words"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents)
SELECT doc_id, len(w)::INT AS wc, round(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 200 THEN len(list_distinct(w)) / len(w)
  ELSE list_sum(list_transform(range(0, len(w) - 200 + 1, 20), lambda i: len(list_distinct(w[i + 1:i + 200])))) / (len(range(0, len(w) - 200 + 1, 20)) * 200.0) END, 6) AS mattr FROM t""")
def mattr(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), 0).alias("w"))
    return t.select("doc_id", F.size("w").alias("wc"), F.round(T.mattr(F.col("w")), 6).alias("mattr"))


@query(r"""
WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:li|td|th)[^>]*>(.*?)</(?:li|td|th)>', 1)) AS cell FROM pages)
SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(cell, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS cell, count(*) AS n FROM c GROUP BY ALL""")
def html_cells(spark, sf):
    c = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(?:li|td|th)[^>]*>(.*?)</(?:li|td|th)>"), 1)).alias("cell"))
    return c.select("page_id", T.strip_tags(F.col("cell")).alias("cell")).groupBy("page_id", "cell").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type")
def json_path(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '(?i)\b((?:the|and)[\p{L}\p{M}]*)', '<mark>\1</mark>', 'g')) AS digest FROM documents""")
def highlight(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.highlight(F.col("text"), ["the", "and"])).alias("digest"))


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN 'Customer ' || o_custkey || ', ' ELSE '' END || o_orderpriority || ', ' || (year(o_orderdate) - 1871) || ' (' || year(o_orderdate) || '): '
  || CASE WHEN o_orderkey % 5 = 0 THEN 'Suppl. ' || (o_orderkey % 40) WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 300 AS VARCHAR) ELSE (o_orderkey % 300) || '–' || (o_orderkey % 300 + 7) END AS citation,
  lpad(CAST(year(o_orderdate) - 1871 AS VARCHAR), 3, '0') || lpad(CAST(o_orderkey % 300 AS VARCHAR), 5, '0') AS sort_key,
  CASE WHEN year(o_orderdate) <= 1993 THEN 'open' WHEN year(o_orderdate) <= 1996 THEN 'limited' ELSE 'closed' END AS tier
FROM orders""")
def citation_labels(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate")).withColumn("p", F.col("o_orderkey") % 300)
    own = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("Suppl. "), (F.col("o_orderkey") % 40).cast("string")))
    label = T.page_label(F.col("p"), F.when(F.col("o_orderkey") % 2 == 0, F.col("p")).otherwise(F.col("p") + 7), own)
    author = F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")))
    tier = F.when(F.col("y") <= 1993, "open").when(F.col("y") <= 1996, "limited").otherwise("closed")
    vol = F.col("y") - 1871
    return o.select("o_orderkey", T.citation(author, F.col("o_orderpriority"), vol, F.col("y"), label).alias("citation"), T.sort_key(vol, F.col("p")).alias("sort_key"), tier.alias("tier"))


@query("""
SELECT p_partkey, p_name AS label, [CAST(p_size AS VARCHAR), CAST(p_partkey % 97 AS VARCHAR)] AS nums, CAST(p_size AS VARCHAR) AS n1, CAST(p_partkey % 97 AS VARCHAR) AS n2, NULL::VARCHAR AS n3 FROM part WHERE p_partkey % 3 <> 0""")
def numeric_row_table(spark, sf):
    p = table(spark, sf, "part")
    line = F.when(F.col("p_partkey") % 3 != 0, F.concat_ws(" ", "p_name", F.concat(F.col("p_size").cast("string"), F.lit(",")), F.concat(F.lit("."), (F.col("p_partkey") % 97).cast("string")))).otherwise(F.col("p_name"))
    rows = numeric_rows(p.select("p_partkey", line.alias("line")), ["p_partkey"], "line")
    flat = ragged(rows, ["p_partkey"], 3)
    return rows.join(flat.drop("label"), "p_partkey").select("p_partkey", "label", "nums", "n1", "n2", "n3")


@query("""
SELECT doc_id, unnest(range(len(parts)))::INT AS leaf, unnest(list_transform(parts, lambda x: md5(array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(y)), lambda y: y <> ''), '|')))) AS digest
FROM (SELECT doc_id, list_transform(range(0, length(text) + 1, 300), lambda i: substr(text, i + 1, 300)) AS parts FROM documents)""")
def offset_slices(spark, sf):
    steps = F.transform(F.sequence(F.lit(0), F.length("text"), F.lit(300)), lambda i: F.struct(i.alias("a"), (i + 300).alias("b")))
    d = table(spark, sf, "documents").select("doc_id", "text", steps.alias("offsets"))
    return P.offset_slices(d, "doc_id", "text", "offsets").select("doc_id", "leaf", F.md5(F.array_join("lines", "|")).alias("digest"))


@query(rf"""
WITH l AS ({LINES}),
s AS (SELECT *, sum(CASE WHEN line_no = 0 OR NOT regexp_matches(line, '^[a-zé]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS para FROM l)
SELECT doc_id, para::BIGINT AS para, count(*) AS parts, md5(string_agg(line, ' ' ORDER BY line_no)) AS digest FROM s GROUP BY doc_id, para""")
def paragraph_merge(spark, sf):
    merged = P.merge_continued(lines(spark, sf).select("doc_id", "line_no", "line"), "doc_id", "line_no", "line", F.col("line").rlike("^[a-zé]"))
    return merged.select("doc_id", "para", "parts", F.md5("line").alias("digest"))
