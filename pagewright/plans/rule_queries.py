"""Queries over rules of repair, headings, layout, editing and indexes.

Misread text, leaves and contents are made from the tables by small formulas; the SQL states what
the rules must give from how they were made, not by repeating the rules.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import repair as R
from ..functions import text as T
from ..operators import articles as A
from ..operators import headings as H
from ..operators import layout as Y
from ..operators import tables as B
from ..operators.pages import spread
from ..sources import readers, writers
from .text_queries import query, table

def key():
    return F.col("p_partkey")


def s(c):
    return c.cast("string")


def parts(spark, sf):
    """Parts with their two words and a number of two figures."""
    return table(spark, sf, "part").withColumn("w", F.split("p_name", " ")).withColumn("n", key() % 90 + 10)


@query("""
WITH p AS (SELECT p_partkey, p_name, p_partkey % 90 + 10 AS n FROM part)
SELECT p_partkey, '1' || n || 'th' AS ordinal, ['fact', 'subjected', 'aspect', 'October', 'product'][p_partkey % 5 + 1] AS ligature, 'in 18' || n || ' and 190' || (p_partkey % 10) || ' as in 1' || (500 + p_partkey % 400) AS years,
  'the EXECUTION of ' || p_name AS signature, ['José', 'León', 'the', 'object', NULL][p_partkey % 5 + 1] AS six, ['objects', 'Müller', 'acting', NULL, NULL][p_partkey % 5 + 1] AS doubtful FROM p""")
def misread_tokens(spark, sf):
    p = parts(spark, sf)
    pick = lambda *items: F.element_at(F.array(*(F.lit(x) for x in items)), (key() % 5 + 1).cast("int"))
    six = pick("Jos6", "Le6n", "th6", "obje6", "6")
    doubtful = pick("objedls", "Miiller", "adling", "Moedling", "plain")
    years = F.concat(F.lit("in i8"), s(F.col("n")), F.lit(" and igo"), s(key() % 10), F.lit(" as in 1 "), s(500 + key() % 400))
    signed = F.concat(F.lit("the EXECUTI0N of "), "p_name", F.lit(" Vol. XXIX. No. i. 2"))
    return p.select(
        "p_partkey",
        R.ordinal(F.concat(F.lit("i"), s(F.col("n")), F.lit("tli"))).alias("ordinal"),
        R.ligature(pick("fa6l", "subje6ted", "aspe(5t", "06lober", "produc5l")).alias("ligature"),
        R.join_years(R.misread_years(years)).alias("years"),
        R.drop_signature(R.join_years(signed)).alias("signature"),
        R.accented_six(six, F.when(six == "obje6", 5.0), F.when(six == "th6", 7.0)).alias("six"),
        R.doubtful_reading(doubtful, F.when(doubtful == "Moedling", 3.0), F.lit(None).cast("double"), F.lit(1.0), F.when(doubtful == "Miiller", 4.0)).alias("doubtful"),
    )


@query("""
WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), c AS (SELECT p_partkey, upper(w[1][1]) || w[1][2:] AS a, upper(w[2][1]) || w[2][2:] AS b, w FROM p)
SELECT p_partkey, 'The ' || a || ' of the ' || b || ' XIV' AS title, a || '''s ' || b AS head, p_partkey % 2 = 0 AS spoilt, p_partkey % 3 = 0 AS turned, CASE WHEN p_partkey % 3 = 0 THEN 'Our ' || b || ' in ' || a ELSE a || ' ' || b END AS uninverted,
  CASE WHEN p_partkey % 2 = 0 THEN [upper(w[1]) || ' OF THE ' || upper(w[2]), 'BY FR. X'] ELSE [upper(w[1]) || '. IN ' || upper(w[2]), 'NO PART OF IT'] END AS joined, CASE WHEN p_partkey % 2 = 0 THEN b || ' Letters' ELSE 'THE ' || upper(w[1]) || ' ' || upper(w[2]) END AS chosen FROM c""")
def title_rules(spark, sf):
    p = parts(spark, sf).withColumn("a", F.upper(F.get("w", F.lit(0)))).withColumn("b", F.upper(F.get("w", F.lit(1)))).withColumn("ca", F.initcap(F.get("w", F.lit(0)))).withColumn("cb", F.initcap(F.get("w", F.lit(1))))
    even, third = key() % 2 == 0, key() % 3 == 0
    entry = F.when(third, F.concat("ca", F.lit(", Our "), "cb", F.lit(" in"))).otherwise(F.concat_ws(" ", "ca", "cb"))
    block = F.when(even, F.array(F.concat("a", F.lit(" OF THE")), F.col("b"), F.lit("BY FR. X"))).otherwise(F.array(F.concat("a", F.lit(". IN "), "b"), F.lit("NO PART OF IT")))
    heading = F.when(even, F.concat(F.lit("D U R a N "), "a")).otherwise(F.concat(F.lit("THE "), "a", F.lit(" "), "b", F.lit("^")))
    return p.select(
        "p_partkey", R.title_case(F.concat(F.lit("THE "), "a", F.lit(" OF THE "), "b", F.lit(" XIV.^^"))).alias("title"), R.capital_heads(F.concat("a", F.lit("'S "), "b")).alias("head"), R.spoiled(heading).alias("spoilt"), R.inverted(entry).alias("turned"),
        T.uninvert(entry).alias("uninverted"), H.join_title(block).alias("joined"), H.title_of(heading, F.concat("cb", F.lit(" Letters"))).alias("chosen"),
    )


@query("""
WITH p AS (SELECT p_partkey, upper(p_name) AS t, 100 + p_partkey % 400 AS n, p_partkey % 6 AS k FROM part)
SELECT p_partkey, CASE k WHEN 4 THEN '' WHEN 5 THEN NULL ELSE t END AS title, CASE WHEN k < 5 THEN n END::INT AS cand, [2, 2, 1, 1, 1, 0][k + 1] AS used, (CASE WHEN k = 5 THEN 'blank' WHEN p_partkey % 4 = 0 THEN 'front' ELSE 'text' END) AS kind FROM p""")
def page_heads(spark, sf):
    p = parts(spark, sf).withColumn("t", F.upper("p_name")).withColumn("no", s(100 + key() % 400)).withColumn("k", key() % 6)
    prose = F.lit("prose that goes on " * 40)
    lines = (
        F.when(F.col("k") == 0, F.array("no", "t", prose)).when(F.col("k") == 1, F.array(F.col("t"), F.col("no"), prose)).when(F.col("k") == 2, F.array(F.concat_ws(" ", F.concat(F.left("no", F.lit(2)), F.lit(" "), F.right("no", F.lit(1))), "t"), prose))
        .when(F.col("k") == 3, F.array(F.concat_ws(" ", "t", "no"), prose)).when(F.col("k") == 4, F.array(F.concat(F.left("no", F.lit(1)), F.lit(" "), F.right("no", F.lit(2))), prose)).otherwise(F.array().cast("array<string>"))
    )
    f = A.leaf_features(p.select("p_partkey", lines.alias("lines")))
    kind = A.leaf_kind((key() % 4 == 0) & (F.size("lines") > 0), F.lit(False), F.col("text"), F.col("body"), F.lit(5))
    h = A.split_head(F.col("lines"))
    return f.select("p_partkey", h["title"].alias("title"), h["cand"].alias("cand"), h["used"].alias("used"), kind.alias("kind"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 12 + 1 AS r FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN r END::INT AS roman, CASE WHEN p_partkey % 2 = 0 THEN r END::INT AS foot, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS body,
  ['Varia', 'Obituary', 'Supplement', NULL][p_partkey % 4 + 1] AS section, p_partkey % 4 < 2 AS heading, left(p_name || ' ' || repeat('x', 300), 300) AS caption FROM p JOIN part USING (p_partkey)""")
def leaf_marks(spark, sf):
    p = parts(spark, sf).withColumn("r", (key() % 12 + 1).cast("int"))
    roman = F.when(key() % 3 == 0, F.array(T.to_roman(F.col("r")))).when(key() % 3 == 1, F.array(F.lit("THE LIFE OF X"), T.to_roman(F.col("r")))).otherwise(F.array(F.lit("none here")))
    foot = F.when(key() % 2 == 0, F.array(F.lit("text"), F.concat(F.lit("end ("), s(F.col("r")), F.lit(")")))).otherwise(F.array(F.lit("text")))
    sect = F.element_at(F.array(F.lit("Varia."), F.lit("OBITUARY"), F.lit("Supplemcnt"), F.lit("prose of the year")), (key() % 4 + 1).cast("int"))
    page = A.page_text(p.select("p_partkey", F.array(F.lit("12"), F.when(key() % 3 == 0, "A").otherwise(F.col("p_name"))).alias("lines")), ["p_partkey"], F.col("lines"))
    caption = H.plate_caption(F.array(F.col("p_name"), F.lit("x" * 300)))
    found = p.select("p_partkey", A.roman_head(roman)["n"].alias("roman"), T.foot_number(foot).alias("foot"), H.section_of(sect).alias("section"), H.is_heading(sect).alias("heading"), caption.alias("caption"))
    return found.join(page.withColumnRenamed("text", "body"), "p_partkey")


@query("""
WITH p AS (SELECT p_partkey, upper(p_name) AS t FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [t || ' IN THE CITY.', 'A Letter to ' || p_partkey] END AS run_in, ['supplement', 'insert', 'issue-opening', 'title-page'][p_partkey % 4 + 1] AS kind,
  CASE WHEN p_partkey % 3 = 2 THEN ['A TITLE', t] ELSE ['A TITLE', t, 'text'] END AS body FROM p""")
def start_rules(spark, sf):
    p = parts(spark, sf).withColumn("t", F.upper("p_name"))
    text = F.when(key() % 2 == 0, F.concat("t", F.lit(" IN THE CITY. A Letter to "), s(key()))).otherwise(F.concat_ws(" ", F.lit("Plain prose of"), "p_name"))
    run = H.run_in_title(text)
    k = key() % 4
    kind = H.start_kind(F.lit(False), F.lit(True), k == 0, k == 1, F.lit(False), k == 2)
    head = F.array(F.lit("VILLAGE LETTERS."), F.lit("VOL. XXX. No. 2."))
    body = F.when(key() % 3 == 0, F.concat(head, F.array(F.lit("A TITLE"), "t", F.lit("text")))).when(key() % 3 == 1, F.array(F.lit("A. M. D. G."), F.lit("THE"), F.lit("A TITLE"), "t", F.lit("text"))).otherwise(F.array(F.lit("tKfje Wobj"), F.lit("| VOL. LVII, No. 3. |"), F.lit("A TITLE"), F.col("t")))
    return p.select("p_partkey", F.when(run.isNotNull(), F.array(run["title"], run["rest"])).alias("run_in"), kind.alias("kind"), H.without_masthead(body, "VILLAGELETTERS", key() % 3 == 2).alias("body"))


# a volume a nation; each customer of it opens an article of two pages, whose second page repeats its title
PIECES = """
c AS (SELECT c_nationkey AS vol, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, c_custkey FROM customer),
w AS (SELECT *, 'THE ' || translate(md5(CAST(c_custkey AS VARCHAR)), '0123456789abcdef', 'ABCDEFGHIKLMNOPQ') AS title FROM c)"""


def pieces(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("vol"), "c_custkey")
    c = c.withColumn("k", F.row_number().over(Window.partitionBy("vol").orderBy("c_custkey")))
    title = F.concat(F.lit("THE "), F.translate(F.md5(s(F.col("c_custkey"))), "0123456789abcdef", "ABCDEFGHIKLMNOPQ"))
    c = c.withColumn("title", title)
    rows = F.array(*(F.struct(F.lit(j).alias("j"), t.alias("t"), F.lit(start).alias("start")) for j, t, start in ((0, F.col("title"), "title-page"), (1, F.lit("prose"), None), (2, F.concat(F.col("title"), F.lit(".")), "title-page"), (3, F.lit("more prose"), None))))
    paras = c.select("vol", "k", F.explode(rows).alias("r"))
    return paras.select("vol", F.lit("i").alias("issue"), (F.col("k") * 4 + F.col("r.j")).alias("seq"), (F.col("k") * 2 + F.floor(F.col("r.j") / 2)).cast("int").alias("page"), "r.t", F.col("r.start").isNotNull().alias("is_head"), "r.start")


@query(f"""
WITH {PIECES}
SELECT vol, vol || '-' || lpad(CAST(k * 2 AS VARCHAR), 3, '0') AS article, (k * 2)::INT AS p0, (k * 2 + 1)::INT AS p1, 4::BIGINT AS paragraphs FROM w""")
def article_titles(spark, sf):
    return A.article_ranges(A.assign_articles(pieces(spark, sf))).drop("title")


@query(f"""
WITH {PIECES}, a AS (SELECT vol, k, CASE WHEN k % 3 = 0 AND k > 1 THEN k - 1 ELSE k END AS into_k FROM w)
SELECT vol, vol || '-' || lpad(CAST(into_k * 2 AS VARCHAR), 3, '0') AS article, (4 * count(*))::BIGINT AS paragraphs FROM a GROUP BY vol, into_k""")
def merged_articles(spark, sf):
    done = A.assign_articles(pieces(spark, sf))
    gone = done.filter("article is not null").groupBy("vol", "opened").agg(F.min("page").alias("p")).filter((F.col("p") / 2) % 3 == 0).select("vol", "opened")
    return A.merge_articles(done, gone).groupBy("vol", "article", "opened").agg(F.count(F.lit(1)).alias("paragraphs")).drop("opened")


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 50 AS page, p_name, string_split(p_name, ' ') AS w FROM part),
cut AS (SELECT p_partkey, 0 AS part, CASE WHEN p_partkey % 50 < 10 THEN w[1] ELSE p_name END AS t, NULL AS start FROM p UNION ALL SELECT p_partkey, 1, w[2], 'manual' FROM p WHERE p_partkey % 50 < 10)
SELECT p_partkey, part::INT AS part, t, start FROM cut""")
def split_edits(spark, sf):
    p = parts(spark, sf).select(F.lit(1).alias("vol"), key().alias("seq"), (key() % 50).cast("int").alias("page"), F.col("p_name").alias("t"), F.lit(None).cast("string").alias("start"), F.get("w", F.lit(1)).alias("w2"))
    cuts = p.filter("page < 10").select("page", F.col("w2").alias("mark")).distinct()
    # a paragraph may hold several marks of its page: its own second word is the only one after a blank
    some = p.drop("w2")
    own = A.split_paragraphs(some, cuts.withColumn("mark", F.col("mark")))
    return own.select(F.col("seq").alias("p_partkey"), "part", "t", "start")


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 40 AS page, p_name FROM part), d AS (SELECT page, min(p_partkey) AS k FROM p WHERE starts_with(p_name, 'red') AND page < 20 GROUP BY page)
SELECT p_partkey, CASE WHEN page BETWEEN 5 AND 9 THEN [page + 100, page + 101 - CASE WHEN page = 9 THEN 100 ELSE 0 END] ELSE [page, page + 1 + CASE WHEN page = 4 THEN 100 ELSE 0 END] END::INT[] AS pages FROM p WHERE p_partkey NOT IN (SELECT k FROM d)""")
def line_edits(spark, sf):
    p = parts(spark, sf).select("p_partkey", (key() % 40).cast("int").alias("page"), F.col("p_name").alias("t"))
    edits = spark.range(20).select(F.col("id").cast("int").alias("page"), F.lit("red").alias("prefix"))
    left = A.drop_lines(p, edits, ["p_partkey"])
    return left.select("p_partkey", A.shift_pages(F.array("page", F.col("page") + 1), F.lit(5), F.lit(9), F.lit(100)).alias("pages"))


@query("""
WITH p AS (SELECT s_suppkey AS k, s_nationkey AS vol, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT vol, (r - 1)::INT AS ord, 'Letter ' || translate(CAST(k AS VARCHAR), '0123456789', 'abcdefghik') || ' of the House' AS entry, CASE WHEN k % 2 = 0 THEN 'Fr. J. Ryan' END AS author, [100 + k % 300, 500]::INT[] AS pages, CASE WHEN r = n AND n > 1 THEN 'Obituary' ELSE 'Articles' END AS section FROM p""")
def index_lines_parsed(spark, sf):
    w = Window.partitionBy("s_nationkey")
    p = table(spark, sf, "supplier").withColumn("r", F.row_number().over(w.orderBy("s_suppkey"))).withColumn("m", F.count(F.lit(1)).over(w))
    name = F.concat(F.lit("Letter "), F.translate(s(F.col("s_suppkey")), "0123456789", "abcdefghik"))
    by = F.when(F.col("s_suppkey") % 2 == 0, " — Fr. J. Ryan").otherwise("")
    two = F.array(F.concat(name, F.lit(" of")), F.concat(F.lit("the House"), by, F.lit(" . . . "), s(100 + F.col("s_suppkey") % 300), F.lit(", 50o")))
    rows = F.when((F.col("r") == F.col("m")) & (F.col("m") > 1), F.concat(F.array(F.lit("OBITUARY.")), two)).otherwise(two)
    lines = p.select(F.col("s_nationkey").alias("vol"), F.posexplode(rows).alias("j", "line"), "r").select("vol", (F.col("r") * 3 + F.col("j")).alias("seq"), "line")
    return A.parse_index(lines)


@query("""
SELECT p_partkey, [upper(string_split(p_name, ' ')[1]), 'ST. MARY''S', 'BOSTON'] AS heads, p_partkey || ', ' || p_size AS last FROM part""")
def register_split(spark, sf):
    p = parts(spark, sf)
    text = F.concat(F.upper(F.get("w", F.lit(0))), F.lit(", J. (auth.) 1, 2. SEE ALSO Rome; ST. MARY'S College 3, 4 XIV BOSTON, "), s(key()), F.lit(", "), s(F.col("p_size")))
    e = A.register_entries(text)
    return p.select("p_partkey", F.transform(e, lambda x: x["head"]).alias("heads"), F.element_at(e, -1)["rest"].alias("last"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey % 30 AS iss, o_orderkey % 97 AS page, o_orderkey % 5 = 0 AS lab FROM orders), n AS (SELECT *, lag(page) OVER (PARTITION BY iss ORDER BY o_orderkey) AS before FROM o WHERE NOT lab)
SELECT iss, before, page FROM n WHERE page <= before""")
def page_order(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 30).alias("iss"), (F.col("o_orderkey") % 97).alias("page"), F.when(F.col("o_orderkey") % 5 == 0, "Suppl.").alias("label"))
    return H.page_order_breaks(o, "iss", "o_orderkey", "page", "label")


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY year(o_orderdate), o_orderkey)::INT AS n, o_orderkey = first_value(o_orderkey) OVER (PARTITION BY o_custkey % 30 ORDER BY year(o_orderdate), o_orderkey) AS first FROM orders""")
def record_order(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 30).alias("iss"), F.year("o_orderdate").alias("page"))
    n = H.record_numbers(o, "iss", "page", "o_orderkey")
    first = H.first_articles(o, "iss", "page", "o_orderkey").select("o_orderkey", F.lit(True).alias("f"))
    return n.join(first, "o_orderkey", "left").select("o_orderkey", "n", F.coalesce("f", F.lit(False)).alias("first"))


@query("""
WITH o AS (SELECT o_orderkey AS a, year(o_orderdate)::INT AS y FROM orders)
SELECT y, count(*) AS texts, coalesce(list(a ORDER BY a) FILTER (a % 50 = 0), []) AS studied FROM o GROUP BY y""")
def study_texts(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), F.year("o_orderdate").alias("y"))
    return H.texts_by_year(o, "a", "y", o.filter("a % 50 = 0").select("a"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 1700 + s_suppkey % 99 END::INT AS born, CASE WHEN s_suppkey % 3 > 0 THEN 'Cork' END AS born_at, CASE WHEN s_suppkey % 3 = 1 THEN 1800 + s_suppkey % 99 END::INT AS died, CASE WHEN s_suppkey % 3 > 0 THEN 'Rome' END AS died_at FROM supplier""")
def record_dates(spark, sf):
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, "undated").otherwise(F.concat(s(1700 + k % 99), F.lit("; Cork – "), F.when(k % 3 == 1, F.concat(s(1800 + k % 99), F.lit(";"))).otherwise(""), F.lit(" Rome")))
    d = H.life_dates(text)
    return table(spark, sf, "supplier").select("s_suppkey", *(d[c].alias(c) for c in ("born", "born_at", "died", "died_at")))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_name FROM part)
SELECT p_partkey, ['Father Edward Ryan', 'A NATIVE CLERGY', 'Varia', 'Plain ' || p_name, 'Fr. Y ' || p_name, 'Obituary'][k + 1] AS title, ['Obituary', 'Supplement', 'Varia', 'Obituary', 'Obituary', 'Obituary'][k + 1] AS section, CASE WHEN k = 1 THEN 'Part one' WHEN k = 3 THEN 'sub' END AS subtitle FROM p""")
def section_titles(spark, sf):
    p = parts(spark, sf).withColumn("k", key() % 6)
    pick = lambda *items: F.element_at(F.array(*(x if not isinstance(x, str) else F.lit(x) for x in items)), (F.col("k") + 1).cast("int"))
    title = pick("OBITUARY", "SUPPLEMENT", "V a R I a", F.concat(F.lit("Plain "), "p_name"), F.concat(F.lit("Fr. Y "), "p_name"), "Obituarv.")
    sub = F.when(F.col("k") == 1, "A NATIVE CLERGY · Part one").when(F.col("k") == 3, "sub")
    a = p.select("p_partkey", title.alias("title"), sub.alias("subtitle"), F.when(F.col("k") == 3, "Obituary").alias("e"), F.when(F.col("k") == 4, "name").otherwise("title").alias("start"), F.when(F.col("k") == 0, "Father Edward Ryan.").otherwise("prose").alias("nxt"))
    return H.sections(a, "title", "subtitle", "e", "start", "nxt").select("p_partkey", "title", "section", "subtitle")


# leaves of an issue a customer: forty numbered leaves, then one unread and three that count from 2
@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 40 ELSE 41 END AS pos, CASE WHEN c_custkey % 2 = 0 THEN 'figures' ELSE 'heading' END AS how FROM customer")
def section_begins(spark, sf):
    c = spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(43))).alias("pos"))
    even = F.col("c_custkey") % 2 == 0
    cand = F.when(F.col("pos") < 40, F.col("pos") + 5).when((F.col("pos") > 40) & even, F.col("pos") - 39)
    titled = (F.col("pos") == 41) & ~even
    leaves = c.select("c_custkey", "pos", cand.alias("cand"), F.when(titled, "Supplcment.").otherwise("prose of the page").alias("line"), F.when(titled, None).otherwise("A HEAD").alias("head"), F.lit(None).cast("int").alias("roman"))
    return H.section_start(leaves, "c_custkey", "pos", "line", "head", "cand", "roman")


@query("""
WITH c AS (SELECT c_custkey, unnest(range(0, 6)) AS pos FROM customer)
SELECT c_custkey, pos::INT AS pos, pos NOT IN (2, 3) AS text, pos = 5 AND c_custkey % 3 <> 0 AS signature, pos = 4 AS agrees FROM c""")
def leaf_rules(spark, sf):
    c = spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos"))
    at = lambda *xs: F.element_at(F.array(*(x if not isinstance(x, (str, int, bool, type(None))) else F.lit(x) for x in xs)), F.col("pos") + 1)
    letters = F.translate(F.concat(F.lit("THE HOUSE AT X"), s(F.col("c_custkey"))), "0123456789", "ABCDEFGHIK")
    carried = F.when(F.col("c_custkey") % 3 == 0, letters).otherwise("QUITE ANOTHER HEAD")
    leaves = c.select(
        "c_custkey", "pos", F.lit(True).alias("t"), at(3000, 3000, 300, 900, 3000, 3000).alias("chars"), at(50, 51, 99, None, 53, 5).cast("int").alias("cand"), at(50, 51, 52, 53, 53, 54).alias("page"),
        at("A RUNNING HEAD", carried, None, None, None, letters).alias("head"), F.when(F.col("pos") == 5, F.array(F.lit("5"), letters)).otherwise(F.array(F.lit("x"))).alias("lines"), F.when(F.col("pos") == 4, F.concat(letters, F.lit("."))).when(F.col("pos") == 2, "zz").alias("top"),
    )
    # each rule adds to the leaves of the one before, which lie together by issue
    kept = H.plates(leaves, "c_custkey", "pos", "t", "chars", "cand", "page", "head")
    sign = H.signatures(kept, "c_custkey", "pos", "lines", "head", "cand", "page", back=4)
    agree = H.agreeing_heads(sign.withColumn("head", F.when(F.col("pos") == 5, F.col("head"))), "c_custkey", "pos", "top", "head")
    return agree.select("c_custkey", "pos", F.col("t").alias("text"), "signature", (F.col("agrees") & (F.col("pos") == 4)).alias("agrees"))


@query("""
WITH c AS (SELECT c_custkey, unnest(range(0, 9)) AS o FROM customer)
SELECT c_custkey, o::INT AS o, CASE WHEN o < 2 THEN 'Articles' WHEN o IN (5, 6) THEN 'Varia' ELSE 'Obituary' END AS section FROM c""")
def contents_columns(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("o"))
    entry = F.when(F.col("o") < 2, "A piece").when(F.col("o").isin(5, 6), "Alaska").otherwise("Fr. A. Smith")
    e = c.select("c_custkey", "o", entry.alias("e"), F.when(F.col("o") < 7, "Articles").otherwise("Obituary").alias("section"), (F.col("o") >= 2).alias("comma"))
    return H.index_sections(e, "c_custkey", "o", "e", "section", "comma").select("c_custkey", "o", "section")


@query("""
WITH c AS (SELECT c_custkey FROM customer)
SELECT c_custkey, p::INT AS pos, (515 + p - 1)::INT AS page FROM c, (VALUES (2), (3)) v(p) WHERE c_custkey % 2 = 0""")
def closing_leaves(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos"))
    even = F.col("c_custkey") % 2 == 0
    kind = F.when(F.col("pos") == 1, F.when(even, "blank").otherwise("text")).when(F.col("pos") == 4, "plate").otherwise("text")
    leaves = c.select("c_custkey", "pos", kind.alias("kind"), F.col("pos").isin(2, 3).alias("ins"), F.when(F.col("pos") == 0, "VARIA").when(F.col("pos") == 1, "ANOTHER").alias("head"), F.when(F.col("pos") == 2, F.when(even, "VARlA").otherwise("prose")).alias("line"), F.when(F.col("pos") == 0, 515).when((F.col("pos") == 1) & ~even, 9).alias("page"))
    leaves = leaves.withColumn("kind", F.when((F.col("pos") == 4) & ~even, "text").otherwise(F.col("kind")))
    return H.closing_pages(leaves, "c_custkey", "pos", "kind", "ins", "head", "line", "page")


@query("""
WITH c AS (SELECT c_custkey FROM customer), x AS (SELECT c_custkey, unnest(range(0, 4)) AS j FROM c)
SELECT c_custkey, j::INT AS j, CASE WHEN j = 0 AND c_custkey % 2 = 0 THEN 'title-page' WHEN j = 2 THEN 'running-head' END AS start FROM x""")
def start_checks(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    heads = c.select("c_custkey", F.explode(F.array(*(F.struct(F.lit(p).alias("page"), F.lit(h).alias("head")) for p, h in ((1, "THEUNION"), (2, "THEUNION"), (3, ""), (4, "OURMISSIONS"), (5, "OURMISSIONS"))))).alias("h")).select("c_custkey", "h.*")
    first = F.when(F.col("c_custkey") % 2 == 0, "NAMED BY THE INDEX").otherwise("THE UNION")
    paras = c.select("c_custkey", F.lit(3).alias("page"), F.explode(F.array(F.struct(F.lit(0).alias("j"), first.alias("t"), F.lit(True).alias("h"), F.lit("title-page").alias("start")), *(F.struct(F.lit(j).alias("j"), F.lit(t).alias("t"), F.lit(h).alias("h"), F.lit(None).cast("string").alias("start")) for j, t, h in ((1, "prose", False), (2, "OUR MISSIONS", True), (3, "prose", False))))).alias("r"))
    paras = paras.select("c_custkey", "page", "r.*")
    indexed = c.filter("c_custkey % 2 = 0").select("c_custkey", F.lit(3).alias("page"))
    return H.confirmed_starts(paras, "c_custkey", "page", "j", "t", "h", "start", heads, indexed).select("c_custkey", "j", "start")


@query("""
WITH c AS (SELECT c_custkey, unnest(range(0, 4)) AS j FROM customer)
SELECT c_custkey, j::INT AS j, CASE WHEN j = 1 AND c_custkey % 3 = 0 THEN 'section' END AS start, NOT (j = 3 AND c_custkey % 2 = 0) AS kept FROM c""")
def section_openings(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    line = F.when(F.col("c_custkey") % 3 == 0, "VARIA").when(F.col("c_custkey") % 3 == 1, "V A A /A").otherwise("OBITUARY")
    section = F.when(F.col("c_custkey") % 3 == 1, "Varia").when(F.col("c_custkey") % 3 == 2, "Obituary")
    start = F.when(F.col("c_custkey") % 3 > 0, "title-page")
    rows = F.array(F.struct(F.lit(0).alias("j"), F.lit("prose " * 20).alias("t"), F.lit(False).alias("h"), F.lit(None).cast("string").alias("start")), F.struct(F.lit(1).alias("j"), line.alias("t"), F.lit(True).alias("h"), start.alias("start")), *(F.struct(F.lit(j).alias("j"), F.lit(t).alias("t"), F.lit(False).alias("h"), F.lit(None).cast("string").alias("start")) for j, t in ((2, "more prose"), (3, "the end"))))
    paras = c.select("c_custkey", F.lit("i").alias("i"), F.lit(1).alias("page"), F.lit("X").alias("head"), section.alias("sec"), F.explode(rows).alias("r")).select("c_custkey", "i", "page", "head", "sec", "r.*")
    got = H.section_starts(paras, ["c_custkey", "i"], "page", "j", "t", "h", "start", "head", "sec").select("c_custkey", "j", "start")
    tops = c.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    # line 3 turned round is on top of its page: a listed head in every second issue
    t = F.when(F.col("j") == 3, F.when(F.col("c_custkey") % 2 == 0, "Tbe Iroquois Misslon.").otherwise("A line of prose that is no head.")).otherwise("prose")
    kept = H.listed_heads(tops.select("c_custkey", "j", (-F.col("j")).alias("o"), t.alias("t"), F.lit(None).cast("string").alias("start")), ["c_custkey"], "o", "t", "start", ["THEIROQUOISMISSION"]).select("c_custkey", "j", F.lit(True).alias("k"))
    return got.join(kept, ["c_custkey", "j"], "left").select("c_custkey", "j", "start", F.coalesce("k", F.lit(False)).alias("kept"))


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 2 = 0 AS even FROM customer)
SELECT c_custkey, even AS starred, NOT even AS roman, even AS goes_on, CASE WHEN even THEN ['text', '31'] ELSE ['insert', '30'] END AS tail, CASE WHEN even THEN 'text' ELSE 'plate' END AS verdict, CASE WHEN even THEN 1 ELSE 0 END::BIGINT AS front, 'TITLE · Second line' AS block, even AS notice FROM c""")
def layout_rules(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("even"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("pos"))
    even, late = F.col("even"), F.col("pos") >= 10
    c = c.withColumn("cand", F.when(late & ~even, F.col("pos") - 8).otherwise(F.col("pos") + 11))
    votes = Y.section_votes(c, "c_custkey", even & late, ~even & late, even & late).select("c_custkey", "starred", "roman")
    on = Y.goes_on_numbering(c, "c_custkey", "pos", "cand", late)
    read = c.withColumn("page", F.when(F.col("pos") < 19, F.col("pos") + 12))
    tail = Y.trailing(read, "c_custkey", "pos", "page", F.lit(False), even).select("c_custkey", F.array("kind", s(F.col("page"))).alias("tail"))
    issues = c.filter("pos < 2").select("c_custkey", "pos", F.when(F.col("pos") == 0, 1).otherwise(F.when(even, 23).otherwise(29)).alias("first"), F.when(F.col("pos") == 0, 20).otherwise(40).alias("last"), F.lit(2).alias("tail"))
    room = Y.room_before_next(issues, "c_custkey", "pos", "last", "first", "tail").filter("pos = 0").select("c_custkey", "verdict")
    front = Y.before_last_head(c, "c_custkey", "pos", even & (F.col("pos") == 1)).groupBy("c_custkey").agg(F.count_if("front").alias("front"))
    heads = c.filter("pos < 3").select("c_custkey", "pos", F.when(F.col("pos") == 0, "TITLE").when(F.col("pos") == 1, "Second line").otherwise("prose").alias("t"), (F.col("pos") < 2).alias("h"), (F.col("pos") == 0).alias("st"))
    block = Y.title_blocks(heads, "c_custkey", "pos", F.col("st"), F.col("h"), "t").select("c_custkey", F.col("title").alias("block"))
    notice = c.filter("pos = 0").select("c_custkey", Y.name_line(F.lit("Father John Cunningham."), F.lit("prose " * 40), F.when(even, "before.").otherwise("before,")).alias("notice"))
    out = votes
    for part in (on, tail, room, front, block, notice):
        out = out.join(part.hint("merge"), "c_custkey")  # a row an issue: too many to broadcast
    return out


@query("""
WITH p AS (SELECT p_partkey, p_name, p_partkey % 4 AS k FROM part)
SELECT p_partkey, ['fixed', 'keep', 'them', 'plain'][k + 1] AS word, k = 3 AS known, ['Ioannes', 'Aloysius', 'Thomas', 'Petrus'][k + 1] AS latin, k < 3 AS fits, ['iohannes', 'aloisi', 'thomas', 'petr'][k + 1] AS stem, ['JOHNRYAN', 'ASMITH', 'THEUNION', 'X'][k + 1] AS person FROM p""")
def name_rules(spark, sf):
    p = parts(spark, sf).withColumn("k", key() % 4)
    pick = lambda *items: F.element_at(F.array(*(F.lit(x) for x in items)), (F.col("k") + 1).cast("int"))
    ref = spark.createDataFrame([("them", 6.0), ("plain", 5.0)], "term string, zipf double")
    tokens = p.select("p_partkey", "k", pick("eye", "keep", "thern", "plain").alias("w"))
    fixed = B.repair(tokens, "w", B.repair_candidates(tokens, "w", ref), fix={"eye": "fixed"}, keep=["keep"])
    known = B.known(fixed, "w", spark.createDataFrame([("keep", 1)], "term string, n int"), ref)
    first, latin = pick("John", "Aloysius", "T.", "Paul"), pick("Ioannes", "Aloysius", "Thomas", "Petrus")
    names = p.select("p_partkey", latin.alias("latin"), T.forename_fits(first, latin, F.when(F.col("k") == 0, F.array(F.lit("john")))).alias("fits"), T.stem_name(pick("Johannes", "Aloisius", "Thomas", "Petro")).alias("stem"), H.person_name(pick("FATHER JOHN RYAN", "Br. A. Smith".upper(), "THE UNION", "Fr. x")).alias("person"))
    return known.select("p_partkey", F.col("fixed").alias("word"), "known").join(names, "p_partkey")


@query("SELECT 'thern' AS old, 'them' AS new, count(*) FILTER (p_partkey % 4 = 2) AS n FROM part UNION ALL SELECT 'eye', 'fixed', count(*) FILTER (p_partkey % 4 = 0) FROM part")
def repairs_logged(spark, sf):
    p = parts(spark, sf).select(F.element_at(F.array(*(F.lit(x) for x in ("eye", "keep", "thern", "plain"))), (key() % 4 + 1).cast("int")).alias("w"))
    ref = spark.createDataFrame([("them", 6.0), ("plain", 5.0)], "term string, zipf double")
    return B.repair_log(B.repair(p, "w", B.repair_candidates(p, "w", ref), fix={"eye": "fixed"}, keep=["keep"]), "w")


@query("""
SELECT c_custkey AS leaf, c_nationkey AS issue, CASE WHEN c_custkey % 2 = 0 THEN row_number() OVER (PARTITION BY c_nationkey, c_custkey % 2 ORDER BY c_custkey) - 1 END::INT AS n, CASE WHEN c_custkey % 4 = 0 THEN 'p' || c_custkey END AS label FROM customer""")
def viewer_labels(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("leaf"), F.col("c_nationkey").alias("issue"))
    page = F.struct(F.col("leaf").alias("leafNum"), F.when(F.col("leaf") % 4 == 0, F.concat(F.lit("p"), s(F.col("leaf")))).otherwise("").alias("pageNumber"))
    shown = c.filter("leaf % 2 = 0").groupBy("issue").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    return readers.viewer_positions(c, shown).select("leaf", "issue", "n", "label")


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 60 AS vol, c_custkey % 5 AS k FROM customer)
SELECT c_custkey, CASE WHEN k = 1 THEN vol + 1 ELSE vol END::INT AS vol, CASE WHEN k = 1 THEN vol END::INT AS printed_vol, CASE WHEN k = 2 THEN '2/3' ELSE '2' END AS no, (1872 + vol)::INT AS year, CASE WHEN k = 3 THEN 'Spring' END AS season FROM c WHERE k < 4""")
def catalogue_statements(spark, sf):
    k = F.col("c_custkey") % 5
    vol = F.col("c_custkey") % 60
    text = F.concat(F.lit("v."), s(vol), F.when(k == 1, F.concat(F.lit("[i.e. "), s(vol + 1), F.lit("]"))).otherwise(""), F.lit(":no."), F.when(k == 2, "2/3").otherwise("2"), F.lit(" ("), s(1872 + vol), F.when(k == 3, ":Spring").otherwise(""), F.lit(")"))
    rows = table(spark, sf, "customer").select("c_custkey", F.when(k < 4, text).otherwise("a loose index").alias("statement"))
    return readers.parse_catalogue(rows, "statement")[0].select("c_custkey", "vol", "printed_vol", "no", "year", "season")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) <= 1996")
def aged_issues(spark, sf):
    """Issues old enough by a term of 30 years in 2026; a younger one would be an error."""
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")).filter("year <= 1996")
    return writers.refuse_recent(o, 2026, 30).select("o_orderkey")


@query("""
WITH l AS (SELECT o_custkey % 40 AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'Other' ELSE 'Union' END || ' ' || chr((65 + o_custkey % 26)::INT) AS head FROM orders), c AS (SELECT k, regexp_replace(upper(head), '[^A-Z]', '', 'g') AS head, count(*) AS n FROM l GROUP BY ALL)
SELECT k, head, n FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, head) = 1""")
def majority_heads(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("k"), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "Other").otherwise("Union"), F.lit(" "), F.char((65 + F.col("o_custkey") % 26).cast("int"))).alias("h"))
    return A.head_names(o, "k", "h")


STOP = "['the', 'and', 'of', 'in', 'thon', 'hest']"


@query(f"""
WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z'']+')) AS w FROM documents), k AS (SELECT doc_id, len(list_filter(w, lambda x: NOT list_contains({STOP}, x))) AS rest, len(list_filter(w, lambda x: list_contains({STOP}, x))) AS shared FROM d)
SELECT doc_id, rest::INT AS rest, shared::INT AS shared, shared >= 2 AS enough, len(list_filter(range(1, 30), lambda p: p % 7 <> doc_id % 7))::INT AS missing FROM k""")
def word_sets(spark, sf):
    """Sets of words: a stop list joined of two, what is left, what is shared with a title, gaps of a range."""
    stop = F.array_union(F.array(*(F.lit(x) for x in ("the", "and", "of"))), F.array(*(F.lit(x) for x in ("in", "of", "thon", "hest"))))
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), 0))
    d = table(spark, sf, "documents").select("doc_id", w.alias("w"))
    shared = F.size(F.array_intersect("w", stop))
    gap = F.array_except(F.sequence(F.lit(1), F.lit(29)), F.filter(F.sequence(F.lit(1), F.lit(29)), lambda p: p % 7 == F.col("doc_id") % 7))
    return d.select("doc_id", F.size(F.array_except("w", stop)).alias("rest"), shared.alias("shared"), (shared >= 2).alias("enough"), F.size(gap).alias("missing"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderpriority || ' of the ' || o_orderstatus AS h, o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
SELECT o_orderkey, (r - 1) % 20 AS place, (r - 1) // 20 AS page, contains(lower(h), 'urgent of') OR starts_with(h, '2') AS found FROM o WHERE v > 1000 AND r <= 100""")
def drill_down(spark, sf):
    """Rows above a bound by value, found by part or opening of a heading, in pages of twenty; the first five pages."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(" of the "), "o_orderstatus").alias("h"), F.col("o_totalprice").alias("v"))
    top = o.filter("v > 1000").orderBy(F.desc("v"), "o_orderkey").limit(100)
    r = F.row_number().over(Window.orderBy(F.desc("v"), "o_orderkey")).cast("bigint") - 1  # a hundred rows
    found = F.contains(F.lower("h"), F.lit("urgent of")) | F.startswith("h", F.lit("2"))
    return top.withColumn("r", r).select("o_orderkey", (F.col("r") % 20).alias("place"), F.floor(F.col("r") / 20).alias("page"), found.alias("found"))


# written and read back
@query("""
SELECT doc_id % 7 AS vol, doc_id AS page_seq, len(ls)::INT AS n, md5(array_to_string(ls, '|')) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) WHERE doc_id % 7 < 3""")
def volumes_read_back(spark, sf):
    """Documents as pages of nested volumes in JSON; three volumes are read, the others' folders are not."""
    paras = table(spark, sf, "documents").select((F.col("doc_id") % 7).alias("vol"), F.col("doc_id").alias("page_seq"), F.posexplode(F.split("text", "\n")).alias("para_seq", "t"))
    path = writers.scratch(spark, "volumes")
    writers.write_volumes(writers.nest_paragraphs(paras, ["vol", "page_seq"]), path)
    back = spark.read.schema("vol long, page_seq long, paras array<struct<t:string>>").json(path).filter("vol < 3")
    return back.select("vol", "page_seq", F.size("paras").alias("n"), F.md5(F.array_join(F.transform("paras", lambda x: x["t"]), "|")).alias("digest"))


@query("SELECT p_partkey, p_name, p_retailprice, CASE WHEN p_partkey % 5 = 0 THEN 'a, \"b\"' END AS note FROM part")
def flat_file_read_back(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice", F.when(key() % 5 == 0, 'a, "b"').alias("note"))
    path = writers.scratch(spark, "flat")
    writers.write_csv(rows, path)
    return readers.read_csv(spark, path, "p_partkey long, p_name string, p_retailprice double, note string")


@query("SELECT count(*) AS n, sum(length(line))::BIGINT AS chars FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)")
def text_files_read_back(spark, sf):
    d = table(spark, sf, "documents").select(F.split("text", "\n").alias("lines"))
    path = writers.scratch(spark, "lines")
    writers.write_lines(d, path)
    whole = readers.read_texts(spark, path).select(F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line"))
    return whole.agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("line")).alias("chars"))


@query("SELECT '# Checks' || chr(10) || chr(10) || '| metric | value |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_name || ' | ' || r_regionkey || ' |', chr(10) ORDER BY r_name) || chr(10) AS report FROM region")
def check_report(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_name").alias("name"), s(F.col("r_regionkey")).alias("value"))
    return spark.createDataFrame([(writers.metric_report(r, "Checks"),)], "report string")


@query("""
SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'missing' WHEN c_nationkey = 5 THEN 'reordered' END AS override FROM customer""")
def overridden_leaves(spark, sf):
    """Overrides by hand (a JSON object, keys with an underscore are comments) onto leaves."""
    path = writers.scratch(spark, "overrides")
    spark.createDataFrame([('{"_note": {"x": 1}, "3": {"kind": "missing"}, "5": {"kind": "reordered"}}',)], "value string").coalesce(1).write.text(path)
    o = readers.read_overrides(spark, path).select(F.col("key").cast("int").alias("c_nationkey"), F.get_json_object("body", "$.kind").alias("override"))
    return table(spark, sf, "customer").join(F.broadcast(o), "c_nationkey", "left").select("c_custkey", "override")  # a list by hand


# looked up and filtered
@query("""
WITH a AS (SELECT c_nationkey AS vol, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) * 10 AS p0 FROM customer)
SELECT o_orderkey, a.id AS article, n_name AS kind, CASE WHEN a.id % 4 = 0 THEN 'own' WHEN r_name LIKE 'A%' THEN 'region' ELSE 'none' END AS filled
FROM orders o JOIN a ON o.o_custkey % 25 = a.vol AND o_orderkey % 300 BETWEEN a.p0 AND a.p0 + 9 JOIN nation n ON n.n_nationkey = a.vol JOIN region r ON r.r_regionkey = n.n_regionkey""")
def pages_to_articles(spark, sf):
    """A page's article by range, its volume's kind by key, and a value filled from the first table that has one."""
    from ..operators.linkage import first_of, range_join

    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("vol"), F.col("c_custkey").alias("id"))
    a = c.withColumn("p0", F.row_number().over(Window.partitionBy("vol").orderBy("id")) * 10).withColumn("p1", F.col("p0") + 9)
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("vol"), (F.col("o_orderkey") % 300).alias("page"))
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    found = range_join(o, a, "vol", "page", "p0", "p1", 10).join(n.select(F.col("n_nationkey").alias("vol"), F.col("n_name").alias("kind")), "vol")
    own = a.filter("id % 4 = 0").select("id", F.lit("own").alias("filled"))
    region = a.join(n.filter("r_name like 'A%'"), F.col("vol") == F.col("n_nationkey")).select("id", F.lit("region").alias("filled"))
    filled = first_of(found.withColumn("filled", F.lit(None).cast("string")).drop("filled"), "id", [("own", own), ("region", region)], "filled")
    return filled.select("o_orderkey", F.col("id").alias("article"), "kind", F.coalesce("filled", F.lit("none")).alias("filled"))


@query(r"""
WITH d AS (SELECT doc_id, lang, quality, toxic, len(string_split(text, ' ')) AS wc, regexp_matches(text, '(?i)\bthe of\b') AS named, row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 AS first FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, coalesce(quality = 1 OR named OR first, false) AS marked, lang <> 'en' AS away, wc >= 300 AND lang IN ('en', 'fr') AND toxic IS NOT NULL AS pooled FROM d""")
def measure_pool(spark, sf):
    """Texts marked by hand, by pattern or as the first of their source; away by language; pooled by length, group and a measure."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("first", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) == 1)
    marked = F.coalesce((F.col("quality") == 1) | F.col("text").rlike(r"(?i)\bthe of\b") | F.col("first"), F.lit(False))
    return d.select("doc_id", marked.alias("marked"), (F.col("lang") != "en").alias("away"), ((F.size(F.split("text", " ")) >= 300) & F.col("lang").isin("en", "fr") & F.col("toxic").isNotNull()).alias("pooled"))


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Catalogus' WHEN p_partkey % 4 = 1 THEN 'Summer retreats' WHEN p_partkey % 4 = 2 THEN 'Students of the year' ELSE p_name END AS head, p_size FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'catalogue' WHEN 1 THEN 'retreats' WHEN 2 THEN 'students' END AS kind, row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_size, p_partkey)::INT AS place FROM p WHERE p_partkey % 4 < 3 AND p_size >= 8""")
def table_kinds(spark, sf):
    """The first pattern that a table's heading meets, for tables of eight lines or more, in registry order."""
    from ..operators.discourse import classify

    k = key() % 4
    head = F.when(k == 0, "Catalogus").when(k == 1, "Summer retreats").when(k == 2, "Students of the year").otherwise(F.col("p_name"))
    p = table(spark, sf, "part").withColumn("head", head).filter("p_size >= 8")
    rules = [("catalogue", F.col("head").rlike("(?i)^catalog")), ("retreats", F.col("head").rlike("(?i)retreats?")), ("students", F.col("head").rlike("(?i)students"))]
    kinds = classify(p, rules, "none").filter("register <> 'none'")
    return kinds.select("p_partkey", F.col("register").alias("kind"), F.row_number().over(Window.partitionBy("register").orderBy("p_size", "p_partkey")).alias("place"))


# readings of a run with one stray or one sandwiched stretch, which go
@query("SELECT c_custkey, p::INT AS pos, 10 AS off FROM customer, range(1, 13) r(p) WHERE NOT (p = 6 OR (c_custkey % 2 = 0 AND p = 7))")
def steady_offsets(spark, sf):
    from ..operators.pages import steady_runs

    c = table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("pos"))
    stray = (F.col("pos") == 6) | ((F.col("c_custkey") % 2 == 0) & (F.col("pos") == 7))
    return steady_runs(c.withColumn("off", F.when(stray, 40).otherwise(10)), "c_custkey", "pos", "off")


@query("SELECT c_custkey, 12 AS pos, 3 AS seen FROM customer WHERE c_custkey % 3 = 0")
def rescanned_leaves(spark, sf):
    """A leaf scanned again within thirty leaves, with a few letters read otherwise; in every third issue it lies too far off."""
    from ..operators.pages import near_duplicate_window

    c = table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("k"))
    far = F.col("c_custkey") % 3 != 0
    pos = F.when((F.col("k") == 12) & far, 99).otherwise(F.col("k"))
    text = F.concat(*(F.translate(F.md5(F.concat(s(F.col("c_custkey")), F.lit(f"-{j}-"), s(F.when(F.col("k") == 12, 3).otherwise(F.col("k"))))), "0123456789abcdef", "ABCDEFGHIKLMNOPQ") for j in range(6)))
    read = F.when(F.col("k") == 12, F.concat(F.left(text, F.lit(100)), F.lit("XYZ"), F.substring(text, F.lit(104), F.length(text)))).otherwise(text)
    got = near_duplicate_window(c.select("c_custkey", pos.alias("pos"), read.alias("sig")), "c_custkey", "pos", "sig")
    return got.select("c_custkey", "pos", F.col("like").alias("seen"))
