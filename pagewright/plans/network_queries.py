"""Queries over term and person networks, discourse and search, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import discourse as D
from ..operators import network as N
from ..operators import pages as P
from ..operators import search as S
from ..sources.writers import scratch
from .text_queries import FUNCTION, SENTENCES, query, table

SOURCES = [f"src{k}" for k in range(20)]
LANGS = ["en", "de", "fr", "es"]
TOKENS = "SELECT doc_id, lang, source, unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z][a-z'']+[a-z]')) AS term FROM documents"


def tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", F.explode(T.word_tokens(F.col("text"))).alias("term")).filter(F.length("term") >= 4)


@query(f"""
SELECT term, source, lang, count(*) AS n, CASE WHEN grouping(source) = 0 THEN 'part' WHEN grouping(lang) = 0 THEN 'section' ELSE 'all' END AS level
FROM (SELECT * FROM ({TOKENS}) WHERE length(term) >= 4) GROUP BY GROUPING SETS ((term), (term, source), (term, lang)) HAVING count(*) >= 20""")
def term_freq_grouping_sets(spark, sf):
    return N.term_counts(tokens(spark, sf), "term", "source", "lang").filter("n >= 20")


KEYNESS = f"""
t AS (SELECT * FROM ({TOKENS}) WHERE length(term) >= 4),
r AS (SELECT term, count(*) * 1e6 / (SELECT count(*) FROM t WHERE source NOT IN ('src0', 'src1', 'src2')) AS pm FROM t WHERE source NOT IN ('src0', 'src1', 'src2') GROUP BY term),
x AS (SELECT term, count(*) AS f, count(DISTINCT source) AS parts FROM t WHERE source IN ('src0', 'src1', 'src2') GROUP BY term),
y AS (SELECT term, f, parts, (f / (SELECT sum(f) FROM x) * 1e6) / coalesce(pm, 0.01) AS ratio FROM x LEFT JOIN r USING (term) WHERE f >= 3 AND parts >= 2)"""


@query(f"WITH {KEYNESS} SELECT term, f, parts, round(ratio, 4) AS ratio, round(f * ln(ratio), 4) AS key FROM y WHERE ratio >= 1.5 ORDER BY f * ln(ratio) DESC, term LIMIT 260")
def keyness_terms(spark, sf):
    out = N.keyness_within(tokens(spark, sf), "term", "source", F.col("source").isin("src0", "src1", "src2"), 3, 2, 1.5, top=260)
    return out.select("term", "f", "parts", F.round("ratio", 4).alias("ratio"), F.round("key", 4).alias("key"))


# terms of sentences; the 260 terms with the largest keyness are linked
EDGES = f"""
{KEYNESS.strip()},
kt AS (SELECT term FROM y WHERE ratio >= 1.5 ORDER BY f * ln(ratio) DESC, term LIMIT 260),
{SENTENCES.strip()},
st AS (SELECT DISTINCT doc_id || ':' || sent AS b, unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z][a-z'']+[a-z]')) AS term FROM s),
su AS (SELECT * FROM st WHERE length(term) >= 4),
fr AS (SELECT term, count(*) AS n FROM su GROUP BY term),
ks AS (SELECT term, n FROM fr JOIN kt USING (term)),
pr AS (SELECT x.term AS s, y.term AS t, count(*) AS f FROM su x JOIN su y ON x.b = y.b AND x.term < y.term WHERE x.term IN (SELECT term FROM ks) AND y.term IN (SELECT term FROM ks) GROUP BY ALL HAVING count(*) >= 6),
ed AS (SELECT pr.s, pr.t, f, round(ln(f * (SELECT count(DISTINCT b) FROM su) / (p.n * q.n)), 3) + 0.0 AS pmi FROM pr JOIN ks p ON p.term = pr.s JOIN ks q ON q.term = pr.t),
pos AS (SELECT *, pmi * ln(1 + f) AS score FROM ed WHERE pmi > 0),
ends AS (SELECT s AS node, s, t, score FROM pos UNION ALL SELECT t, s, t, score FROM pos),
best AS (SELECT DISTINCT s, t FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(score, 9) DESC, s, t) AS r FROM ends) WHERE r <= 8),
net AS (SELECT pos.* FROM pos JOIN best USING (s, t))"""


def key_terms(spark, sf):
    """The kept terms, 260 at most."""
    return [r["term"] for r in keyness_terms(spark, sf).select("term").collect()]


def sentence_terms(spark, sf):
    """A sentence a row, with the array of its terms."""
    s = table(spark, sf, "documents").select(F.explode_outer(T.sentences(F.col("text"))).alias("text"))
    return s.select(F.filter(F.array_distinct(T.word_tokens(F.col("text"))), lambda w: F.length(w) >= 4).alias("terms"))


def term_pairs(spark, sf):
    """Counts of the pairs of key terms in sentences, made once and stored: 34,000 rows at most."""
    path = scratch(spark, "term-pairs")
    N.basket_pairs(sentence_terms(spark, sf), "terms", key_terms(spark, sf)).write.parquet(path)
    return spark.read.schema("s string, t string, f long, w double").parquet(path)


def term_edges(pairs):
    return N.pmi(N.pairs_as_edges(pairs, 6))


def term_network(pairs):
    edges = term_edges(pairs).filter("pmi > 0")
    return N.top_links(edges, F.round(F.col("pmi") * F.log(1 + F.col("f")), 9), 8)


@query(f"WITH {EDGES} SELECT s, t, f, pmi FROM ed")
def term_pmi_edges(spark, sf):
    return term_edges(term_pairs(spark, sf)).select("s", "t", "f", "pmi")


@query(f"WITH {EDGES} SELECT s, t, f, pmi, round(score, 6) AS score FROM net")
def term_topk_network(spark, sf):
    return term_network(term_pairs(spark, sf)).select("s", "t", "f", "pmi", F.round("score", 6).alias("score"))


@query(f"""
WITH {EDGES}, bw AS (SELECT s AS node, t AS other FROM net UNION ALL SELECT t, s FROM net)
SELECT node, count(*) AS degree, count(DISTINCT left(other, 1)) AS span FROM bw GROUP BY node HAVING count(*) >= 4 ORDER BY span DESC, degree DESC, node LIMIT 18""")
def bridges(spark, sf):
    net = term_network(term_pairs(spark, sf))
    group = N.both_ways(net).select("node").distinct().withColumn("grp", F.left("node", F.lit(1)))
    return N.bridges(net, group)


@query(f"""
WITH {EDGES}, bw AS (SELECT s AS node, t AS other, pmi, f FROM net UNION ALL SELECT t, s, pmi, f FROM net)
SELECT other, round(pmi * ln(1 + f), 6) AS score FROM bw WHERE node = (SELECT term FROM ks ORDER BY n DESC, term LIMIT 1) ORDER BY round(pmi * ln(1 + f), 9) DESC, other LIMIT 16""")
def neighbours(spark, sf):
    pairs = term_pairs(spark, sf)
    first = N.pair_counts(pairs).orderBy(F.desc("n"), "item").limit(1)
    both = N.both_ways(term_network(pairs)).join(F.broadcast(first.select(F.col("item").alias("node"))), "node", "left_semi")
    score = F.round(F.col("pmi") * F.log(1 + F.col("f")), 9)
    return both.select("other", score.alias("sc")).orderBy(F.desc("sc"), "other").limit(16).select("other", F.round("sc", 6).alias("score"))


@query(f"""
WITH {EDGES}, top AS (SELECT term FROM ks ORDER BY n DESC, term LIMIT 20)
SELECT s, t, f FROM ed WHERE s IN (FROM top) AND t IN (FROM top)""")
def density(spark, sf):
    pairs = term_pairs(spark, sf)
    return N.induced(N.pair_counts(pairs).withColumnRenamed("item", "node"), term_edges(pairs), "n", 20).select("s", "t", "f")


@query(f"""
WITH t AS (SELECT * FROM ({TOKENS}) WHERE length(term) >= 4), n AS (SELECT lang, count(*) AS a FROM t GROUP BY lang),
c AS (SELECT term, lang, count(*) / any_value(a) AS share FROM t JOIN n USING (lang) GROUP BY term, lang)
SELECT term, lang, round(share, 9) AS share FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY share DESC, list_position(['en', 'de', 'fr', 'es'], lang)) AS r FROM c) WHERE r = 1""")
def term_gravity(spark, sf):
    return N.gravity(tokens(spark, sf), "term", "lang", LANGS).withColumn("share", F.round("share", 9))


@query(f"""
WITH t AS (SELECT * FROM ({TOKENS}) WHERE length(term) >= 4), c AS (SELECT term, source, count(*) AS n FROM t GROUP BY ALL)
SELECT term, list_transform(range(0, 20), lambda k: coalesce(m['src' || k], 0)) AS dist FROM (SELECT term, map(list(source), list(n)) AS m FROM c GROUP BY term)""")
def term_vectors(spark, sf):
    return N.dense_vectors(tokens(spark, sf), "term", "source", SOURCES)


PAIRS = """
b AS (SELECT DISTINCT l_orderkey AS b, l_suppkey AS i FROM lineitem), z AS (SELECT *, count(*) OVER (PARTITION BY b) AS n FROM b), q AS (SELECT i, count(*) AS c FROM b GROUP BY i),
p AS (SELECT x.i AS s, y.i AS t, count(*) AS f, sum(1 / (x.n - 1)) AS w FROM z x JOIN z y ON x.b = y.b AND x.i < y.i GROUP BY ALL HAVING count(*) >= 2),
e AS (SELECT s, t, f, w, round(ln(f * (SELECT count(DISTINCT b) FROM b) / (u.c * v.c)), 3) + 0.0 AS pmi FROM p JOIN q u ON u.i = s JOIN q v ON v.i = t)"""


def supplier_pairs(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("b"), F.col("l_suppkey").alias("i"))
    return N.pmi(N.pair_edges(l, "b", "i", 2))


@query(f"WITH {PAIRS} SELECT s, t, f, round(w, 4) AS w, pmi FROM e")
def pair_weight_list_discount(spark, sf):
    return supplier_pairs(spark, sf).select("s", "t", "f", F.round("w", 4).alias("w"), "pmi")


@query(f"""
WITH {PAIRS}, c AS (SELECT *, round(round(w, 4) * greatest(0.1, pmi), 4) AS score FROM e), ends AS (SELECT s AS node, s, t, score FROM c UNION ALL SELECT t, s, t, score FROM c),
best AS (SELECT DISTINCT s, t FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, s, t) AS r FROM ends) WHERE r <= 10)
SELECT s, t, f, score FROM c JOIN best USING (s, t)""")
def pair_topk(spark, sf):
    return N.top_links(supplier_pairs(spark, sf), F.round(F.round("w", 4) * F.greatest(F.lit(0.1), F.col("pmi")), 4), 10).select("s", "t", "f", "score")


MENTIONS = "SELECT c_custkey, c_mktsegment AS cls, c_nationkey AS surname, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE chr((65 + c_custkey % 5)::INT) END AS first, c_custkey % 50 AS article FROM customer"


@query(f"""
WITH m AS ({MENTIONS}), i AS (SELECT cls, surname, first, count(*) AS n FROM m WHERE first <> '' GROUP BY ALL), s AS (SELECT cls, surname, count(*) FILTER (n >= 3) > 1 AS split FROM i GROUP BY ALL),
h AS (SELECT article, cls, surname, count(DISTINCT first) AS k, min(first) AS o FROM m WHERE first <> '' GROUP BY ALL)
SELECT c_custkey, CASE WHEN coalesce(split, false) THEN cls || ':' || surname || ':' || CASE WHEN first <> '' THEN first WHEN k = 1 THEN o END ELSE cls || ':' || surname END AS person
FROM m LEFT JOIN s USING (cls, surname) LEFT JOIN h USING (article, cls, surname)""")
def namesakes(spark, sf):
    c = table(spark, sf, "customer")
    first = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.char((65 + F.col("c_custkey") % 5).cast("int")))
    m = c.select("c_custkey", F.col("c_mktsegment").alias("cls"), F.col("c_nationkey").cast("string").alias("surname"), first.alias("first"), (F.col("c_custkey") % 50).alias("article"))
    return N.namesakes(m, "article", "cls", "surname", "first").select("c_custkey", "person")


@query("""
WITH c AS (SELECT o_custkey % 97 AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || ' ' || o_orderstatus ELSE o_orderpriority END AS form, count(*) AS n FROM orders GROUP BY ALL)
SELECT k, form, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n >= 2 DESC, CASE WHEN n >= 2 THEN len(string_split(form, ' ')) ELSE 0 END DESC, n DESC, form) AS r FROM c) WHERE r = 1""")
def best_form(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 97).alias("k"), F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("form"))
    return N.best_form(o, "k", "form")


# three titled names in each line made from a part's words; the SQL knows how they were made
@query("""
WITH w AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]) AS w FROM part)
SELECT p_partkey, 'Father' AS title, 'father' AS cls, w[1] AS surname, chr((65 + p_partkey % 26)::INT) AS first, chr((65 + p_partkey % 26)::INT) || '. ' || w[1] AS display FROM w
UNION ALL SELECT p_partkey, 'Br.', 'brother', 'de ' || w[2], w[1][1], w[1] || ' de ' || w[2] FROM w WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'Pope', 'pope', w[2] || ' XI', '', 'Pope ' || w[2] || ' XI' FROM w WHERE p_partkey % 3 = 0""")
def person_mentions(spark, sf):
    w = table(spark, sf, "part").select("p_partkey", F.transform(F.split("p_name", " "), lambda x: F.initcap(x)).alias("w"))
    initial = F.char((65 + F.col("p_partkey") % 26).cast("int"))
    brother = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" met Br. "), F.get("w", F.lit(0)), F.lit(" de "), F.get("w", F.lit(1)))).otherwise(F.lit(" met Br. Pr"))
    pope = F.concat(F.lit(" and Pope "), F.get("w", F.lit(1)), F.when(F.col("p_partkey") % 3 == 0, " XI").otherwise(""), F.lit("; so did Bishop Rector."))
    text = F.concat(F.lit("Then Father Rector "), initial, F.lit(". "), F.get("w", F.lit(0)), brother, pope)
    return N.person_mentions(w.select("p_partkey", text.alias("text")), ["p_partkey"], "text", offices=["Rector"])


LEXICON = {"article": ["the", "a", "an"], "link": ["of", "and", "to", "in"], "point": ["that", "this", "it"], "place": ["at", "from", "by", "on"]}


def _lexicon_sql():
    out = []
    for cat, words in LEXICON.items():
        for name, ws in ((cat, words), (f"{cat}_adj", sorted(set(words) - {"the", "of"}))):
            if name == cat or set(words) & {"the", "of"}:
                out.append(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ws)})))::BIGINT AS {name}")
    return ", ".join(out)


@query(f"SELECT doc_id, len(w)::BIGINT AS wc, {_lexicon_sql()} FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents)")
def lexicon_counts(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), 0).alias("w"))
    return D.lexicon_counts(t, "doc_id", "w", LEXICON, ["the", "of"])


@query(r"""
SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN 'manual' WHEN contains(text, '|') THEN 'table' WHEN regexp_matches(text, '^[A-Z ,.!]+$') THEN 'notice' WHEN regexp_matches(text, '(?i)\b(letter|dear|from the)\b') THEN 'letter' WHEN length(text) > 3000 THEN 'essay' ELSE 'varia' END AS register FROM documents""")
def register_classify(spark, sf):
    d = table(spark, sf, "documents").withColumn("manual", F.when(F.col("doc_id") % 100 == 0, "manual"))
    rules = [("table", F.contains("text", F.lit("|"))), ("notice", F.col("text").rlike("^[A-Z ,.!]+$")), ("letter", F.col("text").rlike(r"(?i)\b(letter|dear|from the)\b")), ("essay", F.length("text") > 3000)]
    return D.classify(d, rules, "varia", "manual").select("doc_id", "register")


@query("SELECT year(o_orderdate)::INT AS y, o_orderstatus, round(sum(o_totalprice * o_custkey) / sum(o_custkey), 4) AS mean, round(median(o_totalprice), 4) AS median, count(*) AS n FROM orders GROUP BY ALL")
def weighted_mean_by_year(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), "o_orderstatus", "o_totalprice", "o_custkey")
    m = D.weighted_means(o, ["y", "o_orderstatus"], "o_totalprice", "o_custkey")
    return m.select("y", "o_orderstatus", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), "n")


def _powers():
    out, p = [], D.MULTIPLIER
    for _ in range(30):
        out.append(p)
        p = p * p % D.MODULUS
    return out


@query(f"""
WITH s AS (SELECT s_nationkey AS g, s_suppkey, s_acctbal AS v, s_suppkey AS w, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier),
z AS (SELECT g, count(*) AS n FROM s GROUP BY g HAVING count(*) > 1), st AS (SELECT *, coalesce(sum(n * 200) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM z),
pl AS (SELECT g, n, start, d, unnest(range(n)) AS j FROM (SELECT *, unnest(range(200)) AS d FROM st)),
k AS (SELECT g, d, n, (start + d * n + j + 1)::BIGINT AS k FROM pl),
x AS (SELECT g, d, n, list_reduce(list_concat([7::BIGINT], list_transform(range(0, 30), lambda b: CASE WHEN (k >> b) & 1 = 1 THEN {_powers()}[b + 1]::BIGINT ELSE 1::BIGINT END)), lambda a, c: a * c % 2147483647) AS r FROM k),
m AS (SELECT x.g, d, sum(v * w) / sum(w) AS m FROM x JOIN s ON s.g = x.g AND s.i = (r * n) // 2147483647 GROUP BY x.g, d),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m) AS r FROM m)
SELECT g, round(max(m) FILTER (r = 11), 4) AS lo, round(max(m) FILTER (r = 190), 4) AS hi FROM o GROUP BY g""")
def bootstrap_band(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("g"), "s_suppkey", F.col("s_acctbal").alias("v"), F.col("s_suppkey").alias("w"))
    return D.bootstrap_bands(s, ["g"], "s_suppkey", "v", "w").select("g", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("""
SELECT lang, round(corr(n_chars, w), 6) AS r, round(avg(abs(n_chars - w)), 4) AS mad, round(avg(n_chars), 4) AS mean_a, round(avg(w), 4) AS mean_b, count(*) AS n FROM (SELECT lang, n_chars, len(string_split(text, ' ')) AS w FROM documents) GROUP BY lang""")
def corr_validation(spark, sf):
    d = table(spark, sf, "documents").select("lang", "n_chars", F.size(F.split("text", " ")).alias("w"))
    a = D.agreement(d, ["lang"], "n_chars", "w")
    return a.select("lang", F.round("r", 6).alias("r"), *(F.round(c, 4).alias(c) for c in ("mad", "mean_a", "mean_b")), "n")


WORDS = r"""w AS (SELECT doc_id, unnest(range(len(ws)))::INT AS pos, unnest(ws) AS form FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0b]+'), lambda x: x <> '') AS ws FROM documents)),
po AS (SELECT *, regexp_replace(strip_accents(lower(form)), '[^a-z0-9'']', '', 'g') AS term FROM w)"""
HITS = f"""{WORDS},
mt AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM po WHERE term LIKE 'whti%' OR term LIKE 'hest%'),
hi AS (SELECT doc_id, min(pos) AS first, max(pos) AS last FROM mt GROUP BY doc_id, g)"""


QUERY = ["whti", "hest"]


def found(spark, sf):
    return S.with_a_hit(table(spark, sf, "documents"), "text", QUERY).select("doc_id")


@query(f"WITH {WORDS} SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM po GROUP BY term")
def postings(spark, sf):
    return S.postings(table(spark, sf, "documents"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("tf"), F.count_distinct("doc_id").alias("df"))


@query(f"""
WITH {WORDS}, n AS (SELECT doc_id, pos, term, lead(term, 1) OVER w AS t1, lead(term, 2) OVER w AS t2 FROM po WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos FROM n WHERE term = 'of' AND t1 = 'the' AND t2 = 'and' OR term = 'in' AND t1 = 'the' AND t2 = 'of'""")
def phrase(spark, sf):
    p = S.postings(table(spark, sf, "documents"), "doc_id", "text")
    return S.phrase(p, "doc_id", ["of", "the", "and"]).union(S.phrase(p, "doc_id", ["in", "the", "of"]))


KWIC = f"""{HITS},
kw AS (SELECT doc_id, first, right(coalesce((SELECT string_agg(form, ' ' ORDER BY pos) FROM w WHERE w.doc_id = hi.doc_id AND pos BETWEEN first - 14 AND first - 1), ''), 64) AS "left",
  (SELECT string_agg(form, ' ' ORDER BY pos) FROM w WHERE w.doc_id = hi.doc_id AND pos BETWEEN first AND last) AS hit,
  left(coalesce((SELECT string_agg(form, ' ' ORDER BY pos) FROM w WHERE w.doc_id = hi.doc_id AND pos BETWEEN last + 1 AND last + 14), ''), 64) AS "right" FROM hi)"""


@query(f"WITH {KWIC} SELECT * FROM kw")
def kwic(spark, sf):
    return S.kwic(table(spark, sf, "documents"), "doc_id", "text", QUERY)


@query(f"""
WITH {KWIC}, f AS (SELECT *, trim(regexp_replace(strip_accents(lower("right")), '[^a-z]+', ' ', 'g')) AS form FROM kw)
SELECT doc_id, first, form, row_number() OVER (ORDER BY form = '', form, doc_id, first)::INT AS place FROM f""")
def kwic_sorted(spark, sf):
    lines, path = S.kwic(table(spark, sf, "documents"), "doc_id", "text", QUERY), scratch(spark, "kwic")
    lines.write.parquet(path)  # they are counted and then ranked
    return S.sorted_lines(spark.read.schema(lines.schema).parquet(path), "right", "doc_id").select("doc_id", "first", "form", "place")


@query(f"WITH {WORDS} SELECT term, count(*) AS n FROM po WHERE term LIKE 'whti%' OR term LIKE 'hest%' GROUP BY term ORDER BY n DESC, term LIMIT 12")
def forms(spark, sf):
    p = S.postings(table(spark, sf, "documents"), "doc_id", "text").filter(F.col("term").startswith("whti") | F.col("term").startswith("hest"))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(12)


@query(f"""
WITH {HITS}, r AS (SELECT doc_id, unnest(list_concat(range(first - 5, first), range(last + 1, last + 6)))::INT AS pos FROM hi)
SELECT term, count(*) AS n FROM po JOIN r USING (doc_id, pos) WHERE length(term) >= 4 AND term NOT IN ({", ".join(repr(w) for w in FUNCTION)}) AND NOT (term LIKE 'whti%' OR term LIKE 'hest%') GROUP BY term ORDER BY n DESC, term LIMIT 24""")
def collocates(spark, sf):
    return S.collocates(table(spark, sf, "documents"), "text", QUERY, FUNCTION)


@query(f"""
WITH {HITS}, h AS (SELECT DISTINCT doc_id FROM hi), d AS (SELECT * FROM documents)
SELECT source, count(h.doc_id) AS hits, count(*) AS docs, round(count(h.doc_id) * 1000 / count(*), 6) AS rate FROM d LEFT JOIN h USING (doc_id) GROUP BY source""")
def distribution(spark, sf):
    return S.distribution(found(spark, sf), table(spark, sf, "documents"), "doc_id", "source").withColumn("rate", F.round("rate", 6))


@query(f"""
WITH {HITS}, h AS (SELECT DISTINCT doc_id FROM hi)
SELECT source, lang, count(*) AS n, (grouping(source) * 2 + grouping(lang))::INT AS level FROM documents JOIN h USING (doc_id) GROUP BY GROUPING SETS ((source), (lang), (source, lang))""")
def facets(spark, sf):
    return S.facets(found(spark, sf), table(spark, sf, "documents"), "doc_id", "source", "lang")


@query(f"""
WITH {WORDS}, l AS (SELECT doc_id, count(*) AS len FROM po GROUP BY doc_id), c AS (SELECT count(*) AS n, avg(len) AS a FROM l),
t AS (SELECT doc_id, term, count(*) AS tf FROM po WHERE term IN ('thndor', 'whtion', 'hest') GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
x AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM t JOIN f USING (term) JOIN l USING (doc_id), c GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM x ORDER BY score DESC, doc_id LIMIT 20""")
def search_bm25(spark, sf):
    out = S.bm25(S.postings(table(spark, sf, "documents"), "doc_id", "text"), "doc_id", ["thndor", "whtion", "hest"])
    return out.withColumn("score", F.round("score", 6))
