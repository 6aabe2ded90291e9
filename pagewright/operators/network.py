"""Term and person networks: counts, keyness, co-occurrence, top links, centre of gravity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pages import spread


def term_counts(tokens: DataFrame, term: str, part: str, section: str) -> DataFrame:
    """(term, part, section, n, level): counts by term, term and part, term and section in one pass."""
    cube = tokens.groupingSets([[term], [term, part], [term, section]], term, part, section)
    level = F.when(F.grouping(part) == 0, "part").when(F.grouping(section) == 0, "section").otherwise("all")
    return cube.agg(F.count(F.lit(1)).alias("n"), level.alias("level"))


def keyness(tokens: DataFrame, term: str, part: str, reference: DataFrame, min_f: int, min_parts: int, min_ratio: float, top: int | None = None) -> DataFrame:
    """(term, f, parts, ratio, key): terms far more frequent than in a reference (term, per_million).

    key = f ln(ratio); a term that the reference lacks counts as 0.01 per million there.
    """
    counts = tokens.groupBy(term).agg(F.count(F.lit(1)).alias("f"), F.count_distinct(part).alias("parts"))
    total = tokens.agg(F.count(F.lit(1)).alias("total"))
    some = counts.filter((F.col("f") >= min_f) & (F.col("parts") >= min_parts)).join(reference, term, "left").crossJoin(F.broadcast(total))
    return _rated(some, term, min_ratio, top)


def keyness_within(tokens: DataFrame, term: str, part: str, own: Column, min_f: int, min_parts: int, min_ratio: float, top: int | None = None) -> DataFrame:
    """As ``keyness``, for the parts that are ``own`` against the others; tokens are read and shuffled once."""
    by = tokens.groupBy(term, part).agg(F.count(F.lit(1)).alias("_n"))
    mine, rest = F.when(own, F.col("_n")), F.when(~own, F.col("_n"))
    counts = by.groupBy(term).agg(F.sum(mine).alias("f"), F.count(mine).alias("parts"), F.sum(rest).alias("_rest"))
    total = by.agg(F.sum(mine).alias("total"), F.sum(rest).alias("_all"))  # one row
    some = counts.filter((F.col("f") >= min_f) & (F.col("parts") >= min_parts)).crossJoin(F.broadcast(total)).withColumn("per_million", F.col("_rest") * 1e6 / F.col("_all"))
    return _rated(some, term, min_ratio, top)


def _rated(some: DataFrame, term: str, min_ratio: float, top: int | None) -> DataFrame:
    ratio = (F.col("f") / F.col("total") * 1e6) / F.coalesce("per_million", F.lit(0.01))
    out = some.withColumn("ratio", ratio).filter(F.col("ratio") >= min_ratio).select(term, "f", "parts", "ratio", (F.col("f") * F.log("ratio")).alias("key"))
    return out if top is None else out.orderBy(F.desc("key"), term).limit(top)


def pair_edges(baskets: DataFrame, basket: str, item: str, min_pairs: int = 1, kept: DataFrame | None = None) -> DataFrame:
    """(s, t, f, w, fs, ft, baskets): pairs of distinct items that share baskets.

    Only kept items are paired (a semi-join before the self-join). w discounts lists: each
    basket of n kept items adds 1 / (n - 1). fs and ft count the baskets of either item,
    baskets all baskets with an item, kept or not.
    """
    distinct = spread(baskets.select(basket, item), basket).distinct()
    total = distinct.select(F.count_distinct(basket).alias("baskets"))
    some = distinct if kept is None else distinct.join(kept.select(item), item, "left_semi")
    sized = some.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(basket)))
    freq = some.groupBy(item).agg(F.count(F.lit(1)).alias("_f"))
    # a basket lies in one task: its pairs are made there, from a row a basket
    whole = sized.filter((F.col("_n") > 1) & F.col(basket).isNotNull()).groupBy(basket, "_n").agg(F.sort_array(F.collect_list(item)).alias("_i"))
    left = whole.select("_n", "_i", F.posexplode("_i").alias("_at", "s"))
    pairs = left.select("_n", "s", F.explode(F.slice("_i", F.col("_at") + 2, F.size("_i"))).alias("t")).groupBy("s", "t").agg(F.count(F.lit(1)).alias("f"), F.sum(1 / (F.col("_n") - 1)).alias("w")).filter(F.col("f") >= min_pairs)
    out = pairs.join(freq.select(F.col(item).alias("s"), F.col("_f").alias("fs")), "s").join(freq.select(F.col(item).alias("t"), F.col("_f").alias("ft")), "t")
    return out.crossJoin(F.broadcast(total)).select("s", "t", "f", "w", "fs", "ft", "baskets")


def basket_pairs(baskets: DataFrame, items: str, kept: list[str]) -> DataFrame:
    """(s, t, f, w): counts of the pairs of a bounded list of kept items in baskets that are arrays.

    An item with itself stands for its baskets, two empty names for all baskets with an item.
    Pairs are made within the row, from at most as many items as are kept, and counted by partial
    sums: one scan and one shuffle of pairs, whatever the number of baskets.
    """
    some = F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isin(kept)))) if kept else F.array().cast("array<string>")
    found = baskets.select(some.alias("k"), (F.size(items) > 0).alias("any"))
    pair = lambda s, t, n: F.struct(s.alias("s"), t.alias("t"), (1 / F.nullif(n - 1, F.lit(0))).alias("w"))
    pairs = F.flatten(F.transform("k", lambda x, i: F.transform(F.slice("k", i + 1, F.size("k")), lambda y: pair(x, y, F.size("k")))))
    # explode_outer: no filter is inferred from it that would make the pairs twice
    every = found.select(F.explode_outer(F.when(F.col("any"), F.array_append(pairs, pair(F.lit(""), F.lit(""), F.lit(1))))).alias("p")).filter("p is not null")
    return every.groupBy("p.s", "p.t").agg(F.count(F.lit(1)).alias("f"), F.sum("p.w").alias("w"))


def pairs_as_edges(pairs: DataFrame, min_pairs: int = 1) -> DataFrame:
    """(s, t, f, w, fs, ft, baskets) from ``basket_pairs``, which is read several times: it should be stored."""
    own = pair_counts(pairs)
    total = pairs.filter("s = '' and t = ''").select(F.col("f").alias("baskets"))  # one row
    edges = pairs.filter((F.col("s") < F.col("t")) & (F.col("s") != "") & (F.col("f") >= min_pairs))
    out = edges.join(own.select(F.col("item").alias("s"), F.col("n").alias("fs")), "s").join(own.select(F.col("item").alias("t"), F.col("n").alias("ft")), "t")
    return out.crossJoin(F.broadcast(total)).select("s", "t", "f", "w", "fs", "ft", "baskets")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(item, n): the baskets of each kept item, from ``basket_pairs``."""
    return pairs.filter((F.col("s") == F.col("t")) & (F.col("s") != "")).select(F.col("s").alias("item"), F.col("f").alias("n"))


def basket_edges(baskets: DataFrame, items: str, kept: list[str], min_pairs: int = 1) -> DataFrame:
    """(s, t, f, w, fs, ft, baskets) as ``pair_edges``, for baskets that are arrays and a bounded list of kept items."""
    return pairs_as_edges(basket_pairs(baskets, items, kept), min_pairs)


def pmi(edges: DataFrame, digits: int = 3) -> DataFrame:
    """Adds ``pmi`` = ln(f N / (fs ft)), rounded; never a negative zero."""
    return edges.withColumn("pmi", F.round(F.log(F.col("f") * F.col("baskets") / (F.col("fs") * F.col("ft"))), digits) + F.lit(0.0))


def top_links(edges: DataFrame, score: Column, k: int) -> DataFrame:
    """The edges among the k best of either end; ties by names."""
    scored = edges.withColumn("score", score)
    ends = scored.select(F.explode(F.array("s", "t")).alias("node"), "s", "t", "score")
    best = ends.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "s", "t"))).filter(F.col("_r") <= k)
    return scored.join(best.select("s", "t").distinct(), ["s", "t"], "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, …): each edge seen from either end."""
    rest = [c for c in edges.columns if c not in ("s", "t")]
    return edges.select(F.col("s").alias("node"), F.col("t").alias("other"), *rest).union(edges.select(F.col("t").alias("node"), F.col("s").alias("other"), *rest))


def bridges(edges: DataFrame, group: DataFrame, min_degree: int = 4, top: int = 18) -> DataFrame:
    """(node, degree, span): nodes whose neighbours lie in the most groups; group has (node, grp)."""
    seen = both_ways(edges).join(group.withColumnRenamed("node", "other"), "other", "left")
    out = seen.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("grp").alias("span"))
    return out.filter(F.col("degree") >= min_degree).orderBy(F.desc("span"), F.desc("degree"), "node").limit(top)


def strongest(edges: DataFrame, node: str, score: Column, top: int = 16) -> DataFrame:
    """(other, score): the strongest neighbours of one node."""
    return both_ways(edges).filter(F.col("node") == node).select("other", score.alias("score")).orderBy(F.desc("score"), "other").limit(top)


def induced(nodes: DataFrame, edges: DataFrame, size: str, top: int) -> DataFrame:
    """The edges among the ``top`` largest nodes."""
    some = nodes.orderBy(F.desc(size), "node").limit(top).select("node")
    return edges.join(some.withColumnRenamed("node", "s"), "s", "left_semi").join(some.withColumnRenamed("node", "t"), "t", "left_semi")


def gravity(tokens: DataFrame, term: str, section: str, order: list[str]) -> DataFrame:
    """(term, section, share): where a term is relatively most frequent; ties by the section order."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col(section))
    sizes = tokens.groupBy(section).agg(F.count(F.lit(1)).alias("_all"))
    rel = tokens.groupBy(term, section).agg(F.count(F.lit(1)).alias("_n")).join(sizes, section).withColumn("share", F.col("_n") / F.col("_all"))
    best = F.row_number().over(Window.partitionBy(term).orderBy(F.desc("share"), place))
    return rel.withColumn("_r", best).filter("_r = 1").select(term, section, "share")


def dense_vectors(tokens: DataFrame, term: str, part: str, parts: list[str]) -> DataFrame:
    """(term, dist): counts over all parts in order, zeros filled."""
    counts = tokens.groupBy(term, part).agg(F.count(F.lit(1)).alias("n"))
    by = counts.groupBy(term).agg(F.map_from_entries(F.collect_list(F.struct(part, "n"))).alias("m"))
    return by.select(term, F.transform(F.array(*(F.lit(p) for p in parts)), lambda p: F.coalesce(F.col("m")[p], F.lit(0).cast("bigint"))).alias("dist"))


def namesakes(mentions: DataFrame, article: str, cls: str, surname: str, first: str, least: int = 3) -> DataFrame:
    """Adds ``person``: class and surname, with the initial where two initials are named ``least`` times.

    A bare surname is the one namesake of its article, else nobody (null).
    """
    named = mentions.filter(F.col(first) != "")
    split = named.groupBy(cls, surname, first).agg(F.count(F.lit(1)).alias("n")).groupBy(cls, surname).agg((F.count_if(F.col("n") >= least) > 1).alias("_split"))
    here = named.groupBy(article, cls, surname).agg(F.count_distinct(first).alias("_k"), F.min(first).alias("_only"))
    joined = mentions.join(split, [cls, surname], "left").join(here, [article, cls, surname], "left")
    initial = F.when(F.col(first) != "", F.col(first)).when(F.col("_k") == 1, F.col("_only"))
    person = F.when(F.coalesce("_split", F.lit(False)), F.concat(cls, F.lit(":"), surname, F.lit(":"), initial)).otherwise(F.concat(cls, F.lit(":"), surname))
    return joined.withColumn("person", person).drop("_split", "_k", "_only")


def best_form(forms: DataFrame, key: str, form: str) -> DataFrame:
    """(key, form): of the forms used at least twice the longest by words, then the most frequent, then the first."""
    counts = forms.groupBy(key, form).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc(F.col("n") >= 2), F.desc(F.when(F.col("n") >= 2, F.size(F.split(form, " "))).otherwise(0)), F.desc("n"), form)
    return counts.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(key, form, "n")


#: Titles and the class each stands for; fixed values.
TITLES = {"Father": "father", "Fr.": "father", "Brother": "brother", "Br.": "brother", "Mr.": "mr", "Bishop": "prelate", "Archbishop": "prelate", "Cardinal": "prelate", "Mgr.": "prelate", "Monsignor": "prelate", "Pope": "pope"}
#: Particles that belong to a surname; fixed values.
PARTICLES = ["de", "De", "van", "Van", "von", "Von", "La", "Le", "du", "Du", "Del", "del", "della", "Della"]


#: What a name is made of: initials and forenames, a surname with its prefix and double form, a regnal number; fixed values.
NAME_PARTS = {"forename": r"[A-Z][a-z]+|[A-Z]\.", "surname": r"(?:O'|Mc|Mac)?[A-Z][a-z]+(?:-[A-Z][a-z]+)?", "numeral": r"[XVI]{1,5}"}


def _mention_pattern(titles: list[str], most_forenames: int = 3) -> str:
    """Title, name and numeral as groups, put together from the kinds of words."""
    any_of = lambda words: "(?:" + "|".join(re.escape(w) for w in words) + ")"
    gap, part = r"\s+", NAME_PARTS
    name = f"(?:(?:{part['forename']}){gap}){{0,{most_forenames}}}(?:{any_of(PARTICLES)}{gap})?{part['surname']}"
    return rf"\b({any_of(titles)}){gap}({name})(?:{gap}({part['numeral']})\b)?"


def person_mentions(paras: DataFrame, keys: list[str], text: str, titles: dict[str, str] | None = None, offices: list[str] = ()) -> DataFrame:
    """(keys, title, cls, surname, first, display): titled names in a text; offices are no names.

    A pope is named by his numeral; other names need a surname of three letters or more that is no
    office. Offices in front of a name go.
    """
    titles = titles or TITLES
    pattern = F.lit(_mention_pattern(list(titles)))
    groups = F.arrays_zip(*(F.regexp_extract_all(text, pattern, k).alias(c) for k, c in ((1, "title"), (2, "name"), (3, "numeral"))))
    named = paras.select(*keys, F.explode(groups).alias("m")).select(*keys, "m.title", "m.numeral", F.filter(F.split("m.name", r"\s+"), lambda w: w != "").alias("w"))
    office = lambda w: F.array_contains(F.array(*(F.lit(o) for o in offices)).cast("array<string>"), w)
    # the first word that is no office opens the name
    begin = F.array_min(F.filter(F.transform("w", lambda w, i: F.when(~office(w), i + 1)), lambda i: i.isNotNull()))
    named = named.withColumn("_b", begin).filter("_b is not null").withColumn("w", F.slice("w", F.col("_b"), F.size("w")))
    taken = F.when((F.size("w") > 1) & F.get("w", F.size("w") - 2).isin(PARTICLES), 2).otherwise(1)
    named = named.withColumn("_n", taken).withColumn("cls", F.create_map(*(F.lit(x) for kv in titles.items() for x in kv))[F.col("title")])
    pope = F.col("cls") == "pope"
    surname = F.array_join(F.slice("w", F.size("w") - F.col("_n") + 1, F.col("_n")), " ")
    named = named.withColumn("surname", F.when(pope, F.concat_ws(" ", surname, "numeral")).otherwise(surname))
    fits = F.when(pope, F.col("numeral") != "").otherwise(~office(F.col("surname")) & (F.length(F.replace(F.col("surname"), F.lit(" "), F.lit(""))) >= 3))
    first = F.when(~pope & (F.size("w") > F.col("_n")), F.left(F.get("w", F.lit(0)), F.lit(1))).otherwise("")
    display = F.when(pope, F.concat(F.lit("Pope "), "surname")).otherwise(F.array_join("w", " "))
    return named.filter(fits).select(*keys, "title", "cls", "surname", first.alias("first"), display.alias("display"))
