"""Mixing sources to target weights by hierarchical budgeting.

The corpus is a tree: domains, in them languages, in them sources (the leaves). A leaf can give
its tokens ``max_epochs`` times, a node what its leaves can give. From the root down each node
deals its budget to its children by weight; a child that cannot use its share gives the rest
back to its siblings, and only what all siblings together cannot use has already gone to the
siblings of an ancestor, as every node's budget is held to what its subtree can give.

Each leaf then takes whole epochs of its documents and, from one more epoch, the token-prefix of
its documents in seeded order. Shares are whole tokens; all sums are exact.

The token order of a leaf is summed in two levels (by hash range, then within a range), so a
leaf that holds a third of the corpus is never sorted in one task.

Defined results for odd input: a null text has no tokens and is never selected; null keys are
one node of their own, named ''; weights that are null or not positive take nothing; repeated
rows count as often as they occur; an empty table gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_SPACE, materialise, table, text_or_empty

WIDE = "decimal(38,0)"


def weight_of(key: Column, weights: dict[str, int], default: int = 1) -> Column:
    """The weight of a key by a table, else the default."""
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(key == name, F.lit(w)).otherwise(out)
    return out


def _deal(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to nodes (parent keys, name, w, cap, parent_budget) by water-filling."""
    w, cap, given = (F.col(c).cast(WIDE) for c in ("w", "cap", "parent_budget"))
    order = Window.partitionBy(*parent).orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(0.0)), name)
    after = F.sum(w).over(order.rowsBetween(0, Window.unboundedFollowing))
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(WIDE))
    full = nodes.withColumn("full", cap * after <= w * (given - before))
    whole = Window.partitionBy(*parent)
    rest = full.withColumn("left", given - F.sum(F.when(F.col("full"), cap).otherwise(F.lit(0))).over(whole)).withColumn("open_w", F.sum(F.when(F.col("full"), F.lit(0)).otherwise(w)).over(whole))
    share = rest.withColumn("share", F.when(F.col("full"), cap).otherwise(F.floor((w * F.col("left") - F.pmod(w * F.col("left"), F.greatest(F.col("open_w"), F.lit(1)))) / F.greatest(F.col("open_w"), F.lit(1)))).cast(WIDE))
    spare = share.withColumn("spare", F.col("left") - F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("share"))).over(whole))
    place = F.row_number().over(Window.partitionBy(*parent, "full").orderBy(name))
    return spare.withColumn("place", place).withColumn("budget", (F.col("share") + F.when(~F.col("full") & (F.col("place") <= F.col("spare")), F.lit(1)).otherwise(F.lit(0))).cast("bigint"))


def leaf_budgets(leaves: DataFrame, levels: list[str], budget: tuple[int, int], max_epochs: int) -> DataFrame:
    """(levels, avail, budget) from leaves (levels, w_<level> of each level, avail).

    ``budget`` is a fraction of all available tokens as (numerator, denominator).
    """
    usable = F.lit(True)
    for level in levels:
        usable &= F.coalesce(F.col(f"w_{level}") > 0, F.lit(False))
    nodes = leaves.withColumn("cap", F.when(usable, F.col("avail") * max_epochs).otherwise(F.lit(0)).cast("bigint"))
    dealt = nodes.agg(F.least(F.sum("cap"), F.floor(F.sum("avail") * budget[0] / budget[1])).cast("bigint").alias("parent_budget"))  # one row
    done: list[str] = []
    for level in levels:
        own = nodes.groupBy(*done, level).agg(F.greatest(F.max(f"w_{level}"), F.lit(0)).alias("w"), F.sum("cap").alias("cap"))
        held = own.join(dealt, done) if done else own.crossJoin(F.broadcast(dealt))
        dealt = _deal(held, done, level).select(*done, level, F.col("budget").alias("parent_budget"))
        done = [*done, level]
    return nodes.select(*levels, "avail").join(dealt.withColumnRenamed("parent_budget", "budget"), levels)


def mix(docs: DataFrame, keys: dict[str, Column], weights: dict[str, Column], budget: tuple[int, int] = (1, 2), max_epochs: int = 1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns of every row (all by default) as ``row``, its tree keys, n_tokens, full_epochs, part_tokens.

    A document is taken full_epochs times whole and once more with its first part_tokens tokens.
    """
    levels = list(keys)
    words = F.size(F.array_remove(F.split(text_or_empty(text_col), f"[{WORD_SPACE}]+"), ""))
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if carry is None else carry))).alias("row")
    counted = docs.select(row, F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("tie"), *(F.coalesce(keys[k].cast("string"), F.lit("")).alias(k) for k in levels), *(weights[k].alias(f"w_{k}") for k in levels), words.cast("bigint").alias("n_tokens"))
    counted = materialise(counted, "mixing-counts")
    leaves = materialise(counted.groupBy(*levels).agg(*(F.max(f"w_{k}").alias(f"w_{k}") for k in levels), F.sum("n_tokens").alias("avail")), "mixing-leaves")
    plan = leaf_budgets(leaves, levels, budget, max_epochs).withColumn("full_epochs", F.coalesce(F.try_divide(F.col("budget") - F.pmod("budget", F.greatest("avail", F.lit(1))), F.col("avail")), F.lit(0)).cast("bigint")).withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("avail"))
    plan = materialise(plan.select(*levels, "full_epochs", "rest"), "mixing-plan")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    # leaves are far fewer than documents; few enough are broadcast by size, else adaptive execution splits the skewed join
    ordered = counted.drop(*(f"w_{k}" for k in levels)).join(plan, levels).withColumn("place", order).withColumn("range", F.substring("place", 1, 3))
    ranges = ordered.groupBy(*levels, "range").agg(F.sum("n_tokens").alias("n"))
    before = ranges.select(*levels, "range", F.coalesce(F.sum("n").over(Window.partitionBy(*levels).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = Window.partitionBy(*levels, "range").orderBy("place", "n_tokens", "tie").rowsBetween(Window.unboundedPreceding, -1)
    summed = ordered.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(before, [*levels, "range"])
    part = F.least(F.col("n_tokens"), F.greatest(F.lit(0), F.col("rest") - F.col("ahead") - F.col("inside")))
    return summed.select("row", *levels, "n_tokens", "full_epochs", part.cast("bigint").alias("part_tokens"))


def take(docs: DataFrame, keys: dict[str, Column], weights: dict[str, Column], length_col: str | None = None, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that the mix takes, once per epoch; a part is the text up to its last token taken."""
    mixed = mix(docs, keys, weights, text_col=text_col, **how)

    @F.udf("string", useArrow=True)
    def first_tokens(text, n):
        m = None
        for m, _ in zip(re.finditer(r"[^\x20\x09-\x0D]+", text), range(n), strict=False):
            pass
        return text[: m.end()] if m else ""

    whole = mixed.filter("full_epochs > 0 and n_tokens > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("full_epochs")))).drop("copy").union(mixed.filter("part_tokens = n_tokens and n_tokens > 0"))
    part = mixed.filter("part_tokens > 0 and part_tokens < n_tokens").withColumn("cut", first_tokens(F.col(f"row.`{text_col}`"), "part_tokens"))
    columns = [F.col("cut").alias(c) if c == text_col else F.char_length("cut").cast("long").alias(c) if c == length_col else F.col(f"row.`{c}`") for c in docs.columns]
    return whole.select("row.*").union(part.select(*columns))


def source_tree() -> tuple[dict[str, Column], dict[str, Column]]:
    """Keys and production weights: four domains by source number, languages, sources alike."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint)")
    domain = F.coalesce(F.concat(F.lit("d"), (number % 4).cast("string")), F.lit("other"))
    keys = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    weights = {"domain": weight_of(domain, {"d0": 2, "d1": 4, "d2": 3, "d3": 1}), "lang": weight_of(F.col("lang"), {"en": 5, "de": 2, "fr": 2}), "source": F.lit(1)}
    return keys, weights


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, weights = source_tree()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mix(docs, keys, weights, budget=(3, 5), max_epochs=2, seed=20, carry=["doc_id"])
    return out.select("row.doc_id", "domain", "lang", "source", "n_tokens", "full_epochs", "part_tokens")


def _level_sql(parent: str, level: str, weight: str, using: str) -> str:
    return f"""
{level}_n AS (SELECT {parent}{level}, max({weight})::HUGEINT AS w, sum(cap)::HUGEINT AS cap FROM leaves GROUP BY ALL),
{level}_h AS (SELECT * FROM {level}_n {using}),
{level}_f AS (SELECT *, cap * sum(w) OVER (PARTITION BY {parent}NULL ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= w * (given - coalesce(sum(cap) OVER (PARTITION BY {parent}NULL ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS sat FROM {level}_h),
{level}_r AS (SELECT *, given - coalesce(sum(cap) FILTER (sat) OVER (PARTITION BY {parent}NULL), 0) AS rest, coalesce(sum(w) FILTER (NOT sat) OVER (PARTITION BY {parent}NULL), 0) AS ow FROM {level}_f),
{level}_s AS (SELECT *, CASE WHEN sat THEN cap ELSE (w * rest) // greatest(ow, 1) END AS share, row_number() OVER (PARTITION BY {parent}sat ORDER BY {level}) AS place FROM {level}_r),
{level}_b AS (SELECT {parent}{level}, share + CASE WHEN NOT sat AND place <= rest - coalesce(sum(share) FILTER (NOT sat) OVER (PARTITION BY {parent}NULL), 0) THEN 1 ELSE 0 END AS given FROM {level}_s),"""


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce('d' || (try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 4), 'other') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, CASE domain WHEN 'd0' THEN 2 WHEN 'd1' THEN 4 WHEN 'd2' THEN 3 ELSE 1 END AS w_domain,
  CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w_lang, 1 AS w_source, sum(n_tokens)::HUGEINT AS avail, (sum(n_tokens) * 2)::HUGEINT AS cap FROM d GROUP BY ALL),
root AS (SELECT least(sum(cap), sum(avail) * 3 // 5)::HUGEINT AS given FROM leaves),
{_level_sql("", "domain", "w_domain", ", root")}
{_level_sql("domain, ", "lang", "w_lang", "JOIN domain_b USING (domain)")}
{_level_sql("domain, lang, ", "source", "w_source", "JOIN lang_b USING (domain, lang)")}
plan AS (SELECT domain, lang, source, CASE WHEN avail = 0 THEN 0 ELSE given // avail END AS full_epochs, given - CASE WHEN avail = 0 THEN 0 ELSE given // avail END * avail AS rest FROM leaves JOIN source_b USING (domain, lang, source)),
o AS (SELECT *, md5('20:' || full_epochs || ':' || doc_id) AS place FROM d JOIN plan USING (domain, lang, source)),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o)
SELECT doc_id, domain, lang, source, n_tokens, full_epochs::BIGINT AS full_epochs, least(n_tokens, greatest(0, rest - ahead))::BIGINT AS part_tokens FROM c
"""
