"""Lexicon scores, registers, weighted means and bootstrap bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The multiplicative generator of the bootstrap: seed, multiplier, modulus; fixed values.
SEED, MULTIPLIER, MODULUS = 7, 16807, 2147483647


def lexicon_counts(texts: DataFrame, key: str, tokens: str, lexicon: dict[str, list[str]], without: list[str] = ()) -> DataFrame:
    """(key, wc, cat…, cat_adj…): tokens of each text in each category, and without the domain words.

    Categories that hold no domain word have no adjusted column.
    """
    def count(words: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda w: w.isin(words))).cast("bigint")

    columns = []
    for cat, words in lexicon.items():
        columns.append(count(words).alias(cat))
        if set(words) & set(without):
            columns.append(count(sorted(set(words) - set(without))).alias(f"{cat}_adj"))
    return texts.select(key, F.size(tokens).cast("bigint").alias("wc"), *columns)


def classify(rows: DataFrame, rules: list[tuple[str, Column]], default: str, manual: str | None = None) -> DataFrame:
    """Adds ``register``: the label of the first rule that holds, a manual label before all."""
    out = F.lit(default)
    for label, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), F.lit(label)).otherwise(out)
    return rows.withColumn("register", out if manual is None else F.coalesce(F.col(manual), out))


def weighted_means(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """(by, mean, median, n): weighted mean and plain median of a value."""
    mean = F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))
    return rows.groupBy(*by).agg(mean.alias("mean"), F.median(value).alias("median"), F.count(F.lit(1)).alias("n"))


def generator_value(k: Column) -> Column:
    """The k-th value of the generator: seed * multiplier^k mod modulus, by tables of the powers of each of six bytes."""
    out = F.lit(SEED).cast("bigint")
    for shift in range(0, 48, 8):
        powers = ", ".join(f"{pow(MULTIPLIER, d << shift, MODULUS)}L" for d in range(256))
        digit = F.shiftright(k, shift).bitwiseAND(F.lit(255))
        out = out * F.element_at(F.expr(f"array({powers})"), (digit + 1).cast("int")) % MODULUS
    return out


def bootstrap_bands(rows: DataFrame, groups: list[str], order: str, value: str, weight: str, draws: int = 200, low: int = 10, high: int = 189) -> DataFrame:
    """(groups, lo, hi): order statistics of resampled weighted means of each group of two or more.

    One sequence of the generator runs over all groups in order; a group's place in it follows
    from the sizes before it, so groups are drawn independently of one another.
    """
    # the table of groups (years) is small; one row each
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    start = sizes.withColumn("_start", F.coalesce(F.sum(F.col("_n") * draws).over(Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*groups).orderBy(order)) - 1)
    # a draw of a group is made in one task; the draws are rows times ``draws``, whatever a planner takes them for, so they are never broadcast
    each = start.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).repartition(draws, *groups, "_d")
    plan = each.withColumn("_j", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    k = F.col("_start") + F.col("_d") * F.col("_n") + F.col("_j") + 1
    drawn = plan.withColumn("_i", F.floor(generator_value(k) * F.col("_n") / MODULUS).cast("int"))
    means = drawn.join(ranked.select(*groups, "_i", F.col(value).alias("_v"), F.col(weight).alias("_w")).hint("merge"), [*groups, "_i"]).groupBy(*groups, "_d").agg(F.try_divide(F.sum(F.col("_v") * F.col("_w")), F.sum("_w")).alias("m"))
    ordered = means.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy("m")))
    return ordered.groupBy(*groups).agg(F.max(F.when(F.col("_r") == low + 1, F.col("m"))).alias("lo"), F.max(F.when(F.col("_r") == high + 1, F.col("m"))).alias("hi"))


def agreement(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, r, mad, mean_a, mean_b, n): correlation and mean absolute difference of two measures."""
    aggs = [F.corr(a, b).alias("r"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mad"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.count(F.lit(1)).alias("n")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)
