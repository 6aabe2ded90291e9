"""Tables, index registers, token repair and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import numeric_row

#: (misread, reading, where): anywhere, at the start, or in words of a length; fixed values.
MISREADINGS = [
    ("6l", "ct", 0), ("dl", "ct", 0), ("6t", "ct", 0), ("(5t", "ct", 0), ("fi", "ff", 0), ("iu", "in", 5), ("rn", "m", 5), ("tl", "tt", 5), ("tl", "ct", 0),
    ("I^", "L", 0), ("ly", "L", -1), ("ii", "u", 6), ("ii", "il", 5), ("u", "li", 6), ("c", "e", 5), ("aa", "m", 5), ("7i", "n", 0), ("lic", "he", 4), ("li", "h", 4),
]


def numeric_rows(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """(keys, label, nums): lines that are a label followed by numbers."""
    return lines.withColumn("_r", numeric_row(F.col(line))).filter("_r is not null").select(*keys, "_r.label", "_r.nums")


def ragged(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, label, n1 … nk): the numbers of a row in columns, for a flat file."""
    return rows.select(*keys, "label", *(F.try_element_at("nums", F.lit(k)).alias(f"n{k}") for k in range(1, width + 1)))


def register_references(parts: DataFrame, keys: list[str], text: str, kinds: dict[str, str], last_vol: int = 80) -> DataFrame:
    """(keys, part, vol, page, kinds): references ``vol, page`` of each ;-part with the kinds its words tell."""
    cut = parts.select(*keys, F.posexplode(F.split(text, "; *")).alias("part", "_t"))
    marks = F.array_compact(F.array(*(F.when(F.col("_t").rlike("(?i)" + rx), F.lit(k)) for k, rx in kinds.items())))
    pattern = r"\b([0-9]{1,2}), *([0-9]{1,3})\b"
    refs = cut.select(*keys, "part", marks.alias("kinds"), F.explode(F.arrays_zip(F.regexp_extract_all("_t", F.lit(pattern), 1).alias("v"), F.regexp_extract_all("_t", F.lit(pattern), 2).alias("p"))).alias("r"))
    out = refs.select(*keys, "part", F.col("r.v").cast("int").alias("vol"), F.col("r.p").cast("int").alias("page"), "kinds")
    return out.filter(F.col("vol").between(1, last_vol) & F.col("page").between(1, 999))


def first_references(refs: DataFrame, entry: list[str], order: str) -> DataFrame:
    """(entry, refs): merged references of entries in order of volume and page, first kinds win."""
    first = F.row_number().over(Window.partitionBy(*entry, "vol", "page").orderBy(order))
    some = refs.withColumn("_r", first).filter("_r = 1")
    return some.groupBy(*entry).agg(F.array_sort(F.collect_list(F.struct("vol", "page", "kinds"))).alias("refs"))


def known(tokens: DataFrame, token: str, vocab: DataFrame, reference: DataFrame, min_zipf: float = 2.0, min_count: int = 3) -> DataFrame:
    """tokens with ``known``: alphabetic, and frequent in the reference (term, zipf) or the volume (term, n)."""
    low = F.lower(token)
    out = tokens.withColumn("_l", low).join(reference.select(F.col("term").alias("_l"), "zipf"), "_l", "left").join(vocab.select(F.col("term").alias("_l"), "n"), "_l", "left")
    ok = F.col(token).rlike("^[A-Za-z']+$") & ((F.coalesce("zipf", F.lit(0.0)) >= min_zipf) | (F.coalesce("n", F.lit(0)) >= min_count))
    return out.withColumn("known", ok).drop("_l", "zipf", "n")


def repair_candidates(tokens: DataFrame, token: str, reference: DataFrame, rules: list[tuple[str, str, int]] = MISREADINGS, gate: float = 2.5, margin: float = 1.5) -> DataFrame:
    """(token, reading, rule): the first rule whose reading is frequent, and far more so than the token.

    Rules are tried on distinct tokens of four characters or more; tokens that the reference
    (term, zipf) knows well stay.
    """
    distinct = tokens.select(token).distinct().filter((F.length(token) >= 4) & F.col(token).rlike("[a-z]"))
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w"), F.lit(k).alias("rule")) for k, (a, b, w) in enumerate(rules)))
    own = reference.select(F.col("term").alias("_o"), F.col("zipf").alias("zo"))
    base = distinct.withColumn("_o", F.lower(token)).join(own, "_o", "left").withColumn("zo", F.coalesce("zo", F.lit(0.0))).filter("zo < 2.0")
    tried = base.withColumn("r", F.explode(table)).filter(F.contains(F.col(token), F.col("r.a")) & F.when(F.col("r.w") == -1, F.startswith(F.col(token), F.col("r.a"))).otherwise(F.length(token) >= F.col("r.w")))
    at = F.instr(F.col(token), F.col("r.a"))
    reading = F.concat(F.substring(F.col(token), F.lit(1), at - 1), F.col("r.b"), F.substring(F.col(token), at + F.length("r.a"), F.length(token)))
    read = tried.select(token, "zo", reading.alias("reading"), F.col("r.rule").alias("rule")).withColumn("_c", F.lower("reading"))
    rated = read.join(reference.select(F.col("term").alias("_c"), F.col("zipf").alias("zc")), "_c")
    good = rated.filter(F.col("reading").rlike("^[A-Za-z']+$") & (F.col("zc") >= gate) & (~F.col(token).rlike("^[A-Za-z']+$") | (F.col("zc") - F.col("zo") >= margin)))
    best = F.row_number().over(Window.partitionBy(token).orderBy("rule"))
    return good.withColumn("_r", best).filter("_r = 1").select(token, "reading", "rule")


def repair(tokens: DataFrame, token: str, candidates: DataFrame, fix: dict[str, str] | None = None, keep: list[str] = ()) -> DataFrame:
    """Adds ``fixed``: a reading by eye first, then a kept word as it is, then the candidate."""
    table = F.create_map(*(F.lit(x) for kv in (fix or {"": ""}).items() for x in kv))
    joined = tokens.join(candidates.select(token, "reading"), token, "left")
    return joined.withColumn("fixed", F.coalesce(table[F.col(token)], F.when(F.col(token).isin(list(keep)), F.col(token)), "reading", token)).drop("reading")


def repair_log(fixed: DataFrame, token: str) -> DataFrame:
    """(old, new, n): what was repaired and how often."""
    return fixed.filter(F.col(token) != F.col("fixed")).groupBy(F.col(token).alias("old"), F.col("fixed").alias("new")).agg(F.count(F.lit(1)).alias("n"))


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with the rows of new in place of those of equal key."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def violations(name: str, severity: str, bad: DataFrame, detail: Column) -> DataFrame:
    """(check_name, severity, detail): one row per row that breaks a constraint."""
    return bad.select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))
