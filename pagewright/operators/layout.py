"""Rules of page layout over ordered leaves: unread leaves, inserts, sections, fills, title blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(key: str, pos: str):
    return Window.partitionBy(key).orderBy(pos)


def between_read(rows: DataFrame, key: str, pos: str, page: str) -> DataFrame:
    """Adds before_page, after_page, before_pos and after_pos of the nearest read leaves of an unread one."""
    # the next read leaf is the last one of the order turned round: frames that end before the row are extended, not read again
    before = lambda order: Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col(page).isNotNull(), F.struct(F.col(page).alias("page"), F.col(pos).alias("pos")))
    out = rows.withColumn("_a", F.last(at, ignorenulls=True).over(before(F.desc(pos)))).withColumn("_b", F.last(at, ignorenulls=True).over(before(F.asc(pos))))
    for c in ("page", "pos"):
        out = out.withColumn(f"before_{c}", F.col(f"_b.{c}")).withColumn(f"after_{c}", F.col(f"_a.{c}"))
    return out.drop("_b", "_a")


def inserts(rows: DataFrame, key: str, pos: str, page: str) -> DataFrame:
    """(key, pos, after): unread leaves between two read pages that follow on are inserts after the first."""
    some = between_read(rows, key, pos, page).filter(F.col(page).isNull() & (F.col("after_page") == F.col("before_page") + 1))
    return some.select(key, pos, F.col("before_page").alias("after"))


def gap_fills(rows: DataFrame, key: str, pos: str, page: str) -> DataFrame:
    """(key, pos, page): unread leaves that are exactly as many as the numbers missing around them."""
    some = between_read(rows, key, pos, page).filter(F.col(page).isNull() & F.col("before_page").isNotNull() & F.col("after_page").isNotNull())
    room = F.col("after_page") - F.col("before_page") - 1
    w = Window.partitionBy(key, "before_pos")
    counted = some.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_k", F.row_number().over(w.orderBy(pos)))
    return counted.filter(room == F.col("_n")).select(key, pos, (F.col("before_page") + F.col("_k")).alias(page))


def lone_readings(rows: DataFrame, key: str, pos: str, cand: str, page: str, blanks: str) -> DataFrame:
    """(key, pos, page): readings that are just the page before plus one plus the blank leaves between."""
    w = _order(key, pos)
    fits = F.col(cand) == F.lag(page).over(w) + 1 + F.col(blanks)
    return rows.withColumn("_f", fits).filter("_f").select(key, pos, F.col(cand).alias(page))


def trailing(rows: DataFrame, key: str, pos: str, page: str, tabular: Column, goes_on: Column) -> DataFrame:
    """(key, pos, kind, page): leaves after the last read one of a run: plates, continued pages, or inserts.

    Tables are plates; where the run's numbering goes on by itself the leaves take the next
    numbers, else they are inserts after the last page.
    """
    last = rows.filter(F.col(page).isNotNull()).groupBy(key).agg(F.max_by(F.struct(F.col(pos).alias("pos"), F.col(page).alias("page")), pos).alias("_l"))
    tail = rows.join(last.hint("merge"), key).filter(F.col(pos) > F.col("_l.pos"))
    k = F.row_number().over(_order(key, pos))
    kind = F.when(tabular, "plate").when(goes_on, "text").otherwise("insert")
    return tail.withColumn("_k", k).withColumn("kind", kind).select(key, pos, "kind", F.when(F.col("kind") == "text", F.col("_l.page") + F.col("_k")).when(F.col("kind") == "insert", F.col("_l.page")).alias("page"))


def section_votes(rows: DataFrame, key: str, marked: Column, roman: Column, arabic: Column, least: int = 3) -> DataFrame:
    """(key, starred, roman): does a section carry marks on enough leaves, and is it paged in roman."""
    return rows.groupBy(key).agg((F.count_if(marked) >= least).alias("starred"), ((F.count_if(roman) >= least) & (F.count_if(roman) > F.count_if(arabic))).alias("roman"))


def goes_on_numbering(rows: DataFrame, key: str, pos: str, cand: str, section: Column, back: int = 5) -> DataFrame:
    """(key, goes_on): is the median reading of a section above that of the last readings before it."""
    read = rows.filter(F.col(cand).isNotNull()).withColumn("_s", section)
    start = read.filter("_s").groupBy(key).agg(F.min(pos).alias("_from"), F.median(cand).alias("_own"))
    before = read.join(start.hint("merge"), key).filter(F.col(pos) < F.col("_from")).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(pos)))).filter(F.col("_r") <= back)
    mid = before.groupBy(key).agg(F.median(cand).alias("_mid"))
    return start.join(mid.hint("merge"), key, "left").select(key, F.coalesce(F.col("_own") > F.col("_mid"), F.lit(False)).alias("goes_on"))


def carried_label(rows: DataFrame, key: str, pos: str, label: str, stays: Column) -> DataFrame:
    """Adds ``carried``: a label and the rows after it while they stay of its kind."""
    w = _order(key, pos)
    opens = F.col(label).isNotNull()
    breaks = rows.withColumn("_x", F.sum((opens | ~stays).cast("int")).over(w))
    span = Window.partitionBy(key, "_x").orderBy(pos)
    return breaks.withColumn("carried", F.first(label).over(span)).drop("_x")


def before_last_head(rows: DataFrame, key: str, pos: str, masthead: Column, within: int = 15) -> DataFrame:
    """Adds ``front``: the leaf stands before the last masthead among a run's first leaves."""
    w = Window.partitionBy(key)
    n = F.row_number().over(_order(key, pos))
    last = F.max(F.when(masthead & (F.col("_n") <= within), F.col("_n"))).over(w)
    return rows.withColumn("_n", n).withColumn("front", F.coalesce(F.col("_n") < last, F.lit(False))).drop("_n")


def room_before_next(ranges: DataFrame, key: str, order: str, last: str, first: str, tail: str) -> DataFrame:
    """(key, order, room, verdict): do the unread tail leaves of an issue fit before the next issue's first page?"""
    w = _order(key, order)
    room = F.lead(first).over(w) - F.col(last) - 1
    verdict = F.when(F.col("room").isNull() | (F.col("room") == F.col(tail)), "text").when(F.col("room") <= 0, "insert").otherwise("plate")
    return ranges.withColumn("room", room).withColumn("verdict", verdict).select(key, order, "room", "verdict")


def title_blocks(paras: DataFrame, key: str, pos: str, start: Column, heading: Column, text: str, most: int = 4) -> DataFrame:
    """(key, pos, title): each start with the headings right after it, up to ``most`` rows."""
    w = _order(key, pos)
    block = F.array(F.col(text), *(F.when(F.lead(heading & ~start, k).over(w), F.lead(text, k).over(w)) for k in range(1, most)))
    # rows count only while no gap has opened before them
    n = F.coalesce(F.nullif(F.array_position(F.transform("_t", lambda x: x.isNull()), True), F.lit(0)) - 1, F.lit(most))
    return paras.withColumn("_t", block).withColumn("_s", start).filter("_s").select(key, pos, F.array_join(F.slice("_t", 1, n.cast("int")), " · ").alias("title"))


def name_line(text: Column, next_text: Column, before: Column) -> Column:
    """Does a short line that is only a titled name open a notice: prose follows, no comma stands before."""
    named = text.rlike(r"^\s*(?:Father|Brother|F[rk]|B[rj]\^?|Mr)[.,]?\s+[A-Z][\w.'’ ^>-]{2,40}\.\s*$")
    return (F.length(text) < 50) & named & (F.length(next_text) > 150) & ~F.coalesce(before.rlike(r",\s*$"), F.lit(False))
