"""Order-dependent operators: page numbers, runs, gaps, sessions, merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences as sentence_array


def spread(rows: DataFrame, *keys: str, each: int = 8) -> DataFrame:
    """Rows shuffled by keys to ``each`` tasks for every part that is read, so a task's share stays as it is when the input grows."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, each * rows.rdd.getNumPartitions()), *keys)


def lines_of(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line): lines of each text with their ordinals."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def offset_slices(issues: DataFrame, key: str, text: str, offsets: str) -> DataFrame:
    """(key, leaf, lines): a long text sliced by an array of (a, b) offsets; empty lines dropped."""
    cut = issues.select(key, text, F.posexplode(offsets).alias("leaf", "at"))
    part = F.substring(F.col(text), F.col("at.a") + 1, F.col("at.b") - F.col("at.a"))
    return cut.select(key, "leaf", F.filter(F.transform(F.split(part, "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))


def reorder(rows: DataFrame, key: str, position: str, order: DataFrame) -> DataFrame:
    """Rows listed in order(key, ord array) swapped into the sorted positions of the list; old place as ``scan``."""
    listed = order.select(key, F.posexplode("ord").alias("_o", "scan"))
    places = order.select(key, F.posexplode(F.array_sort("ord")).alias("_o", "to"))
    moves = listed.join(places, [key, "_o"]).select(key, F.col("scan").alias(position), "to")
    joined = rows.join(moves, [key, position], "left")
    return joined.withColumn("scan", F.when(F.col("to").isNotNull(), F.col(position))).withColumn(position, F.coalesce("to", position)).drop("to")


def page_consensus(rows: DataFrame, key: str, pos: str, cand: str, k: int = 7, far: int = 20) -> DataFrame:
    """(key, pos, page): position plus the median offset of the k nearest readings.

    Readings further than ``far`` from the run's median offset are dropped first. Ties of
    distance go to the earlier reading; medians are cut towards zero.
    """
    votes = rows.filter(F.col(cand).isNotNull()).select(key, F.col(pos).alias("vp"), (F.col(cand) - F.col(pos)).alias("off"))
    middle = votes.groupBy(key).agg(F.median("off").alias("mid"))
    votes = votes.join(middle, key).filter(F.abs(F.col("off") - F.col("mid")) <= far).drop("mid")
    # only the k readings before and after a place can be nearest: rank readings, then a range of ranks
    ranked = votes.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("vp")))
    all_pos = rows.select(key, pos).withColumn("vp", F.lit(None).cast(votes.schema["vp"].dataType)).withColumn("here", F.col(pos))
    seen = all_pos.select(key, F.col("here").alias("at"), F.lit(0).alias("is_vote")).union(ranked.select(key, F.col("vp").alias("at"), F.lit(1).alias("is_vote")))
    upto = Window.partitionBy(key).orderBy("at", F.desc("is_vote"))
    counted = seen.withColumn("before", F.sum("is_vote").over(upto)).filter("is_vote = 0").select(key, F.col("at").alias(pos), "before").distinct()
    near = counted.withColumn("rank", F.explode(F.sequence(F.col("before") - (k - 1), F.col("before") + k))).join(ranked, [key, "rank"])
    order = Window.partitionBy(key, pos).orderBy(F.abs(F.col("vp") - F.col(pos)), "vp")
    best = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    page = best.groupBy(key, pos).agg(F.median("off").cast("int").alias("m"))
    return rows.select(key, pos).join(page, [key, pos], "left").select(key, pos, (F.col(pos) + F.col("m")).alias("page"))


def nearest_anchor(rows: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Adds ``anchor``: the value of the nearest row that has one, ties to the lower position."""
    w = Window.partitionBy(key).orderBy(pos)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))
    # the next one is the last one of the order turned round: a frame that ends at the row is extended, one that begins there is read again for each row
    turned = Window.partitionBy(key).orderBy(F.desc(pos))
    marked = rows.withColumn("_a", F.last(at, ignorenulls=True).over(turned)).withColumn("_b", F.last(at, ignorenulls=True).over(w))
    after = F.col("_b").isNull() | (F.col("_a").isNotNull() & (F.col("_a.p") - F.col(pos) < F.col(pos) - F.col("_b.p")))
    return marked.withColumn("anchor", F.when(after, F.col("_a.v")).otherwise(F.col("_b.v"))).drop("_a", "_b")


def islands(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, first, last, n): runs of consecutive values, repeated or not; null is no value."""
    w = Window.partitionBy(key).orderBy(value)
    some = spread(rows.select(key, value).filter(F.col(value).isNotNull()), key)
    begins = some.withColumn("_s", F.coalesce(F.col(value) - F.lag(value).over(w) > 1, F.lit(True)).cast("int")).withColumn("_g", F.sum("_s").over(w))
    runs = begins.groupBy(key, "_g").agg(F.min(value).alias("first"), F.max(value).alias("last"))
    return runs.select(key, "first", "last", (F.col("last") - F.col("first") + 1).cast("bigint").alias("n"))


def restart_runs(rows: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Adds ``run``: a new run begins at a value 1 that a 2 follows within two rows."""
    w = Window.partitionBy(key).orderBy(pos)
    soon = (F.lead(value, 1).over(w) == 2) | (F.lead(value, 2).over(w) == 2)
    start = (F.row_number().over(w) > 1) & (F.col(value) == 1) & F.coalesce(soon, F.lit(False))
    return rows.withColumn("_s", start.cast("int")).withColumn("run", F.sum("_s").over(w)).drop("_s")


def sessions(rows: DataFrame, key: str, pos: str, start: Column) -> DataFrame:
    """Adds ``session``: the number of start rows up to here; 0 before the first."""
    w = Window.partitionBy(key).orderBy(pos)
    return rows.withColumn("_s", F.coalesce(start.cast("int"), F.lit(0))).withColumn("session", F.sum("_s").over(w)).drop("_s")


def steady_runs(votes: DataFrame, key: str, pos: str, off: str) -> DataFrame:
    """(key, pos, off) of readings that stay after transient ones are dropped to a fixpoint.

    A run of one offset goes if it is a lone reading beside a longer run, or stands between two
    runs of one offset that together are longer; the first such run goes first. Rows come in order
    of their keys, many keys to a batch, and a batch's last key is held until it is whole.
    """
    some = votes.select(key, pos, off).filter(F.col(off).isNotNull())
    first = F.row_number().over(Window.partitionBy(key).orderBy(pos, off)) == 1

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            opens = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
            if len(opens):
                yield from steady_rows([*held, batch.slice(0, opens[-1])], off)
                held = []
            held.append(batch.slice(opens[-1] if len(opens) else 0))
        yield from steady_rows(held, off)

    return some.withColumn("_first", first).mapInArrow(fix, some.schema)


def steady_rows(batches: list[pa.RecordBatch], off: str) -> Iterator[pa.RecordBatch]:
    """The steady readings of whole keys, in order of key and position; ``_first`` marks where a key begins."""
    if not any(b.num_rows for b in batches):
        return
    rows = pa.Table.from_batches(batches).combine_chunks()
    offs, opens = rows.column(off).to_numpy(), rows.column("_first").to_numpy()
    begins = np.flatnonzero(opens | np.concatenate(([True], offs[1:] != offs[:-1])))
    lengths = np.diff(np.append(begins, len(offs)))
    barrier = opens[begins].tolist()
    kept = np.repeat(steady(offs[begins].tolist(), lengths.tolist(), barrier), lengths)
    yield from rows.drop_columns("_first").filter(pa.array(kept)).to_batches()


def steady(offs: list, sizes: list[int], opens: list[bool]) -> list[bool]:
    """Which runs stay. A run that goes changes the two before it and the one after it only, so the search goes on from there."""
    n = len(offs)
    before = [-1 if opens[k] else k - 1 for k in range(n)]
    after = [k + 1 if k + 1 < n and not opens[k + 1] else -1 for k in range(n)]
    stays, size, joined = [True] * n, list(sizes), list(range(n))
    for start in (k for k in range(n) if opens[k]):
        k = start
        while k >= 0:
            p, q = before[k], after[k]
            between = p >= 0 and q >= 0 and offs[p] == offs[q] and size[k] < size[p] + size[q]
            if not between and not (size[k] == 1 and max(size[p] if p >= 0 else 0, size[q] if q >= 0 else 0) > 1):
                k = q
                continue
            stays[k] = False
            if p >= 0 and q >= 0 and offs[p] == offs[q]:  # they are one run now
                size[p] += size[q]
                joined[q], q = p, after[q]
            if p >= 0:
                after[p] = q
            if q >= 0:
                before[q] = p
            k = p if p >= 0 else q
            for _ in range(2):
                k = before[k] if k >= 0 and before[k] >= 0 else k
    for k in range(n):
        stays[k] = stays[joined[k]]
    return stays


def blanks_before(rows: DataFrame, key: str, pos: str, blank: Column) -> DataFrame:
    """Non-blank rows with the number of blank rows since the previous non-blank one."""
    w = Window.partitionBy(key).orderBy(pos)
    some = rows.withColumn("_b", F.sum(blank.cast("int")).over(w)).filter(~blank)
    return some.withColumn("blanks", F.col("_b") - F.coalesce(F.lag("_b").over(w), F.lit(0))).drop("_b")


def gap_classes(pages: DataFrame, key: str, pos: str, page: str) -> DataFrame:
    """(key, pos, page, before, gap): how a page follows the one before: next, repeat, gap."""
    w = Window.partitionBy(key).orderBy(pos)
    lagged = pages.select(key, pos, page).withColumn("before", F.lag(page).over(w)).filter("before is not null")
    kind = F.when(F.col(page) == F.col("before") + 1, "next").when(F.col(page) <= F.col("before"), "repeat").otherwise("gap")
    return lagged.withColumn("gap", kind)


def seams(ranges: DataFrame, key: str, order: str, lo: str, hi: str) -> DataFrame:
    """Successive ranges of a key that do not join: overlap or gap."""
    w = Window.partitionBy(key).orderBy(order)
    nxt = ranges.select(key, order, hi, F.lead(lo).over(w).alias("next_lo"), F.lead(order).over(w).alias("next")).filter(f"next_lo is not null and next_lo <> {hi} + 1")
    return nxt.withColumn("seam", F.when(F.col("next_lo") <= F.col(hi), "overlap").otherwise("gap"))


def repeat_labels(pages: DataFrame, key: str, page: str, order: str) -> DataFrame:
    """Adds ``label``: a number's second and later occurrences are marked bis."""
    n = F.row_number().over(Window.partitionBy(key, page).orderBy(order))
    return pages.withColumn("label", F.when(n > 1, F.concat(F.col(page).cast("string"), F.lit(" bis"))).otherwise(F.col(page).cast("string")))


def label_check(rows: DataFrame, key: str, pos: str, page: str, label: str, around: int = 5, far: int = 20) -> DataFrame:
    """Rows whose outside label differs: misread if far off while a neighbour agrees, else differs."""
    near = Window.partitionBy(key).orderBy(pos).rowsBetween(-around, around)
    agree = F.max((F.col(label) == F.col(page)).cast("int")).over(near)
    out = rows.withColumn("_a", agree).filter(F.col(label) != F.col(page))
    return out.withColumn("verdict", F.when((F.abs(F.col(label) - F.col(page)) > far) & (F.col("_a") == 1), "misread").otherwise("differs")).drop("_a")


def merge_continued(paras: DataFrame, key: str, pos: str, text: str, goes_on: Column) -> DataFrame:
    """(key, para, text, parts): paragraphs that go on from the one before joined to it."""
    grouped = sessions(paras, key, pos, ~goes_on | (F.row_number().over(Window.partitionBy(key).orderBy(pos)) == 1))
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    return grouped.groupBy(key, F.col("session").alias("para")).agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias(text), F.count(F.lit(1)).alias("parts"))


def sentences(paras: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, sent, text): the sentences of each text, numbered from 1; made within the row."""
    found = paras.select(*keys, F.posexplode_outer(sentence_array(F.col(text))).alias("_at", text)).filter("_at is not null")
    return found.select(*keys, (F.col("_at") + 1).cast("bigint").alias("sent"), text)


def neighbours(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds previous and next value, and whether the value changes here."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w)).withColumn("changed", ~F.coalesce(F.col("previous").eqNullSafe(F.col(value)), F.lit(False)))


def near_duplicate_window(leaves: DataFrame, key: str, pos: str, signature: str, back: int = 30, least: float = 0.9, letters: int = 0) -> DataFrame:
    """(key, pos, like): leaves whose signature, of more than ``letters``, matches one of the last ``back`` leaves (earliest such).

    Leaves lie in stretches of positions, each with the last ``back`` of the one before, in order;
    a leaf is compared with those before it as they stream by, so no pair is ever a row. Lengths and
    shared trigrams rule pairs out (``trigram_bound``) before their likeness is computed.
    """
    wide = back * 16
    s = leaves.select(key, F.col(pos).cast("long").alias("_pos"), F.col(signature).alias("s")).filter((F.length("s") > 0) & F.col(key).isNotNull() & F.col(pos).isNotNull())
    own = F.floor(F.col("_pos") / wide)
    s = s.select("*", F.explode(F.array_distinct(F.array(own, F.floor((F.col("_pos") + back) / wide)))).alias("_stretch"), own.alias("_own"))
    first = F.row_number().over(Window.partitionBy(key, "_stretch").orderBy("_pos")) == 1
    marked = s.select(key, "_pos", (F.col("_stretch") == F.col("_own")).alias("_own"), "s", first.alias("_first"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions.similarity import earliest_like

        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = pa.Table.from_batches([batch.slice(at, 2_048)])
                n_held = held.num_rows if held is not None else 0
                rows = pa.concat_tables([held, part]).combine_chunks() if n_held else part.combine_chunks()
                place = rows.column("_pos").to_numpy()
                group = np.cumsum(rows.column("_first").to_numpy())
                like = earliest_like(rows.column("s").to_pylist(), place, group, n_held, rows.column("_own").to_numpy(), back, least, letters)
                hit = np.flatnonzero(like >= 0)
                if len(hit):
                    got = rows.select([key, "_pos"]).take(hit).append_column("like", pa.array(place[like[hit]], pa.int64()))
                    yield from got.combine_chunks().to_batches()
                # what the next leaf of the last stretch may be like
                held = rows.slice(int(np.flatnonzero((group == group[-1]) & (place >= place[-1] - back))[0]))

    kind = leaves.schema[pos].dataType
    out = marked.mapInArrow(find, f"{key} {leaves.schema[key].dataType.simpleString()}, _pos long, like long")
    return out.groupBy(key, F.col("_pos").cast(kind).alias(pos)).agg(F.min("like").cast(kind).alias("like"))
