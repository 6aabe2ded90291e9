"""Headings, mastheads and sections: where articles start, what they are called, what is no text.

Rows are leaves or paragraphs in order within a key (an issue or a volume). Neighbours are read
through windows; likeness of letters is computed in batches, and only where lengths allow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.repair import first_reading, has_shape, inverted, spoiled, strip_marks
from ..functions.similarity import best_ratio, matched_letters, ratio, ratios
from ..functions.text import digits, is_upper, norm_head, pageish, roman_page, uninvert
from .articles import PERSON_TITLES

#: Section headings and the section each opens; fixed values.
SECTIONS = {"VARIA": "Varia", "OBITUARY": "Obituary", "SUPPLEMENT": "Supplement"}
#: Words that cannot end a title, and words that a second title line may open with; fixed values.
RUNS_ON = "of the and in on at to for an with from between among amongst into upon".split()
RUNS_IN = "in on at to into for and among amongst".split()
#: A line with the number of a volume and issue; fixed value.
VOLUME_LINE = r"(?i)^\W*V[O0][LIl1]\w*[.,]*\s+[XVLIl1]+\b"
#: A title in capitals run into its first line of ordinary type; a name that stands for a notice's title; a life's dates and places; fixed values.
RUN_IN_TITLE = r"^([A-Z][A-Z0-9 ,.'’&—-]{10,}?[.:])\s+(?=[A-Z][a-z]|A\s+[A-Za-z])"
NAME_ALONE = r"^((?:Father|Brother|F[rk]\.|B[rj]\.|Mr\.|Rev\.) [A-Z][\w.' :-]{2,50}?)\.?$"
LIFE = r"^\s*(\d{4})?;?\s*(.*?)\s+–\s+(\d{4})?;?\s*(.*)$"
#: What opens the entry of a person in an index; fixed values.
PERSON_ENTRY = r"^(?:Fr|Ft|Br|Bro|Mr|Rev|Father|Brother)\b"
#: Lines that are only parts of a masthead; fixed values.
MASTHEAD_LINES = {"motto": r"(?i)^A\.?\s*M\.?\s*D\.?\s*G\.?$", "article": r"(?i)^THE$", "volume": r"(?i)^VOL\.?\s*[XVLI]+[.,]*\s*(?:No\.?\s*\w+\.?)?$"}


def alike(a: Column, b: Column, least: float = 0.75, contained: int = 6) -> Column:
    """Are two headings (letters only) the same: one holds the other, or enough of their letters agree?"""
    held = (F.length(a) > contained) & (F.length(b) > contained) & (F.contains(a, b) | F.contains(b, a))
    return F.coalesce((a != "") & (b != "") & (held | (ratio(a, b) >= least)), F.lit(False))


def like_any(a: Column, others: Column, least: float = 0.75, contained: int = 6) -> Column:
    """Is a like one of an array of headings?"""
    held = F.exists(others, lambda b: (F.length(a) > contained) & (F.length(b) > contained) & (F.contains(a, b) | F.contains(b, a)))
    return F.coalesce((a != "") & (held | (best_ratio(a, F.filter(others, lambda b: b != "")) >= least)), F.lit(False))


def shortened(a: Column, b: Column, letters: int = 12, opening: int = 6, share: float = 0.7) -> Column:
    """Is a head of so many letters a shortened or misread form of title b, which opens alike?"""
    shape = (F.length(a) >= letters) & (F.length(b) >= F.length(a) - 8) & F.startswith(b, F.left(a, F.lit(opening)))
    return F.coalesce(shape & (matched_letters(F.when(shape, a), b) >= share * F.length(a)), F.lit(False))


def is_heading(line: Column, most: int = 120) -> Column:
    """In capitals and short, or the word of a section."""
    word = F.upper(F.rtrim(F.trim(line), F.lit(".")))
    return is_upper(line) & (F.length(line) < most) | word.isin("VARIA", "OBITUARY")


def section_of(title: Column, least: float = 0.75) -> Column:
    """The section that a heading opens, misread or not; else null."""
    head = norm_head(title)
    return first_reading(*((F.coalesce(ratio(F.when(F.length(head) <= len(word) + 1, head), F.lit(word)) >= least, F.lit(False)), F.lit(name)) for word, name in SECTIONS.items()))


def person_name(heading: Column) -> Column:
    """The capital letters of a heading without a title of a person in front."""
    return F.regexp_replace(norm_head(heading), "^(?:" + "|".join(PERSON_TITLES) + ")", "")


def plate_caption(lines: Column, most: int = 300) -> Column:
    """The lines of a plate joined, up to so many characters."""
    return F.left(F.array_join(lines, " "), F.lit(most))


def join_title(lines: Column, most: int = 90) -> Column:
    """A block of heading lines with the first joined to those that go on with it.

    A line that ends in a word of RUNS_ON goes on; so does one without a stop, if the next opens
    with a word of RUNS_IN and both are short. A line that opens with "by" is never joined.
    """
    on = rf"(?i)\b(?:{'|'.join(RUNS_ON)})[.,]?\s*$"
    into = rf"(?i)^\s*(?:{'|'.join(RUNS_IN)})\b"

    def step(acc: Column, line: Column) -> Column:
        first = F.element_at(acc, 1)
        fits = ~line.rlike(r"(?i)^\s*by\b") & is_upper(first) & (F.size(acc) == 1)
        whole = F.concat(F.rtrim(first), F.lit(" "), F.ltrim(line))
        short = F.concat(F.rtrim(F.rtrim(first), F.lit(",")), F.lit(" "), F.ltrim(line))
        runs_in = ~F.endswith(F.rtrim(first), F.lit(".")) & line.rlike(into) & (F.length(first) + F.length(line) <= most)
        return F.when(fits & first.rlike(on), F.array(whole)).when(fits & runs_in, F.array(short)).otherwise(F.array_append(acc, line))

    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.when(F.size(lines) > 0, F.aggregate(rest, F.slice(lines, 1, 1), step)).otherwise(lines)


def run_in_title(text: Column) -> Column:
    """(title, rest) of a paragraph that opens with its title in capitals, else null."""
    title = F.regexp_extract(text, RUN_IN_TITLE, 1)
    return F.when((title != "") & (F.regexp_count(title, F.lit("[A-Z]{2,}")) >= 2), F.struct(title.alias("title"), F.regexp_replace(text, RUN_IN_TITLE, "").alias("rest")))


def without_masthead(body: Column, name: str, opening: Column, readable: Column | None = None) -> Column:
    """The lines of a leaf below its masthead: the periodical's name within four lines and its volume line.

    On an issue's first leaf the volume line within six lines will do, where at most one word of
    each line above it is a known one (``readable``: an array of known words a line, or null).
    """
    tops = F.transform(F.slice(body, 1, 4), lambda x: F.when(F.length(x) < 25, norm_head(x)).otherwise(""))
    named = F.nullif(F.array_position(F.transform(ratios(F.lit(name), tops), lambda r: r >= 0.85), F.lit(True)), F.lit(0))
    volume = F.array_position(F.transform(F.slice(body, 1, 6), lambda x: (F.length(x) < 40) & x.rlike(VOLUME_LINE) & x.rlike(r"(?i)\bNo\b")), F.lit(True))
    plain = F.lit(True) if readable is None else F.coalesce(F.forall(F.slice(readable, 1, F.greatest(volume.cast("int") - 1, F.lit(0))), lambda n: n <= 1), F.lit(True))
    cut = F.coalesce(named, F.when(opening & (volume > 0) & plain, volume), F.lit(0)).cast("int")
    rest = F.slice(body, cut + 1, F.greatest(F.size(body) - cut, F.lit(0)))
    below = F.when((cut > 0) & F.coalesce((F.length(F.get(rest, F.lit(0))) < 60) & (F.startswith(norm_head(F.get(rest, F.lit(0))), F.lit("VOL")) | F.get(rest, F.lit(0)).rlike(VOLUME_LINE)), F.lit(False)), 1).otherwise(0)
    rest = F.slice(rest, below + 1, F.greatest(F.size(rest) - below, F.lit(0)))
    # further masthead lines on top go
    first = F.array_position(F.transform(rest, lambda x: ~has_shape(x, MASTHEAD_LINES)), F.lit(True)).cast("int")
    return F.when(first > 0, F.slice(rest, first, F.size(rest))).otherwise(F.array().cast("array<string>"))


def start_kind(headed: Column, heading: Column, supplement: Column, insert: Column, insert_before: Column, opening: Column) -> Column:
    """How an unheaded page that opens with a heading starts an article, else null."""
    kind = F.when(supplement, "supplement").when(insert & ~insert_before, "insert").when(opening, "issue-opening").otherwise("title-page")
    return F.when(~headed & heading, kind)


def opens_issue(first_of_issue: Column, headed: Column, text: Column) -> Column:
    """Is the short first paragraph of an issue, whose capitals are spoiled, its heading?"""
    return first_of_issue & ~headed & (F.length(text) < 60) & text.rlike("[A-Za-z]{4}")


def title_of(heading: Column, entry: Column, unknown_share: Column | None = None) -> Column:
    """A piece's title: the page's heading, or the index entry where the heading is no title in capitals or is spoiled.

    An entry turned round does not replace a readable heading, nor a long or ditto-marked one a
    spoiled heading.
    """
    bad = spoiled(heading, unknown_share)
    weak = ~is_upper(heading) & ~(inverted(entry) & ~bad & (F.length(heading) > 8))
    lost = bad & ~inverted(entry) & (F.length(entry) <= 80) & ~F.contains(entry, F.lit('"'))
    return F.when(entry.isNotNull() & (weak | lost), uninvert(entry)).otherwise(strip_marks(heading))


def sections(articles: DataFrame, title: str, subtitle: str, entry_section: str, start: str, following: str) -> DataFrame:
    """Adds ``section``, and puts a title in place of a section's heading: the subtitle, or the name that follows.

    An obituary by the index, or by a name line, is one whatever its title.
    """
    own = section_of(F.col(title))
    named = F.regexp_extract(F.trim(following), NAME_ALONE, 1)
    parts = F.split(F.col(subtitle), " · ")
    promoted = own.isin("Supplement", "Obituary") & (F.coalesce(F.col(subtitle), F.lit("")) != "")
    by_name = (own == "Obituary") & ~F.coalesce(promoted, F.lit(False)) & (named != "")
    new = F.when(promoted, F.element_at(parts, 1)).when(by_name, named).when(own.isNotNull() & (own != "Supplement"), own).otherwise(F.col(title))
    rest = F.when(promoted, F.nullif(F.array_join(F.slice(parts, 2, F.size(parts)), " · "), F.lit(""))).otherwise(F.col(subtitle))
    section = F.coalesce(own, F.when((F.col(entry_section) == "Obituary") | (F.col(start) == "name"), "Obituary"))
    out = articles.select("*", section.alias("section"), new.alias("_new"), rest.alias("_rest"))
    return out.select(*(F.col("_new").alias(c) if c == title else F.col("_rest").alias(c) if c == subtitle else F.col(c) for c in articles.columns), "section")


def listed_heads(paras: DataFrame, keys: list[str], order: str, text: str, start: str, heads: list[str], top: int = 3, least: float = 0.5) -> DataFrame:
    """paras without the short lines on top of a page that are like one of its volume's listed running heads, or a bare number.

    The first line that is neither ends the top of the page; starts and lines in capitals stay.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    letters, line = norm_head(F.col(text)), F.trim(text)
    number = line.rlike(r"^[\W\dlIioOSsg]{1,5}$") & F.col(start).isNull()
    short = F.col(start).isNull() & (F.length(text) < 70) & (F.length(letters) >= 4) & ~is_upper(F.col(text))
    like = short & (best_ratio(letters, F.array(*(F.lit(h) for h in heads)).cast("array<string>")) >= least)
    ranked = paras.withColumn("_k", F.row_number().over(w)).withColumn("_d", (F.col("_k") <= top) & F.coalesce(like | ~short & number, F.lit(False)))
    kept = F.max(F.when(~F.col("_d"), 1).otherwise(0)).over(w)
    return ranked.withColumn("_stop", kept).filter("_stop = 1").drop("_k", "_d", "_stop")


def confirmed_starts(paras: DataFrame, key: str, page: str, order: str, text: str, heading: str, start: str, heads: DataFrame, indexed: DataFrame, before: int = 2, after: int = 4) -> DataFrame:
    """paras with starts checked against the running heads of the pages around them.

    heads has (key, page, head) in letters, one row a page; indexed (key, page) what the index names.
    A title-page start stays if no page before carries it and a page after does (or the index
    names the page); a heading in mid-page that the pages from here on carry, and those before do
    not, becomes a start.
    """
    # pages are numbered by their order; neighbours are met by equal numbers
    numbered = heads.select(key, page, "head").withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(page)))
    offsets = numbered.select(key, page, F.explode(F.sequence(F.col("_k") - before, F.col("_k") + after - 1)).alias("_at"), "_k")
    near = offsets.join(numbered.select(key, F.col("_k").alias("_at"), "head"), [key, "_at"]).groupBy(key, page).agg(
        F.array_compact(F.collect_list(F.when(F.col("_at") < F.col("_k"), F.col("head")))).alias("_b"),
        F.array_compact(F.collect_list(F.when(F.col("_at") >= F.col("_k"), F.col("head")))).alias("_a"),
        F.array_compact(F.collect_list(F.when(F.col("_at") > F.col("_k"), F.col("head")))).alias("_later"),
    )
    seen = paras.join(near, [key, page], "left").join(indexed.select(key, page).distinct().withColumn("_i", F.lit(True)), [key, page], "left")
    lag = F.lag(heading).over(Window.partitionBy(key, page).orderBy(order))
    seen = seen.withColumn("_h", norm_head(F.col(text))).withColumn("_under", F.coalesce(~lag, F.lit(False)))
    carried, follows = like_any(F.col("_h"), F.col("_b")), like_any(F.col("_h"), F.col("_later"))
    here = like_any(F.col("_h"), F.col("_a"))
    kept = F.when((F.col(start) == "title-page") & (carried | ~(follows | F.coalesce("_i", F.lit(False)))), F.lit(None).cast("string")).otherwise(F.col(start))
    opened = F.when(F.col(heading) & F.col(start).isNull() & F.col("_under") & here & ~carried, "running-head").otherwise(kept)
    return seen.select(*(opened.alias(c) if c == start else F.col(c) for c in paras.columns))


def section_starts(paras: DataFrame, keys: list[str], page: str, order: str, text: str, heading: str, start: str, head: str, section: str, prose: int = 80) -> DataFrame:
    """paras with VARIA headings as starts: in mid-page, under their own running head, or on top of an unheaded page of prose.

    Inside the Varia a misread VARIA opens nothing; nor does a second OBITUARY inside the Obituary.
    """
    w = Window.partitionBy(*keys, page).orderBy(order)
    mean = F.avg(F.length(text)).over(Window.partitionBy(*keys, page))
    letters, own = norm_head(F.col(text)), section_of(F.col(text))
    marked = paras.withColumn("_j", F.row_number().over(w)).withColumn("_under", F.coalesce(~F.lag(heading).over(w), F.lit(False))).withColumn("_mean", mean)
    sure = F.coalesce(F.col(start).isin("issue-opening", "supplement", "insert"), F.lit(False))
    spoilt = (F.col(section) == "Varia") & F.length(letters).between(3, 6) & (ratio(letters, F.lit("VARIA")) >= 0.6)
    again = (F.col(section) == "Obituary") & (own == "Obituary")
    opens = (own == "Varia") & (F.col("_under") | (section_of(F.coalesce(head, F.lit(""))) == "Varia") | (F.col("_j") == 1) & (F.coalesce(head, F.lit("")) == "") & (F.col("_mean") >= prose))
    new = F.when(~F.col(heading) | sure, F.col(start)).when(F.coalesce(spoilt | again, F.lit(False)), F.lit(None).cast("string")).when(F.coalesce(opens, F.lit(False)), F.coalesce(start, F.lit("section"))).otherwise(F.col(start))
    return marked.select(*(new.alias(c) if c == start else F.col(c) for c in paras.columns))


def agreeing_heads(leaves: DataFrame, key: str, pos: str, top: str, head: str, reach: int = 4) -> DataFrame:
    """Adds ``agrees``: the top line of an unheaded leaf repeats a head of the leaves around it (short ones more closely)."""
    w = Window.partitionBy(key).orderBy(pos)
    ref = F.when(F.length(norm_head(F.col(head))) >= 5, norm_head(F.col(head))).otherwise(norm_head(F.col(top)))
    marked = leaves.withColumn("_r", ref).withColumn("_t", norm_head(F.col(top)))
    others = F.concat(F.collect_list("_r").over(w.rowsBetween(-reach, -1)), F.collect_list("_r").over(w.rowsBetween(1, reach)))
    least = F.when(F.length("_t") >= 8, 0.7).otherwise(0.8)
    agrees = (F.length("_t") >= 5) & (best_ratio(F.col("_t"), others) >= least)
    return marked.withColumn("agrees", F.coalesce(agrees, F.lit(False))).drop("_r", "_t")


def section_start(leaves: DataFrame, key: str, pos: str, first_line: str, head: str, cand: str, roman: str, least: int = 10, high: int = 20) -> DataFrame:
    """(key, pos, how): where a part with its own pagination begins, by the first of three signs.

    Its heading; readings 2 and 3 on leaves that follow each other after ``least`` readings of
    ``high`` or more (it begins one leaf before, if that is unread); two roman numbers likewise.
    """
    w = Window.partitionBy(key).orderBy(pos)
    seen = leaves.withColumn("_hi", F.count_if(F.col(cand) >= high).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    seen = seen.withColumn("_next", F.lead(cand).over(w)).withColumn("_rnext", F.lead(roman).over(w)).withColumn("_back", F.lag(F.struct(F.col(pos).alias("p"), F.col(cand).alias("c"), F.col(roman).alias("r"))).over(w))
    enough = F.col("_hi") >= least
    titled = F.col(head).isNull() & (ratio(norm_head(F.col(first_line)), F.lit("SUPPLEMENT")) >= 0.75)
    arabic = (F.col(cand) == 2) & (F.col("_next") == 3) & enough
    romans = F.col(roman).between(1, 4) & (F.col("_rnext") == F.col(roman) + 1) & enough
    at = F.when(titled, F.struct(F.lit(1).alias("rank"), F.col(pos).alias("pos"), F.lit("heading").alias("how")))
    at = F.coalesce(at, F.when(arabic, F.struct(F.lit(2).alias("rank"), F.when(F.col("_back.c").isNull() & F.col("_back").isNotNull(), F.col("_back.p")).otherwise(F.col(pos)).alias("pos"), F.lit("figures").alias("how"))))
    at = F.coalesce(at, F.when(romans, F.struct(F.lit(3).alias("rank"), F.when((F.col(roman) == 2) & F.col("_back").isNotNull() & F.col("_back.r").isNull(), F.col("_back.p")).otherwise(F.col(pos)).alias("pos"), F.lit("roman").alias("how"))))
    return seen.withColumn("_at", at).groupBy(key).agg(F.min("_at").alias("_at")).filter("_at is not null").select(key, F.col("_at.pos").alias(pos), F.col("_at.how").alias("how"))


def plates(leaves: DataFrame, key: str, pos: str, text: str, chars: str, cand: str, page: str, head: str) -> DataFrame:
    """leaves with ``text`` set right once: numbered captions and double numbers are plates.

    A short leaf (under 500 characters, no running head) whose reading disagrees with its page is
    none; of two text leaves that follow each other on one page the shorter is none, if it is
    unheaded, unread and under 1,200 characters. Pages are numbered again by the caller; calling
    this until nothing changes is the fixpoint.
    """
    caption = F.col(text) & (F.col(chars) < 500) & ~F.col(cand).eqNullSafe(F.col(page)) & ~F.coalesce(F.length(norm_head(F.col(head))) >= 5, F.lit(False))
    once = leaves.withColumn("_t", F.col(text) & ~caption)
    w = Window.partitionBy(key, "_t").orderBy(pos)
    same = lambda f: F.col("_t") & F.coalesce(F.col(page) == f(page).over(w), F.lit(False))
    shorter = (same(F.lag) & (F.col(chars) < F.lag(chars).over(w))) | (same(F.lead) & (F.col(chars) <= F.lead(chars).over(w)))
    double = F.coalesce(shorter, F.lit(False)) & F.col(head).isNull() & F.col(cand).isNull() & (F.col(chars) < 1200)
    return once.withColumn("_d", F.col("_t") & ~double).select(*(F.col("_d").alias(c) if c == text else F.col(c) for c in leaves.columns))


def signatures(leaves: DataFrame, key: str, pos: str, lines: str, head: str, cand: str, page: str, back: int = 3, far: int = 20) -> DataFrame:
    """Adds ``signature``: a lone figure over a heading in capitals, far from the page's number, whose head no page before carries."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(-back, -1)
    letters = norm_head(F.col(head))
    shape = F.trim(F.get(lines, F.lit(0))).rlike("^[0-9]$") & (F.get(lines, F.lit(1)) == F.col(head)) & is_upper(F.col(head)) & ~F.col(head).rlike(r"\s[0-9]{1,3}$")
    marked = leaves.withColumn("_l", letters)
    carried = best_ratio(F.col("_l"), F.array_compact(F.collect_list("_l").over(w))) >= 0.6
    sign = shape & (F.abs(F.col(cand) - F.col(page)) > far) & (F.length("_l") >= 8) & ~F.coalesce(carried, F.lit(False))
    return marked.withColumn("signature", F.coalesce(sign, F.lit(False))).drop("_l")


def closing_pages(leaves: DataFrame, key: str, pos: str, kind: str, insert: str, head: str, first_line: str, page: str) -> DataFrame:
    """(key, pos, page): inserts that close a key's last issue and are its next pages.

    The first of them repeats the running head of the last numbered page, or nothing but plates
    and blank leaves follow them; only blank leaves stand between.
    """
    w = Window.partitionBy(key)
    text = F.col(kind) == "text"
    seen = leaves.withColumn("_last", F.max(F.when(text & ~F.col(insert), F.struct(F.col(pos).alias("p"), F.col(page).alias("n"), norm_head(F.col(head)).alias("h")))).over(w))
    seen = seen.withColumn("_ins", text & F.col(insert) & (F.col(pos) > F.col("_last.p")))
    seen = seen.withColumn("_first", F.min(F.when(F.col("_ins"), F.struct(F.col(pos).alias("p"), norm_head(F.col(first_line)).alias("h")))).over(w)).withColumn("_end", F.max(F.when(F.col("_ins"), F.col(pos))).over(w))
    between = F.count_if((F.col(pos) > F.col("_last.p")) & (F.col(pos) < F.col("_first.p")) & (F.col(kind) != "blank")).over(w)
    after = F.count_if((F.col(pos) > F.col("_end")) & ~F.col(kind).isin("plate", "blank")).over(w)
    k = F.row_number().over(Window.partitionBy(key, "_ins").orderBy(pos))
    seen = seen.withColumn("_between", between).withColumn("_after", after).withColumn("_k", k).filter("_ins")
    goes_on = (ratio(F.col("_first.h"), F.col("_last.h")) >= 0.8) | (F.col("_after") == 0)
    return seen.filter((F.col("_between") == 0) & F.coalesce(goes_on, F.lit(False))).select(key, pos, (F.col("_last.n") + F.col("_k")).alias(page))


def index_sections(entries: DataFrame, key: str, order: str, entry: str, section: str, by_comma: str, least: int = 5) -> DataFrame:
    """Index entries with the sections of contents in two columns put right.

    After the last article that is not of the form "Name, page", a block of ``least`` or more
    entries of that form are persons (Obituary) or Varia. In the Obituary a run of three places,
    or a place behind the Varia, is Varia.
    """
    w = Window.partitionBy(key)
    o = w.orderBy(order)
    person = F.col(entry).rlike(PERSON_ENTRY)
    seen = entries.withColumn("_last", F.coalesce(F.max(F.when((F.col(section) == "Articles") & ~F.col(by_comma), F.col(order))).over(w), F.lit(-1)))
    seen = seen.withColumn("_in", (F.col(section) == "Articles") & F.col(by_comma) & (F.col(order) > F.col("_last")))
    seen = seen.withColumn("_size", F.count_if("_in").over(w))
    seen = seen.withColumn("_s", F.when(F.col("_in") & (F.col("_size") >= least), F.when(person, "Obituary").otherwise("Varia")).otherwise(F.col(section)))
    place = (F.col("_s") == "Obituary") & F.col(by_comma) & ~person & ~F.col(entry).rlike(r"^Very\b")
    seen = seen.withColumn("_p", place)
    three = F.col("_p") & F.coalesce(F.lead("_p", 1).over(o) & F.lead("_p", 2).over(o), F.lit(False))
    seen = seen.withColumn("_v", three)
    # a place behind Varia is Varia, and so is the place behind that: runs of places that a Varia opens
    run = F.sum((~F.col("_p") | F.col("_v")).cast("int")).over(o)
    seen = seen.withColumn("_run", run)
    opener = F.first(F.when(F.col("_v"), "Varia").otherwise(F.col("_s"))).over(Window.partitionBy(key, "_run").orderBy(order))
    final = F.when(F.col("_v") | F.col("_p") & (F.col("_open") == "Varia"), "Varia").otherwise(F.col("_s"))
    return seen.withColumn("_open", opener).select(*(final.alias(c) if c == section else F.col(c) for c in entries.columns))


def page_order_breaks(pages: DataFrame, key: str, pos: str, page: str, label: str) -> DataFrame:
    """(key, before, page): numbered pages (without a label of their own) that do not ascend."""
    some = pages.filter(F.col(page).isNotNull() & F.col(label).isNull())
    return some.withColumn("before", F.lag(page).over(Window.partitionBy(key).orderBy(pos))).filter(F.col(page) <= F.col("before")).select(key, "before", page)


def record_numbers(rows: DataFrame, volume: str, page: str, article: str) -> DataFrame:
    """Adds ``n``: the number of a record in its volume's text order."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(volume).orderBy(page, article)))


def first_articles(articles: DataFrame, issue: str, page: str, article: str) -> DataFrame:
    """(issue, article): the article on an issue's first page; ties by id."""
    return articles.groupBy(issue).agg(F.min_by(article, F.struct(page, article)).alias(article))


def texts_by_year(articles: DataFrame, article: str, year: str, members: DataFrame) -> DataFrame:
    """(year, texts, studied): articles of a year, and those of them that a study lists, in order."""
    some = articles.join(members.select(article).distinct().withColumn("_m", F.lit(True)), article, "left")
    return some.groupBy(year).agg(F.count(F.lit(1)).alias("texts"), F.sort_array(F.collect_list(F.when(F.col("_m"), F.col(article)))).alias("studied"))


def life_dates(description: Column) -> Column:
    """(born, born_at, died, died_at) of a description "1835; Place – 1901; Place"; what is missing is null."""
    part = lambda k: F.nullif(F.regexp_extract(description, LIFE, k), F.lit(""))
    return F.when(description.rlike(LIFE), F.struct(part(1).cast("int").alias("born"), part(2).alias("born_at"), part(3).cast("int").alias("died"), part(4).alias("died_at")))


def leading_number(line: Column) -> Column:
    """A page or roman number that stands alone on a line, else null."""
    return F.coalesce(F.when(pageish(line) & ~F.contains(line, F.lit(" ")), digits(line)), roman_page(line))
