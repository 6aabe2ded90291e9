"""Column functions over lines, tokens, numerals and labels of scanned text."""

from __future__ import annotations

import html.entities
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _accents() -> tuple[str, str]:
    """Latin letters with their base letters, and combining marks without any: what translate() takes."""
    letters = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii():
            letters[chr(code)] = base[0]
    return "".join(letters) + "".join(map(chr, range(0x300, 0x370))), "".join(letters.values())


#: Spark has no Unicode normalisation, so the pairs are drawn up here by rule.
ACCENTED, PLAIN = _accents()

#: Abbreviations that do not end a sentence; fixed values.
ABBREVIATION = r"(?<![A-Za-z0-9_])([A-Z]|Fr|Br|Mr|Mrs|Rev|St|Dr|Very|Ven|Bl|Co|No|Vol|p|pp)[.]"
#: Marks the cut between raw sentence pieces.
CUT = "␟"


def clean_line(s: Column) -> Column:
    """The unmappable character becomes a dash; blanks collapse; none before punctuation."""
    s = F.regexp_replace(s, "�", "—")
    s = F.trim(F.regexp_replace(s, "[ \t]+", " "))
    return F.regexp_replace(s, " ([,;:.!?])", "$1")


def fold(s: Column) -> Column:
    """Accents of Latin letters dropped, set with their letter or after it."""
    return F.translate(s, ACCENTED, PLAIN)


def letters(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"\p{L}"))


def is_upper(s: Column) -> Column:
    """At least three letters, three quarters of them capitals."""
    n = letters(s)
    return (n >= 3) & (F.regexp_count(s, F.lit(r"\p{Lu}")) * 4 >= n * 3)


def norm_head(s: Column) -> Column:
    return F.regexp_replace(F.upper(s), "[^A-Z]", "")


def headlike(s: Column) -> Column:
    """In capitals, or a short title-case line of two long words or more, closed by a stop or comma."""
    words = F.regexp_extract_all(s, F.lit("[A-Za-z]{4,}"), 0)
    capital = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    title = (F.length(s) < 70) & s.rlike("^[A-Z]") & s.rlike("[.,] *$") & (F.size(words) >= 2) & (capital * 10 >= F.size(words) * 6)
    return is_upper(s) | title


def tabular(lines: Column) -> Column:
    """Ten lines or more, most of them short."""
    return (F.size(lines) >= 10) & (F.size(F.filter(lines, lambda x: F.length(x) < 25)) * 10 >= F.size(lines) * 6)


def index_like(lines: Column) -> Column:
    """Most lines of five characters or more end in a page number."""
    some = F.filter(lines, lambda x: F.length(x) >= 5)
    return (F.size(some) >= 5) & (F.size(F.filter(some, lambda x: x.rlike(r"[0-9]{1,3}\.?$"))) * 10 >= F.size(some) * 4)


def strip_edges(token: Column) -> Column:
    return F.regexp_replace(token, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")


def pageish(token: Column) -> Column:
    """May the token stand for a page number: short with a digit, or only digit look-alikes."""
    t = strip_edges(token)
    junk = (F.length(t) == 0) & F.length(token).between(1, 3)
    read = (F.length(t) > 0) & (F.length(t) <= 4) & ~t.rlike("^1[5-9][0-9][0-9]$") & (t.rlike("[0-9]") | t.rlike("^[lI1|]{2,}$"))
    return junk | read


def digits(token: Column) -> Column:
    """A page number read from a token by its look-alikes, else null."""
    t = F.translate(strip_edges(token), "ilI|oOSsgf", "111100559")
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("int"))


def roman(s: Column) -> Column:
    """Subtractive numeral of I, V, X, L to an integer."""
    values = F.transform(F.split(F.upper(s), ""), lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).otherwise(0))
    pairs = F.zip_with(values, F.slice(values, 2, F.size(values)), lambda v, w: F.when(v < w, -v).otherwise(v))
    return F.aggregate(pairs, F.lit(0), lambda a, v: a + v)


def to_roman(n: Column) -> Column:
    """Lower-case numeral below 90."""
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    big = F.when(tens >= 5, F.concat(F.lit("l"), F.repeat(F.lit("x"), tens - 5))).when(tens == 4, F.lit("xl")).otherwise(F.repeat(F.lit("x"), tens))
    small = F.when(ones == 9, F.lit("ix")).when(ones >= 5, F.concat(F.lit("v"), F.repeat(F.lit("i"), ones - 5))).when(ones == 4, F.lit("iv")).otherwise(F.repeat(F.lit("i"), ones))
    return F.concat(big, small)


def roman_page(token: Column) -> Column:
    """A numeral that stands alone as a page number, else null."""
    t = F.translate(F.lower(strip_edges(token)), "1l|", "iii")
    return F.when((F.length(t) > 0) & (F.length(t) <= 6) & t.rlike("^x{0,3}(ix|iv|v?i{0,3})$"), roman(t))


def index_numeral(token: Column) -> Column:
    """Volume numeral of an index heading: figures, or a numeral with look-alikes."""
    t = F.upper(F.when(token.rlike("[XVL]"), F.regexp_replace(token, "[ilt1|]", "I")).otherwise(token))
    return F.when(token.rlike("^[0-9]+$"), token.try_cast("int")).when(t.rlike("^[XVLI]+$"), roman(t))


def foot_number(lines: Column, bare: bool = False) -> Column:
    """The number in brackets at the end of the last line, or a bare one."""
    last = F.try_element_at(lines, F.lit(-1))
    found = F.when(last.rlike(r"\([^ ]{1,4}\)$"), digits(F.regexp_extract(last, r"\(([^ ]{1,4})\)$", 1)))
    return F.coalesce(found, F.when(last.rlike("^ *[1-9][0-9]{0,2} *$"), F.trim(last).try_cast("int"))) if bare else found


def word_tokens(s: Column, pattern: str = "[a-z][a-z']+[a-z]") -> Column:
    """Tokens of folded lower-case text."""
    return F.regexp_extract_all(fold(F.lower(s)), F.lit(pattern), 0)


def _cuts(s: Column) -> Column:
    """The text with a mark before a capital, quote or bracket that follows . ! ?"""
    return F.regexp_replace(s, r"([.!?])[ \t\n\r\f\x0b]+([A-Z\"'(])", "$1" + CUT + "$2")


def sentence_pieces(s: Column) -> Column:
    """Raw pieces: cut before a capital, quote or bracket that follows . ! ?"""
    return F.split(_cuts(s), CUT)


def sentences(s: Column) -> Column:
    """An array of sentences: the raw pieces, but no cut behind an abbreviation.

    Cuts are marked and taken back in the whole text, so the work is that of its length.
    """
    return F.split(F.regexp_replace(_cuts(s), ABBREVIATION + CUT, "$1. "), CUT)


def sentence_count(s: Column) -> Column:
    """Runs of . ! ? after initials and common abbreviations are masked."""
    masked = F.regexp_replace(s, r"\b([A-Z])\.\s*(?=[A-Z]\b|\W*[a-z])", "$1@ ")
    masked = F.regexp_replace(masked, r"\b(Fr|St|Rev|Mr|Mrs|Dr|Prof|Hon|Bro|Sr|Jr|vs|etc|viz|cf|Vol|No|pp)\.", "$1@")
    return F.regexp_count(masked, F.lit("[.!?]+"))


#: Function words of the paragraph filter; fixed values.
FUNCTION_WORDS = "the of and to a in that is was it for with as his on be at by not this are from or have an they which we their has were been will he our all its who but".split()


def keep_paragraph(s: Column) -> Column:
    """Prose: no heading in capitals, three quarters letters or blanks, enough function words if long."""
    s = F.trim(s)
    n = letters(s)
    heading = (F.regexp_count(s, F.lit(r"\p{Lu}")) * 10 > n * 7) & (F.length(s) < 95)
    prose = F.regexp_count(s, F.lit(r"[\p{L} \t]")) * 4 >= F.length(s) * 3
    words = F.regexp_extract_all(F.lower(s), F.lit("[A-Za-z']+"), 0)
    english = F.size(F.filter(words, lambda w: w.isin(FUNCTION_WORDS)))
    return (n > 0) & ~heading & prose & ~((F.size(words) > 30) & (english * 10 < F.size(words)))


def mattr(tokens: Column, window: int = 200, stride: int = 20) -> Column:
    """Mean type-token ratio over moving windows; the plain ratio for short texts, 0 for none."""
    n = F.size(tokens)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)), F.lit(stride)), lambda i: F.size(F.array_distinct(F.slice(tokens, i + 1, F.lit(window)))))
    moving = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, v: a + v) / (F.size(parts) * F.lit(float(window)))
    return F.when(n == 0, 0.0).when(n < window, F.size(F.array_distinct(tokens)) / n).otherwise(moving)


def page_label(p0: Column, p1: Column, own: Column | None = None) -> Column:
    """The printed label if there is one, else first page, or first–last."""
    label = F.when(p0 == p1, p0.cast("string")).otherwise(F.concat_ws("–", p0.cast("string"), p1.cast("string")))
    return label if own is None else F.coalesce(own, label)


def citation(author: Column, title: Column, vol: Column, year: Column, pages: Column) -> Column:
    return F.concat(F.coalesce(F.concat(author, F.lit(", ")), F.lit("")), title, F.lit(", "), vol.cast("string"), F.lit(" ("), year.cast("string"), F.lit("): "), pages)


def sort_key(vol: Column, n: Column) -> Column:
    return F.concat(F.lpad(vol.cast("string"), 3, "0"), F.lpad(n.cast("string"), 5, "0"))


def display_date(s: Column) -> Column:
    """DD-MM-YYYY to a date."""
    return F.try_to_timestamp(s, F.lit("dd-MM-yyyy")).cast("date")


def highlight(s: Column, words: list[str]) -> Column:
    """Marks words that begin with a query word, which stands for itself, not for a pattern."""
    alternatives = "|".join(re.escape(w) for w in words)
    return F.regexp_replace(s, r"(?iu)\b((?:" + alternatives + r")[\p{L}\p{M}]*)", "<mark>$1</mark>")


def unescape(s: Column) -> Column:
    """Character references decoded, named ones by the standard's list; unknown ones stay."""
    names = F.create_map(*(F.lit(x) for name, code in sorted(html.entities.name2codepoint.items()) for x in (name, chr(code))), F.lit("apos"), F.lit("'"))
    number = lambda digits, base: F.decode(F.unhex(F.lpad(F.conv(digits, base, 16), 8, "0")), "UTF-32")

    def piece(x: Column) -> Column:
        name = F.regexp_extract(x, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        read = F.when(name.rlike("^#[0-9]"), number(F.substring(name, 2, 9), 10)).when(name.rlike("^#[xX]"), number(F.substring(name, 3, 9), 16)).otherwise(names[name])
        return F.when((name != "") & read.isNotNull(), F.concat(read, F.substring(x, F.length(name) + 2, F.length(x)))).otherwise(F.concat(F.lit("&"), x))

    pieces = F.split(s, "&")
    return F.when(F.contains(s, F.lit("&")), F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), piece), ""))).otherwise(s)


def strip_tags(s: Column) -> Column:
    """Markup dropped, then character references decoded."""
    return unescape(F.regexp_replace(s, "<[^>]+>", ""))


def stem_name(s: Column) -> Column:
    """Name stem: folded letters, j and y as i, a closing us, a, um, o, e dropped."""
    t = F.regexp_replace(F.lower(fold(s)), "[^a-z]", "")
    return F.regexp_replace(F.translate(t, "jy", "ii"), "(us|a|um|o|e)$", "")


def forename_fits(first: Column, latin: Column, forms: Column) -> Column:
    """Does a forename or initial fit a Latin forename with its array of equivalent forms."""
    head = F.regexp_replace(F.lower(fold(F.element_at(F.split(F.trim(latin), "[ ,]+"), 1))), "[^a-z]", "")
    f = F.regexp_replace(F.element_at(F.split(first, " "), 1), r"\.+$", "")
    folded = F.regexp_replace(F.lower(fold(f)), "[^a-z]", "")
    every = F.array_union(F.coalesce(forms, F.array().cast("array<string>")), F.array(head))
    initials = F.array_union(every, F.array(F.when(head.startswith("i"), F.concat(F.lit("j"), F.substring(head, 2, 99))).otherwise(head)))
    by_initial = F.exists(initials, lambda x: x.startswith(F.lower(f)))
    by_name = F.array_contains(every, folded) | (F.left(stem_name(f), F.lit(5)) == F.left(stem_name(head), F.lit(5)))
    return F.when(F.coalesce(first, F.lit("")) == "", True).when(head == "", False).when(F.length(f) == 1, by_initial).otherwise(by_name)


def uninvert(entry: Column) -> Column:
    """An inverted index entry turned back into a title where its form is plain."""
    e = F.trim(entry)
    pattern = "^([^,]+), ([^,]+ (?:of|in|at|on|to|by|between|and|with|among)(?: the)?)$"
    key = F.regexp_replace(F.regexp_extract(e, pattern, 1), r"^([A-Za-z0-9_'.-]+) (Father|Brother|Fr\.|Br\.)$", "$2 $1")
    return F.when(e.rlike(pattern), F.concat_ws(" ", F.regexp_extract(e, pattern, 2), key)).otherwise(entry)


def numeric_row(line: Column) -> Column:
    """(label, nums) if the line is a label followed by numbers, else null."""
    tokens = F.filter(F.split(line, r"[ \t]+"), lambda t: t != "")
    is_number = F.transform(tokens, lambda t: t.rlike(r"^[0-9,.]*[0-9][0-9,.]*$"))
    # place of the last token that is no number
    last = F.aggregate(F.transform(is_number, lambda b, i: F.when(b, 0).otherwise(i + 1)), F.lit(0), lambda a, v: F.greatest(a, v))
    label = F.array_join(F.slice(tokens, 1, last), " ")
    nums = F.transform(F.slice(tokens, last + 1, F.size(tokens) - last), lambda t: F.btrim(t, F.lit(",.")))
    ok = (last > 0) & (last < F.size(tokens)) & label.rlike("[A-Za-z]")
    return F.when(ok, F.struct(F.btrim(label, F.lit(" .,")).alias("label"), nums.alias("nums")))


def year_in(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"\b(18[7-9][0-9]|19[0-3][0-9])\b", 1), F.lit("")).cast("int")
