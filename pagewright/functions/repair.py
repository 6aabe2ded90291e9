"""Repairs of misread text: years, ligatures, ordinals, hyphens, headings.

Rules are tables of readings. A reading is a column (null where its shape is not met), and the
first that holds wins; what a rule must find is data, how it is applied is the same for all.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and the figures they are misread for; fixed values.
FIGURES = {"i": "1", "I": "1", "l": "1", "o": "0", "O": "0", "g": "9", "q": "9", "s": "5"}
#: Misreadings inside running text that a pattern alone settles: a year split after its 1, a
#: nought in a word of capitals, a W set as two V; fixed values.
IN_TEXT = [(r"(?<![0-9A-Za-z_])1 (?=[5-9][0-9]{2}(?![0-9A-Za-z_]))", "1"), (r"(?<=[A-Z])0(?=[A-Z])", "O"), (r"(?<![0-9A-Za-z_])VV(?=[a-zA-Z])", "W")]
#: Marks read for the ct ligature; fixed values.
CT_MARKS = ["(5t", "c5t", "c5l", "6l", "6t"]
#: Words that stay low inside a title, and abbreviations that stay in capitals; fixed values.
SMALL_WORDS = "a an and at by for in of on the to from with during".split()
CAPITALS = ["sj", "us", "ny"]
#: Shapes of an index entry turned round; fixed values.
INVERTED = {
    "an article or pronoun after a stop": r"[,.] (?:The|A|An|Our|Some)\b",
    "a preposition at the end": r"\b(?:of|in|at|on|to|by|between|and|with)$",
    "a name before a dash": r"^\w+, \w+ —",
    "a noun with the rest after a comma": r"^[A-Z]\w+, [A-Z]?[a-z]",
}
#: Shapes of a heading past reading; fixed values.
SPOILED = {
    "spaced letters": r"(?:\b[A-Za-z]\b ){3,}",
    "marks or figures within a word": r"[A-Za-z][\^\\(){}|0-9]+[A-Za-z]",
    "marks of no alphabet": r"[\^\\{}|]|\(\s*\)",
    "a letter alone": r"(?<![\w.'])(?![AaIO]\b)[A-Za-z](?=\s|$)",
}


def rewritten(s: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """s with each pattern of a table replaced, in order."""
    for pattern, reading in rules:
        s = F.regexp_replace(s, pattern, reading)
    return s


def has_shape(s: Column, shapes: dict[str, str]) -> Column:
    """Does s have any of the named shapes?"""
    return s.rlike("|".join(f"(?:{x})" for x in shapes.values()))


def first_reading(*readings: tuple[Column, Column]) -> Column:
    """The reading of the first condition that holds, else null."""
    return F.coalesce(*(F.when(condition, reading) for condition, reading in readings))


def figures(s: Column, letters: str = "iIloOgqs") -> Column:
    """Letters turned into the figures they are misread for."""
    return F.translate(s, letters, "".join(FIGURES[c] for c in letters))


def by_word(s: Column, f) -> Column:
    """s with f applied to each run of letters and figures; null results leave the run as it is."""
    runs = F.split(s, r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    return F.array_join(F.transform(runs, lambda w: F.coalesce(f(w), w)), "")


def drop_signature(s: Column) -> Column:
    """A printer's sheet mark (volume, number, sheet) at the end of a paragraph goes."""
    volume, number, sheet = r"Vol\.\s*[IVXL]+\.", r"No\.\s*\w{1,2}\.", r"[0-9Il ]{1,4}"
    return F.regexp_replace(s, rf"\s*{volume}\s*{number}\s*{sheet}\s*(?:\([0-9]+\))?$", "")


def join_years(s: Column) -> Column:
    """The misreadings that a pattern settles: see IN_TEXT."""
    return rewritten(s, IN_TEXT)


def misread_years(s: Column) -> Column:
    """Words like i898, i8gg or igo6, ordinal endings kept, become the figures they stand for."""
    body = lambda w: F.regexp_extract(w, "^(.*?)(?:th|mo|st|nd|rd)?$", 1)
    yearlike = lambda b: b.rlike("^[iI](?:[0-9][0-9gqioIlOs]{0,3}|g[oO0][0-9])$")
    return by_word(s, lambda w: F.when(yearlike(body(w)), F.concat(figures(body(w)), F.substring(w, F.length(body(w)) + 1, F.length(w)))))


def ordinal(token: Column) -> Column:
    """An ordinal whose number opens with i or l, in figures (io6th: 106th); else null."""
    ending = F.regexp_extract(token, "(th|tli|st|nd|rd)$", 1)
    number = F.left(token, F.length(token) - F.length(ending))
    read = figures(number, "iIlo")
    return first_reading(((ending != "") & number.rlike("^[iIl].*[0-9]") & read.rlike("^[0-9]+$"), F.concat(read, F.when(ending == "tli", "th").otherwise(ending))))


def ligature(token: Column) -> Column:
    """A word with a mark of CT_MARKS after a letter, or 6l in front, with ct for it (Oct in front); else null."""
    opens = token.rlike("^0?6l")
    within = token.rlike("[A-Za-z](?:" + "|".join(m.replace("(", r"\(") for m in CT_MARKS) + ")")
    word = token.rlike("[a-z]") & ordinal(token).isNull() & ~token.rlike("^[iIl]+[0-9]")
    read = F.when(F.startswith(token, F.lit("06l")), F.concat(F.lit("Oct"), F.substring(token, 4, 999))).otherwise(token)
    for mark in CT_MARKS:
        read = F.replace(read, F.lit(mark), F.lit("ct"))
    return first_reading(((opens | within) & word, read))


def accented_six(token: Column, zipf_ct: Column, zipf_e: Column) -> Column:
    """A 6 at or near the end of a name, in order: ct or e where that makes a common word, ón, é; else null.

    zipf_ct and zipf_e are the frequencies of the token with ct or e in place of the 6.
    """
    often = lambda zipf, least: (token == F.lower(token)) & (F.coalesce(zipf, F.lit(0.0)) >= least)
    read = lambda x: F.replace(token, F.lit("6"), F.lit(x))
    closing = F.endswith(token, F.lit("6n"))
    chosen = first_reading((often(zipf_ct, 3.0), read("ct")), (closing, F.concat(F.left(token, F.length(token) - 2), F.lit("ón"))), (often(zipf_e, 4.0), read("e")), (F.lit(True), read("é")))
    figure_like = token.rlike("^[gijlopqsy]+6[gijlopqsy]*$") | F.contains(token, F.lit("i6"))
    return first_reading((token.rlike("^[A-Za-z]{2,}6(?:[aenorstuz][a-z]{0,2})?$") & ~figure_like, chosen))


#: Endings that make ct of a misread dl without a word list; fixed values.
CT_ENDING = "^.{3,}ct(?:ion|ions|or|ors|ory|ure|ures|ive|ed|s|ly)$"


def doubtful_reading(token: Column, zipf: Column, zipf_ct: Column, zipf_u: Column, german: Column) -> Column:
    """dl after a vowel read as ct, or ii in a name as ü, where frequencies or the ending allow it; else null.

    zipf, zipf_ct and zipf_u are frequencies of the token, of its reading with ct and with u for
    ii; german is that of the reading with ü in the German list.
    """
    often = lambda z: F.coalesce(z, F.lit(0.0))
    ct = F.regexp_replace(token, "([aeiou])dl", "$1ct")
    low_ing = token.rlike("^[a-z]") & F.endswith(ct, F.lit("cting"))
    ue = F.concat(F.substring_index(token, "ii", 1), F.lit("ü"), F.substring(token, F.instr(token, "ii") + 2, F.length(token)))
    as_ct = token.rlike("[aeiou]dl") & (often(zipf) < 1.0) & ((often(zipf_ct) >= 1.0) | ct.rlike(CT_ENDING) | low_ing)
    as_ue = token.rlike("^[A-Z].*ii") & (often(german) >= 3.0) & (often(german) > often(zipf_u))
    return first_reading((as_ct, ct), (as_ue, ue))


HYPHENED = r"(\w+)- (\w+)"


def hyphen_pairs(s: Column) -> Column:
    """(a, b) of the words that a line-end hyphen parts."""
    return F.arrays_zip(*(F.regexp_extract_all(s, F.lit(HYPHENED), k).alias(c) for k, c in ((1, "a"), (2, "b"))))


def join_hyphen(a: Column, b: Column, whole: Column, left: Column, right: Column) -> Column:
    """How a parted word reads, from whether the whole and the halves are known words.

    In lower case: the whole if known, else with its hyphen if both halves are, else the whole.
    In capitals of three letters or more only a known whole is joined; otherwise it stays.
    """
    capital = lambda x: (F.length(x) >= 3) & (x == F.upper(x)) & x.rlike("[A-Z]")
    low = b.rlike("^[a-z]")
    return first_reading((low & ~whole & left & right, F.concat(a, F.lit("-"), b)), (low | (capital(a) & capital(b) & whole), F.concat(a, b)), (F.lit(True), F.concat(a, F.lit("- "), b)))


def strip_marks(s: Column) -> Column:
    """Footnote marks (a caret or angle bracket, with what is set around it) at the end of a title go."""
    return F.regexp_replace(s, r"[\s/(<'\"]*[\^<>][\^<>)'/\"]*\s*$", "")


def inverted(entry: Column) -> Column:
    """Is an index entry turned round: its article, preposition or first name stands last?"""
    return has_shape(entry, INVERTED)


def spoiled(s: Column, unknown_share: Column | None = None) -> Column:
    """Is a heading past reading: of a shape of SPOILED, or more than half of its words unknown?"""
    bad = has_shape(strip_marks(s), SPOILED)
    return bad if unknown_share is None else bad | (F.coalesce(unknown_share, F.lit(0.0)) > 0.5)


def _raised(low: Column) -> Column:
    """The first letter or figure in capitals; so is the one after an opening Mc."""
    lead = F.length(F.regexp_extract(low, "^[^a-z0-9]*", 0))
    word = F.concat(F.left(low, lead), F.initcap(F.substring(low, lead + 1, F.length(low))))
    mc = F.startswith(word, F.lit("Mc")) & (F.length(word) > 2)
    return F.when(mc, F.concat(F.lit("Mc"), F.upper(F.substring(word, 3, 1)), F.substring(word, F.lit(4), F.length(word)))).otherwise(word)


#: Marks a word that was cut off behind a dash.
AFTER_DASH = "␟"


def title_case(s: Column) -> Column:
    """Title case word by word: small words low, numerals and abbreviations in capitals; marks at the end go."""

    def word(w: Column, i: Column) -> Column:
        low, core = F.lower(w), F.btrim(w, F.lit(".,;:"))
        numeral = (F.length(core) >= 2) & core.rlike("^X{0,3}(?:IX|IV|V?I{0,3})$")
        kept = F.when(F.regexp_replace(low, "[^a-z]", "").isin(CAPITALS), F.upper(w)).when((i > 0) & low.isin(SMALL_WORDS), low).when((i > 0) & numeral, w)
        return kept.otherwise(_raised(low))

    words = F.filter(F.split(F.replace(strip_marks(s), F.lit("—"), F.lit("— " + AFTER_DASH)), r"\s+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, word), " ")
    return F.rtrim(F.replace(joined, F.lit("— " + AFTER_DASH), F.lit("—")), F.lit(".,—-:; "))


def capital_heads(s: Column) -> Column:
    """Words in capitals with only their first letter left so; a possessive s is low."""
    lower = by_word(s, lambda w: F.when((F.length(w) > 1) & (w == F.upper(w)), F.initcap(F.lower(w))))
    return F.replace(lower, F.lit("'S"), F.lit("'s"))
