"""Main-text extraction from HTML by tag-path ratios.

A page is read into blocks, each with its root-to-leaf path of block elements. Per path, text
length and punctuation are aggregated over its blocks (the path ratios); the ratios are smoothed
over the blocks in page order, fused into one score, and paths whose score reaches a threshold
of the page's spread are content paths.

The content paths decide what the article is. Elements whose class, id or role names hint at
something else (menus, sidebars, notices, adverts, reader comments) go if most of the page's
content lies outside them, or enough of it that is headed as well: a wrapper that is called after
a part of it stays. Article and main elements are kept to if they hold most of the
content text. The article or main element around all content paths, else the deepest container
that covers them, then gives the text: all its blocks, short ones and headings too, but for
blocks of links outside or before the content. Elements that are never article text by HTML itself
(menus, footers, sidebars, forms, scripts, styles, hidden ones) are not read.

Defined results for odd input: null or empty html, or html without main text, gives the empty
text; cut-off pages end where the text ends; repeated rows give repeated results; an empty
table gives an empty table; a kept column called text or n_chars gives way to the new one.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose whole content is not article text.
SKIPPED = frozenset("head nav footer aside form button select option textarea fieldset dialog menu iframe object canvas svg math audio video map template noscript noframes".split())
RAW = ("script", "style", "title", "textarea", "xmp", "noscript", "noframes", "iframe", "template")
#: Parts of class and id names, and roles, that hint at something other than the article.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar sidenav aside footer masthead topbar toolbar comment comments commentlist respond disqus replies cookie cookies consent gdpr notice notices alert disclaimer "
    "newsletter subscribe subscription signup login share sharing social related recommended teaser widget popup modal overlay pagination pager search skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar note".split())
#: Start tags that close an open element of the second kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "tbody": ("thead", "tbody"), "tfoot": ("tbody",), "option": ("option",)}
#: An end tag or implied end does not reach beyond these.
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "p": ("table", "button")}
MAIN = ("article", "main")
#: Elements that are parts of an article, not containers of one.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre tr ul ol dl dt dd table thead tbody tfoot".split())

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b", re.S)
PUNCTUATION = re.compile(r"[.,;:!?。、，；：！？…]")


def _attributes(raw: str) -> tuple[str, bool, bool, str]:
    """(label from class and id, hidden, hinted at as something else, role) of a start tag."""
    names, hidden, marked, role = "", False, False, ""
    for m in ATTRIBUTE.finditer(raw):
        if m[5]:
            hidden = True
            continue
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            names += ("." if key == "class" else "#") + value
            marked |= not MARKED.isdisjoint(re.split(r"[^a-z0-9]+", value))
        elif key == "role":
            role = value.strip()
            marked |= role in ROLES
        elif (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            hidden = True
    return names, hidden, marked, role


class Block(NamedTuple):
    """A block of text: its path, characters in links, and the hinted elements around it (by number)."""

    path: tuple[str, ...]
    text: str
    linked: int
    hints: tuple[int, ...] = ()


def blocks(page: str) -> list[Block]:
    """The blocks outside skipped elements, in page order."""
    stack: list[tuple[str, str, bool, tuple[int, ...]]] = []  # tag, label, skipped, hinted elements open
    out: list[Block] = []
    parts: list[str] = []
    linked, in_link, at, count = 0, False, 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(tuple(x[1] for x in stack), text, min(linked, len(text)), stack[-1][3] if stack else ()))
            parts.clear()
        linked = 0

    def pop_to(tags: tuple[str, ...], fence: tuple[str, ...] = ()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in fence:
                return

    for m in TOKEN.finditer(page):
        if m.start() > at and not (stack and stack[-1][2]):
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * in_link
        at = m.end()
        if not (tag := (m["tag"] or "").lower()):
            continue
        if tag in INLINE:
            in_link = (tag == "a" and not m["end"]) or (in_link and tag != "a")
            continue
        if tag in ("br", "td", "th") and not (stack and stack[-1][2]):
            parts.append(" ")
            if tag == "br":
                continue
        elif tag in VOID and tag != "hr":
            continue
        if tag in ("td", "th"):
            continue
        close()
        if tag in VOID:
            continue
        if m["end"]:
            pop_to((tag,), FENCES.get(tag, ()))
            continue
        pop_to(("p",), FENCES["p"])
        if tag in CLOSES:
            pop_to(CLOSES[tag], FENCES.get(tag, ()))
        names, hidden, marked, role = _attributes(m["attr"] or "")
        inside = any(x[0] in MAIN for x in stack)
        own = tag in SKIPPED or hidden and tag not in ("html", "body") or (tag == "header" and not inside)
        kind = "main" if role == "main" else tag
        count += 1
        hints = stack[-1][3] if stack else ()
        # Article containers stay apart from one another; other elements of a kind share a path.
        stack.append((tag, f"{kind}{names}" + (f"@{count}" if kind in MAIN else ""), own or bool(stack and stack[-1][2]), (*hints, count) if marked else hints))
    if at < len(page) and not (stack and stack[-1][2]):
        parts.append(page[at:])
    close()
    return out


def path_scores(found: list[Block], radius: int = 1) -> dict[tuple[str, ...], float]:
    """The fused, smoothed text and punctuation ratio of each path."""
    length, marks, nodes = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text, linked, _ in found:
        length[path] += len(text) - linked
        marks[path] += len(PUNCTUATION.findall(text)) if not linked else 0
        nodes[path] += 1
    text_ratio = [length[p] / nodes[p] for p, _, _, _ in found]
    mark_ratio = [marks[p] / nodes[p] for p, _, _, _ in found]
    score, n = defaultdict(float), len(found)
    sums = [0.0], [0.0]
    for t, q in zip(text_ratio, mark_ratio, strict=True):
        sums[0].append(sums[0][-1] + t)
        sums[1].append(sums[1][-1] + q)
    for i, (path, _, _, _) in enumerate(found):
        lo, hi = max(0, i - radius), min(n, i + radius + 1)
        smooth = [(s[hi] - s[lo]) / (hi - lo) for s in sums]
        # half own ratio, half neighbourhood, so that one long block does not lift a menu beside it
        score[path] += (text_ratio[i] + smooth[0]) / 2 * (1 + (mark_ratio[i] + smooth[1]) / 2) / nodes[path] * (text_ratio[i] > 0)
    return score


def _tag(label: str) -> str:
    return label.split("@")[0].split(".")[0].split("#")[0]


def _article(content: set[tuple[str, ...]]) -> tuple[str, ...]:
    """The article or main element around all content paths, else the deepest container that covers them."""
    lo, hi = min(content), max(content)  # what these share, all between share
    common = lo[: next((k for k, (x, y) in enumerate(zip(lo, hi)) if x != y), min(len(lo), len(hi)))]
    for k, label in enumerate(common):
        if _tag(label) in MAIN:
            return common[: k + 1]
    while common and _tag(common[-1]) in LEAVES:
        common = common[:-1]
    return common


def _content(found: list[Block], spread: float) -> set[tuple[str, ...]]:
    """The paths whose score reaches a threshold of the spread."""
    scores = path_scores(found)
    mean = sum(scores.values()) / len(scores)
    sigma = (sum((s - mean) ** 2 for s in scores.values()) / len(scores)) ** 0.5
    limit = min(spread * sigma, max(scores.values()))
    return {p for p, s in scores.items() if s > 0 and s >= limit}


def _weight(found: list[Block], content: set[tuple[str, ...]]) -> int:
    """Characters outside links on content paths."""
    return sum(len(b.text) - b.linked for b in found if b.path in content)


def _headed(found: list[Block]) -> int:
    """2 if a block is a first-order heading, else 1 if one stands in an article or main element, else 0."""
    tags = {_tag(x) for b in found for x in b.path}
    return 2 if "h1" in tags else 1 if not tags.isdisjoint(MAIN) else 0


def _without_hinted(found: list[Block], spread: float, rest_share: float = 0.05) -> list[Block]:
    """The blocks outside hinted elements, but for wrappers of the page's content.

    An element with more than half of the content left (these lie within each other, the outermost
    is judged first) stays, unless what lies outside it has ``rest_share`` of the content and is
    headed at least as well: then that is the article, and this is, say, a long discussion. All
    others go; if that leaves no content, the best headed and largest of them stays.
    """
    undecided = {h for b in found for h in b.hints}
    if not undecided:
        return found
    content = _content(found, spread)
    while True:
        weight, total = defaultdict(int), _weight(found, content)
        for b in found:
            if b.path in content:
                for h in b.hints:
                    weight[h] += len(b.text) - b.linked
        large = [h for h in undecided if 2 * weight[h] > total]
        if not large:
            break
        h = max(large, key=lambda h: (weight[h], -h))
        undecided.discard(h)
        within, rest = [b for b in found if h in b.hints], [b for b in found if h not in b.hints]
        if total - weight[h] >= rest_share * total and _headed(rest) >= max(1, _headed(within)):
            found = rest
    left = [b for b in found if undecided.isdisjoint(b.hints)]
    if total and not _weight(left, content):
        h = max(undecided, key=lambda h: (_headed([b for b in found if h in b.hints]), weight[h], -h))
        left = [b for b in found if undecided.isdisjoint(b.hints) or h in b.hints]
    return left


def main_text(page: str | None, spread: float = 0.5) -> str:
    """The article of a page: its blocks in page order, joined by blank lines."""
    found = _without_hinted(blocks(page or ""), spread)
    if not found:
        return ""
    content = _content(found, spread)
    inside = [b for b in found if any(_tag(x) in MAIN for x in b.path)]
    if len(inside) < len(found) and 2 * _weight(inside, content) > _weight(found, content):
        found = inside
        content = _content(found, spread)
    if not content:
        return ""
    container = _article(content)
    closed = any(_tag(x) in MAIN for x in container)
    kept, begun = [], False
    for path, text, linked, _ in found:
        begun |= path in content
        # blocks of links are menus, but for those that follow the content within an article or main element
        menu = linked >= 0.5 * len(text) and bool(path) and _tag(path[-1]) in ("li", "tr", "ul", "ol", "table", "div", "section")
        if path[: len(container)] == container and (path in content or not menu or closed and begun):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars of every page."""
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))
    columns = pages.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("_html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[:-1]), "text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return columns.mapInArrow(run, schema)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
