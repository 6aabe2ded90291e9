import html
import re

from pagewright.llm.html_text import blocks, extract, main_text, op2_html_text

PROSE = "The committee met on the first day of the month, and its members, all of them present, agreed on the plan."


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_article_without_the_rest():
    html = page(
        "<nav><ul><li><a href='/'>Home</a></li></ul></nav><header><h2>Site</h2></header><div class='ad'>Buy this, now, today.</div>"
        f"<article><h1>Title &amp; more</h1><p>{PROSE}<p>Second  <b>bold</b>\n part, {PROSE}</p><script>var a='</p>';</script><p>Short.</p>"
        "<form><p>Your name, please.</p></form></article>"
        f"<aside><p>{PROSE}</p></aside><section id='comments'><p>A reader says: {PROSE}</p></section><footer>&copy; 2024, all rights.</footer>"
    )
    assert main_text(html) == f"Title & more\n\n{PROSE}\n\nSecond bold part, {PROSE}\n\nShort."


def test_without_article_element():
    html = page(f"<div id='menu'><a href='a'>One</a> <a href='b'>Two</a></div><div class='content'><h1>Head</h1><p>{PROSE}</p><p>{PROSE}</p><ul><li>Item one</li></ul></div><div class='footer'>Imprint, contact.</div>")
    assert main_text(html) == f"Head\n\n{PROSE}\n\n{PROSE}\n\nItem one"
    assert main_text(f"<p>{PROSE}") == PROSE


def test_nested_body_and_heading_outside_it():
    body = "".join(f"<p>{PROSE}</p>" for _ in range(8))
    want = "\n\n".join(["Title", "Intro", *[PROSE] * 8])
    assert main_text(page(f"<article><header><h1>Title</h1><p>Intro</p></header><div class='body'>{body}</div></article>")) == want
    assert main_text(page(f"<main><h1>Title</h1><article><p>Intro</p><div class='body'>{body}</div></article></main>")) == want
    lead = f"A lead of its own: {PROSE}"
    html = page(f"<div id='menu'><a href='a'>One</a></div><div class='story'><p>{lead}</p><div class='more'>{body}</div></div><div class='note'>Imprint</div>")
    assert main_text(html) == "\n\n".join([lead, *[PROSE] * 8])


def test_short_article_beside_the_story():
    body = "".join(f"<p>{PROSE}</p>" for _ in range(8))
    html = page(f"<div class='story'><h1>Title</h1>{body}</div><article class='card'><p>A short one.</p></article>")
    assert main_text(html) == "\n\n".join(["Title", *[PROSE] * 8])
    html = page(f"<div class='note'><p>{PROSE}</p></div><article><h1>Title</h1>{body}</article>")
    assert main_text(html) == "\n\n".join(["Title", *[PROSE] * 8])


def test_wrappers_called_after_a_part():
    body = f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p>"
    want = "\n\n".join(["Title", PROSE, PROSE])
    assert main_text(page(f"<div class='layout has-sidebar'><article>{body}</article><div class='sidebar'><p>Read this, too.</p></div></div>")) == want
    assert main_text(page(f"<article class='post share-enabled'>{body}<div class='share'>Tell your friends.</div></article>")) == want
    assert main_text(page(f"<div id='page-with-footer' class='no-comments'><div class='post'>{body}</div><div class='footer'>Imprint, contact.</div></div>")) == want
    assert main_text(f"<body class='cookie-notice nav-open'><main class='banner-top'>{body}</main></body>") == want


def test_comments_longer_than_the_article():
    talk = "".join(f"<article class='comment'><p>A reader says: {PROSE}</p></article>" for _ in range(9))
    html = page(f"<article><h1>Title</h1><p>{PROSE}</p></article><section class='comments-area'>{talk}</section>")
    assert main_text(html) == f"Title\n\n{PROSE}"
    html = page(f"<div class='post'><h1>Title</h1><p>{PROSE}</p><div id='comments'>{talk}</div></div>")
    assert main_text(html) == f"Title\n\n{PROSE}"


def test_hinted_article_beside_hinted_comments():
    body = f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p>"
    want = "\n\n".join(["Title", PROSE, PROSE])
    for n in (1, 2, 9):
        talk = "".join(f"<article class='comment'><p>A reader says: {PROSE}</p></article>" for _ in range(n))
        assert main_text(page(f"<article class='post share-enabled'>{body}</article><section class='comments'>{talk}</section>")) == want
    many = "".join(f"<div class='comment c{k}'><p>Reader {k} says: {PROSE}</p></div>" for k in range(3000))
    assert main_text(page(f"<article class='share'>{body}</article><section class='comments'>{many}</section>")) == want


def test_lists_of_links():
    links = "<ul><li><a href='a'>First source</a></li><li><a href='b'>Second source</a></li></ul>"
    assert main_text(page(f"<article><p>{PROSE}</p>{links}</article>")) == f"{PROSE}\n\nFirst source\n\nSecond source"
    assert main_text(page(f"<article>{links}<p>{PROSE}</p></article>")) == PROSE
    assert main_text(page(f"{links}<div><p>{PROSE}</p><p>{PROSE}</p></div>")) == f"{PROSE}\n\n{PROSE}"


def test_pages_against_their_markup(spark):
    """The pages of the test tables have one article element each: its paragraphs, cut out by pattern."""
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r.text for r in op2_html_text(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        (article,) = re.findall(r"<article[^>]*>(.*?)</article>", re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "", r.html), re.S)
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h[1-6]|div|ul|ol|li|blockquote)\b[^>]*>", article)]
        assert got[r.page_id] == "\n\n".join(x for x in parts if x)


def test_broken_and_empty():
    for h in (None, "", "   ", "<html></html>", "<nav><a>x</a></nav>", "<script>while(1){}", "<!-- only a comment", "<p></p>"):
        assert main_text(h) == ""
    assert main_text(f"<article><p>{PROSE} cut &am") == f"{PROSE} cut &am"
    assert main_text(f"<article><p title=\"a > b\">{PROSE}</p></article>") == PROSE
    deep = "<div>" * 3000 + f"<p>{PROSE}</p>"
    assert main_text(deep) == PROSE
    assert len(blocks("<p>a</p>" * 5000)) == 5000


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", page(f"<article><p>{PROSE}é</p></article>")), (2, None, None)], "page_id long, url string, html string")
    assert sorted(tuple(r) for r in extract(df).collect()) == [(1, "u", PROSE + "é", len(PROSE) + 1), (2, None, "", 0)]
    assert extract(df.limit(0)).collect() == [] and extract(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"]


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "old", 7, page(f"<p>{PROSE}</p>"))] * 2, "page_id long, text string, n_chars int, html string")
    out = extract(df, keep=("page_id", "text", "n_chars"))
    assert out.columns == ["page_id", "text", "n_chars"] and [tuple(r) for r in out.collect()] == [(1, PROSE, len(PROSE))] * 2
