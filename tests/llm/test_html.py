import html
import re

from brieflane.llm import html_extract, queries
from brieflane.llm.html_extract import main_text
from tests.llm.helpers import SF

PARA = "The river was high in the spring and the people of the town went to see it with their children. "


def test_article_of_the_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op8_html_extract(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1)>|<br>", " ", inner))).split())
        assert r.text == want and r.n_chars == len(r.text)


def test_page_without_marked_article():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body>
      <div class="top-menu"><a href=/>Home</a> <a href=/n>News</a></div>
      <div><a href=a>One link here</a> <a href=b>another link there</a></div>
      <h2>Spring flood</h2><p>{PARA * 2}</p><p>Short words.</p><p>{PARA * 2} &amp; caf&eacute; &#8211; end</p>
      <div class='cookie-notice'>{PARA}</div><form><p>{PARA}</p></form>
      <section id=comments><p>{PARA * 3}</p></section><footer>&copy; 2020 {PARA}</footer></body></html>"""
    body = " ".join((PARA * 2).split())
    assert main_text(page) == f"Spring flood {body} Short words. {body} & café – end"


def test_article_with_what_does_not_belong():
    page = f"""<article><header><h1>Head</h1></header><p>A<b>b</b>c &lt;x&gt;<br>d</p><aside>{PARA}</aside>
      <ul class="share-buttons"><li>Post</li></ul><p>{PARA}</p><script>if (a < b) {{ "</p>" }}</script>
      <div class="comments"><p>{PARA * 3}</p></div></article><p>{PARA * 4}</p>"""
    assert main_text(page) == f"Head Abc <x> d {PARA.strip()}"


def test_short_blocks_follow_their_neighbours():
    page = f"<p>{PARA * 2}</p><p>near text</p><p>nearer links</p><div><a>a link</a></div><p>near links</p><div><a>more</a></div>"
    assert main_text(page) == PARA * 2 + "near text"


def test_marks_around_the_article_are_no_boilerplate():
    body = " ".join((PARA * 2).split())
    for before, after in (('<div class="layout has-sidebar">', "</div>"), ('<main class="no-comments">', "</main>"),
                          ('<article id="legal-ruling-2024">', "</article>"), ('<div class="widget"><article>', "</article></div>"),
                          ('<div class="social">', "</div>"), ('<section aria-label="Legal ruling of 2024">', "</section>")):
        assert main_text(f"{before}<p>{PARA * 2}</p>{after}") == body, before
    related = f'<div class="related"><article><p>{PARA * 3}</p></article></div>'
    assert main_text(f"<article><p>{PARA * 2}</p></article>{related}") == body
    assert main_text(f"<p>{PARA * 2}</p><div class='comments'><p>{PARA * 9}</p></div>") == body


def test_unclosed_silent_elements_lose_no_text():
    body = " ".join((PARA * 2).split())
    for page in (f"<html><head><title>T</title><meta charset=u><body><p>{PARA * 2}</p></body></html>",
                 f"<head><title>T</title><style>p{{}}</style><p>{PARA * 2}</p>", f"<head><title>T</title>{PARA * 2}",
                 f"<svg class='i' /><p>{PARA * 2}</p><svg><text>x</text></svg>", f"<svg/><p>{PARA * 2}</p>",
                 f"<svg><p>{PARA * 2}</p>", f"<head><script>a = '<p>no</p>'</script></head><p>{PARA * 2}</p>"):
        assert main_text(page) == body, page
    assert len(main_text("<button>" * 20_000 + f"<p>{PARA * 2}</p>")) >= len(body)


def test_short_pages_keep_their_text():
    assert main_text("<p>Short text.</p>") == "Short text."
    assert main_text("plain text without tags") == "plain text without tags"
    assert main_text("<nav><a href=/>Home</a></nav><h1>News</h1><p>Short text.</p><footer>c 2020</footer>") == "News Short text."
    assert main_text("<div><a href=/>only a link</a></div>") == ""


def test_links_and_captions_of_a_marked_article_stay():
    page = f"""<article><h1>Head</h1><p>{PARA * 2}</p><figure><img src=x><figcaption>The river in May</figcaption></figure>
      <p><a href=r>The whole report of the council</a></p><ul><li><a href=1>First part</a></li><li>Second</li></ul></article>
      <div><a href=x>other news</a></div>"""
    body = " ".join((PARA * 2).split())
    assert main_text(page) == f"Head {body} The river in May The whole report of the council First part Second"


def test_time_is_in_proportion_to_the_page():
    import time
    for piece in ("<a ", "</p>", "<", "<!", '<a "', "<a '", "<p><b>", "<div class=ad>", "<div class=ad>x", "<svg>", "<a href='", "<li>x</p>",
                  "<table><tr><td>", "</div><p>", "<script", "<!--x", "&amp", "<div></p>"):
        page = piece * (1_000_000 // len(piece))
        start = time.time()
        main_text(page)
        assert time.time() - start < 15, piece  # linear: a few seconds on a slow machine; quadratic: minutes
    deep = "<div>" * 100_000 + "</p>" * 100_000 + "x"
    start = time.time()
    assert main_text(deep) == "x" and time.time() - start < 15


def test_broken_and_empty_pages(spark):
    for page in (None, "", "   ", "<", "<p", "<<<>>>", "<!--", "<script>x", "</p></div>", "&nbsp;&bogus;"):
        assert isinstance(main_text(page), str)
    assert main_text(None) == main_text("<script>x") == main_text("<!-- <p>x</p>") == ""
    long = "<p>" + PARA * 20_000
    assert len(main_text(long)) == len((PARA * 20_000).strip())
    rows = [(1, "u", None), (None, None, "<p>" + PARA * 2), (1, "u", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'clash' AS text", "1 AS n_chars")
    got = html_extract.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, len((PARA * 2).strip())]
    assert html_extract.extract(df.limit(0)).collect() == []
