import html
import re

import pytest

from phonolake.llm import page_text
from phonolake.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.01"


def plain(page):
    """The article of a page of the test tables by regular expressions."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1|article|div|ul|li)[^>]*>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: " " if m.group().startswith("<br") else "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_table_equals_plain_reading(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = LLM_QUERIES["op3_page_text"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("just words &amp; more\n here", "just words & more here"),
        ("<p>a<b>b</b> c<p>d&nbsp;&nbsp;e&#233;<br>f", "ab c\nd eé f"),
        ("<nav>menu</nav><header>top</header><div class='main-content'><h2>T</h2>x</div><footer>f</footer>", "T\nx"),
        ("<main><header><h1>Title</h1></header><p>one</p><section class='comments'><article>no</article></section></main><p>out</p>", "Title\none"),
        ("<div id=cookieNotice>no</div><div class=\"side sidebar\">no</div><p hidden>no</p><p>yes <3 & no tag < b</p>", "yes <3 & no tag < b"),
        ("<script>if (a < b) '</p>'</script><style>p{}</style><p title='a > b'>in</p><!-- <p>no</p> --><form><p>no</p></form>", "in"),
        ("<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul>", "a b\nc\nx\ny"),
        ("<head><title>t</title><p>body starts", "body starts"),
        ("<div role=navigation>no</div><div>adds<span> up</span></div><div class='ad'>no", "adds up"),
        ("<p>cut off <a href='x", "cut off <a href='x"),
    ],
)
def test_single_pages(page, text):
    assert "\n".join(t for t, _ in page_text.page_blocks(page)) == text


def test_templates_of_a_site(spark):
    body = "<div><p>Our site for <a href=/>news</a></p></div><article><p>story {i} text</p><p>a passage that all share</p><div>see <a href=/m>more</a></div></article><div>call us</div>"
    rows = [(i, f"https://a.example/{i}", body.format(i=i)) for i in range(8)]
    loose = "<div><p>Welcome to b</p></div><div><p>only {i}</p></div><div>good bye</div>"
    rows += [(100 + i, f"http://u@B.example:80/{i}", loose.format(i=i)) for i in range(6)]
    rows += [(200 + i, f"http://c.example/{i}", "<div>copied page</div>") for i in range(9)]
    rows += [(300 + i, None, "<div>no host</div>") for i in range(9)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in page_text.main_text(pages).collect()}
    assert got[3] == "story 3 text\na passage that all share"
    assert got[103] == "only 3"
    assert got[205] == "copied page" and got[305] == "no host"


def test_edges(spark):
    schema = "page_id long, url string, html string"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(None, None, None), (1, "x", ""), (1, "x", ""), (2, "http://h/", "<p>" + "long word " * 100_000), (3, "http://h/", deep)]
    got = page_text.main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, 4, 999_999]
    assert page_text.main_text(spark.createDataFrame([], schema)).count() == 0


def test_pages_are_not_shuffled(spark):
    shared = "<div>" + "<p>same on <a href='#'>every</a> page</p>" * 2 + "</div>"
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<html><body>{shared}<p>own words {i}</p></body></html>") for i in range(40)]
    rows += [(None, "no host", "<p>alone</p>"), (None, None, None), (1, rows[1][1], rows[1][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    sent, joined = page_text.main_text(pages), page_text.main_text(pages, most_bytes=0)
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (str(r.page_id), str(r.url))
    got = sorted(sent.collect(), key=key)
    assert got == sorted(joined.collect(), key=key) and len(got) == 43
    assert {r.text for r in got} == {*(f"own words {i}" for i in range(40)), "alone", ""}
