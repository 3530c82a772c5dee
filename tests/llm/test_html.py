import random

import pytest

from recordsearch.llm import html
from recordsearch.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">We use</div>
<article><header><h1>Title&nbsp;1</h1></header><p><b>One &lt;b&gt;<br>more\n  text<p>Two &amp; &#233; &copy</p><div class="comments"><p>me</p></div>
<form><input>Mail</form><!-- x <p>no</p> --><aside>side</aside><p>Thr<i>ee</i></article><footer>&copy; host</footer>"""


def test_blocks_of_an_article():
    assert [t for t, _ in html.blocks(PAGE)] == ["Title 1", "One <b> more text", "Two & é ©", "Three"]


@pytest.mark.parametrize("page,want", [
    ("", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("<div><a href=x>all linked</a></div><p>not <a>l</a></p>", ["not l"]),
    ("<article>a</b></div>b</article>c", ["a", "b"]), ("<p>a < b</p>", ["a < b"]), ("<script>x", []), ("<!-- x", []),
    ("<p>&am &amp x</p><", ["&am & x", "<"]), ("<p hidden>x</p><p style='display: none'>y</p><p>z</p>", ["z"]),
    ("<p>" + "w " * 200000 + "</p>", [("w " * 200000).strip()]), ("<a" * 50000, ["<a" * 50000])])
def test_odd_markup(page, want):
    assert [t for t, _ in html.blocks(page)] == want


@pytest.mark.parametrize("start,end", [
    ("<div id='page' class='layout no-sidebar'>", "</div>"), ("<div class='has-sidebar'>", "</div>"), ("<form action=x>", "</form>"),
    ("<div class='with-comments'><div class='cookie-accepted'>", "</div></div>"), ("<div class='header-fixed'>", "</div>"),
    ("<form><div id='top'>", "</div></form>")])
@pytest.mark.parametrize("body", ["<article><p>one two</p></article>", "<main><p>one two</p></main>", "<p>one two</p>"])
def test_names_around_the_whole_page_do_not_silence_it(start, end, body):
    page = f"<html><body>{start}<div class='ad'>x</div>{body}<form>y</form>{end}</body></html>"
    assert [t for t, _ in html.blocks(page)] == ["one two"]


def test_names_around_other_articles_count():
    page = "<div class=no-sidebar><article>the long story</article></div><div class=related><article>teaser</article></div>"
    assert [t for t, _ in html.blocks(page)] == ["the long story"]


def brute(own, other):
    """Length of a longest common subsequence by the whole table."""
    table = [[0] * (len(other) + 1) for _ in range(len(own) + 1)]
    for i, x in enumerate(own):
        for j, y in enumerate(other):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        own, other = rng.sample(range(30), rng.randrange(20)), rng.sample(range(30), rng.randrange(20))
        shared = html.shared_lines(own, other)
        assert sum(shared) == brute(own, other)
    assert html.shared_lines([1, 1, 2], [1, 3, 1]) == [True, True, False]


def test_differencing_without_semantic_markup(spark, tmp_path):
    def page(body):
        return f"<html><body><div>Main Menu</div><div>{body}</div><div>All rights reserved</div></body></html>"
    items = [(i, f"http://www.a.org/n/{i}", page(f"story {i}")) for i in range(40)] + [
        (50, "http://b.org/1", page("only one")), (51, None, None), (52, "http://c.org/1", ""), (53, "http://[x", page("odd")),
        (0, "http://www.a.org/n/0", page("story 0")), (60, "http://a.org/n/0/copy", page("story 0"))]
    table = spark.createDataFrame(items, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS digest", "3 AS n")
    table.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op10_page_text"](spark, str(tmp_path)).collect()
    assert len(got) == len(items)
    for r in got:
        want = {50: "Main Menu\n\nonly one\n\nAll rights reserved", 51: "", 52: "", 60: "story 0",
                53: "Main Menu\n\nodd\n\nAll rights reserved"}.get(r.page_id, f"story {r.page_id}")
        assert r.text == want and r.n_chars == len(want), r
    assert html.main_text(table.where("false")).collect() == []
