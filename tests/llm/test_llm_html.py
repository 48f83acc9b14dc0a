"""Main text of pages: the HTML reader, the style tree and both ways of handing out the unimportant texts."""

import pytest

from alertspark.llm.html_blocks import read_page
from alertspark.llm.site_style import host_of, main_text

SCHEMA = "page_id long, url string, html string, text string, key string"


def _text(html):
    return "\n".join(b.text for b in read_page(html).article())


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &amp; simple &copy", "plain & simple ©"),
        ("<p>a<p>b <b>c</p>d<br>e", "a\nb c\nd e"),
        ("<p>x &lt;b&gt; &#233; &nbsp; y</p>", "x <b> é y"),
        ("<article><h1>T</h1><p><b>one\n two.<br><p>three</p></article><footer>f</footer>", "T\none two.\nthree"),
        ("<nav><a href='>'>n</a></nav><div class='ad'>buy</div><main><p>m</p></main>", "m"),
        ("<script>var t='<p>no</p>';</script><style>p{}</style><!-- <p>c</p> --><p>yes", "yes"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\nb\n1 2\n3"),
        ("<article>t<aside>s</aside><div id='comments'><p>c</p></div><p class=x>u</article>", "t\nu"),
        ("<p>cut in a tag <a hre", "cut in a tag"),
        ("<p>2 < 3 and 4 > 1</p>", "2 < 3 and 4 > 1"),
        ("</p></div>stray<form><p>q</p></form><p hidden>h</p>", "stray"),
        ("<div class='cookie-notice'><p>c</p></div><header>h</header><article><header><h1>k</h1></header>b</article>", "k\nb"),
        ("<p>never</nope>closed<b><i>x", "neverclosedx"),
    ],
)
def test_reader(html, text):
    assert _text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div class='content has-sidebar'><p>a</p><div class=sidebar>s</div></div>", "a"),
        ("<div id=page class=cookies-enabled><p>a</p><div class=cookieNotice>c</div></div>", "a"),
        ("<div class=layout-nav-left><div class='site-nav'>n</div><p>a</p></div>", "a"),
        ("<body style='display:none'><p>a</p></body>", "a"),
        ("<form id=aspnetForm><nav>n</nav><article><p>a</p></article><div class=footer>f</div></form>", "a"),
        ("<body><form id=aspnetForm><div class='ad-300x250'>ad</div><h1>T</h1><p>a</p></form><p>after the long rest", "T\na\nafter the long rest"),
        ("<form><div><p>the text of the page</p></div><nav>n</nav></form><p>c</p>", "the text of the page\nc"),
        ("<article><table class=related-work><tr><td>r</table><div class=share-price>9</div><div class='share-buttons'>x</div>a</article>", "r\n9\na"),
        ("<div class=widget><nav>n</nav><article><p>the article</p><aside>s</aside></article><p>x</p></div><p>c</p>", "the article"),
        ("<table><tr><td class=sidebar><main><p>m</p></main><td class=menu>n</table>", "m"),
        ("<main><p>m</p><div class=widget><article>a</article></div></main><footer>f</footer>", "m\na"),
        ("<article>a<div class=comments><article>c</article></div></article><div class=related><article>t</article></div>", "a"),
        ("<aside><article>teaser</article></aside><p>the long text of the page</p>", "teaser\nthe long text of the page"),
        ("<article class='notice'><p>all there is</p></article>", "all there is"),
        ("<p>a <span class=share>x</span> b<p>c <button>y</button>d", "a b\nc d"),
    ],
)
def test_marked_branches_with_the_article_inside_stay(html, text):
    assert _text(html) == text


def test_host():
    assert [host_of(u) for u in (None, "", "HTTPS://u@A.com:80/x", "a.org/b")] == ["", "", "a.com", "a.org"]


def _site(spark):
    rows = []
    for i in range(40):
        promo = "<p>Read our magazine today.</p>"
        once = "<p>Same words on some pages.</p>" if i % 4 == 0 else ""
        rows.append((i, f"http://big.org/{i}", f"<nav>n{i}</nav><article><h1>Title {i}</h1><p>Text {i} of page.</p>{once}{promo}</article>", None, None))
    rows += [(100 + i, f"http://small.org/{i}", "<article><p>Same everywhere.</p></article>", None, None) for i in range(4)]
    rows += [(200, None, None, None, None), (201, "", "", None, None), (202, "x", "<p>" + "w " * 100_000, None, None), (None, "http://big.org/0", rows[0][2], None, None), (5, *rows[5][1:])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("low_broadcast", [200_000, -1])
def test_style_tree_cuts_what_nearly_all_pages_of_a_host_show(spark, low_broadcast):
    got = sorted(main_text(_site(spark), low_broadcast=low_broadcast).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
    by = {r["page_id"]: r for r in got}
    assert len(got) == 49 and [r["page_id"] for r in got].count(5) == 2
    assert by[1]["text"] == "Title 1\nText 1 of page." and by[1]["n_cut"] == 1
    assert by[4]["text"] == "Title 4\nText 4 of page.\nSame words on some pages."
    assert by[100]["text"] == "Same everywhere." and by[None]["text"] == by[0]["text"]
    assert [by[k]["text"] for k in (200, 201)] == ["", ""] and by[202]["n_chars"] == 199_999
    assert all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.mark.parametrize("low_broadcast", [200_000, -1])
def test_copies_of_a_page_are_one_page(spark, low_broadcast):
    copy = "<article><h1>Copied</h1><p>One text on all copies.</p></article>"
    promo = "<p>Read our magazine today.</p>"
    rows = [(i, f"http://mirror.org/{i}", copy, None, None) for i in range(20)]
    rows += [(100 + i, f"http://most.org/{i % 7}", copy.replace("</article>", f"{promo}</article>"), None, None) for i in range(90)]
    rows += [(200 + i, f"http://most.org/x{i}", f"<article><h1>T{i}</h1><p>Text {i}.</p>{promo}</article>", None, None) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["page_id"]: r for r in main_text(df, low_broadcast=low_broadcast).collect()}
    assert len(got) == 120 and {got[i]["text"] for i in range(20)} == {"Copied\nOne text on all copies."}
    assert {(got[100 + i]["text"], got[100 + i]["n_cut"]) for i in range(90)} == {("Copied\nOne text on all copies.", 1)}
    assert [got[200 + i]["text"] for i in range(10)] == [f"T{i}\nText {i}." for i in range(10)]


def test_empty_table(spark):
    assert main_text(_site(spark).limit(0)).count() == 0
