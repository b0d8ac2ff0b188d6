import time
from html.parser import HTMLParser

import pytest

from tallyweave.llm import queries
from tallyweave.llm.html_blocks import read_page
from tallyweave.llm.html_extraction import extract_main_text, main_text

P1 = "The river rose again in spring, and with it the old mill began to turn; nobody had expected this."
P2 = "For years the village had waited. Some said the weir was broken, others that the water had simply gone elsewhere."
P3 = "Now the wheel turns day and night, grinding barley for three counties, and the miller sleeps badly."
BODY = f"<p>{P1}</p><p>{P2}</p><p>{P3}</p>"
TEXT = f"{P1} {P2} {P3}"
MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News, local</a></li><li><a href='/c'>About us</a></li></ul>"
TALK = "I grew up near that mill, and my father always said it would turn again. What a lovely story, thank you so much for it!"

PAGES = {
    "semantic": (f"<html><body><header><h1>Site name</h1>{MENU}</header><main><article><h1>The mill</h1>{BODY}</article><aside><p>{TALK}</p></aside></main><footer>&copy; us. All rights, reserved.</footer>", f"The mill {TEXT}"),
    "article header": (f"<article><header><h1>The mill</h1></header>{BODY}<footer>Filed under mills.</footer></article>", f"The mill {TEXT}"),
    "classes": (f'<div class="top-bar menu">{MENU}</div><div id="cookieNotice"><p>{TALK}</p></div><div class="content"><h2>The mill</h2>{BODY}</div><div class="sidebar-left"><p>{TALK}</p></div><div class="footer">{TALK}</div>', f"The mill {TEXT}"),
    "plain": (f"<div>{MENU}</div><div><div><h1>The mill</h1>{BODY}</div></div><div>Mill News Ltd</div>", f"The mill {TEXT}"),
    "comments": (f'<article><h1>The mill</h1>{BODY}</article><section class="comments"><h3>Comments</h3><div class="comment"><p>{TALK}</p></div><div class="comment"><p>{TALK}</p></div></section>', f"The mill {TEXT}"),
    "comments inside": (f'<article><h1>The mill</h1>{BODY}<div id="comments"><article><p>{TALK}</p></article></div></article>', f"The mill {TEXT}"),
    "comments by heading": (f"<article><h1>The mill</h1>{BODY}<h3>3 Comments</h3><p>{TALK}</p><div><p>{TALK}</p></div></article>", f"The mill {TEXT}"),
    "comments outside": (f"<main><article><h1>The mill</h1>{BODY}</article><section><h2>Kommentare (2)</h2><p>{TALK} {TALK}</p><p>{TALK} {TALK} {TALK}</p></section></main>", f"The mill {TEXT}"),
    "advert in the text": (f'<article><p>{P1}</p><div class="ad-slot"><p>{TALK}</p></div><p>{P2}</p></article>', f"{P1} {P2}"),
    "form": (f'<article><p>{P1}</p><form><p>{TALK}</p><label>Name</label><input value="x"><button>Send, now</button></form><p>{P2}</p></article>', f"{P1} {P2}"),
    "form around the page": (f'<body><form id="f" action="/">{MENU}<div class="x"><h1>The mill</h1>{BODY}</div></form></body>', f"The mill {TEXT}"),
    "wrapper names": (f'<body class="has-sidebar"><div class="page with-sidebar"><div id="post-17"><h1>The mill</h1>{BODY}</div><div class="sidebar"><p>{TALK}</p></div></div></body>', f"The mill {TEXT}"),
    "roles": (f'<div role="banner"><p>{TALK}</p></div><div role="main">{BODY}</div><div role="complementary"><p>{TALK}</p></div>', TEXT),
    "hidden": (f'<article>{BODY}<p hidden>{P1}</p><div style="display: none">{P1}</div></article>', TEXT),
    "raw": (f"<head><title>x &lt;</title><style>p &gt; a {{}}</style></head><script>if (a < b) document.write('<p>{P1}</p>')</script><article>{BODY}<script>var t='</p>';</script><noscript><p>{P1}</p></noscript></article>", TEXT),
    "markup": ("<article><p>One <b>bo</b>ld, <i>two</i><br>th&eacute; &amp;lt; &#8212; &nbsp; a&ampb\n\t c</p><ul><li>x, y<li>z</ul><table><tr><td>1<td>2</table><pre>a  b\nc</pre><blockquote>so</blockquote></article>", "One bold, two thé &lt; — a&b c x, y z 1 2 a b c so"),
    "broken": (f"<article><h1>The mill</h1><p><b>{P1}<br><p>{P2}</div></span></p><p>{P3}", f"The mill {TEXT}"),
    "links in prose": (f"<article><p>{P1} <a href='/x'>See the weir</a>, too.</p><p>{P2}</p><ul><li><a href='/1'>More mills</a></li></ul></article>", f"{P1} See the weir, too. {P2}"),
    "short": ("<nav><a href='/'>Start, here</a></nav><div class='ad'>Buy mills, now. All of them, at once, everywhere.</div><article><h1>Mill</h1><p>Be.</p></article><footer>Long foot, of much text. And more.</footer>", "Mill Be."),
    "heading alone": ("<article><h1>Mill</h1></article><footer>Long foot, of much text.</footer>", "Mill"),
    "no article": (f"<nav>{MENU}</nav><footer>Nothing, here.</footer>", ""),
    "no tags": ("Just text, no tags.", "Just text, no tags."),
    "flat": (f"<body>{MENU}<h1>The mill</h1>{BODY}</body>", f"The mill {TEXT}"),
    "title above": (f"<div><div>{MENU}</div><h1>The mill</h1><div>{BODY}</div></div>", f"The mill {TEXT}"),
    "german": (f'<div class="kopf">{MENU}</div><div class="inhalt">{BODY}</div><div class="kommentare"><p>{TALK}</p></div>', TEXT),
    "list at the end": (f"<div><a href='/'>Home</a></div><div><h1>The mill</h1><div>By Ann, 3 May</div>{BODY}<ul><li>One</li><li>Two, here</li></ul></div><div>Mill News Ltd</div>", f"The mill By Ann, 3 May {TEXT} One Two, here"),
    "short beside long": (f"<article><h1>Mill</h1><p>Hi</p></article><div><p>{P1}</p><p>{P2}</p></div>", "Mill Hi"),
    "two articles": (f"<article><h1>The mill</h1>{BODY}</article><article><h2>Weir</h2><p>Soon, more.</p></article>", f"The mill {TEXT}"),
    "parts": (f"<article><div class='article-header'><h1>The mill</h1></div><div class='article-body'>{BODY}</div></article>", f"The mill {TEXT}"),
    "compounds": (f"<div class='adsbygoogle'><p>{TALK}</p></div><div>{BODY}</div><div class='commentbox'><p>{TALK}</p></div><div id='cookiebar'>{TALK}</div>", TEXT),
    "less than": ("<article><p>a < b, 1 <2 and <3 </p></article>", "a < b, 1 <2 and <3"),
    "attributes": ('<article><p title="a > b" data-x=\'<p>\'>x, y</p></article>', "x, y"),
    "comment marks": ("<article><!-- <p>no</p> --><p>yes, <!-- -- -->so</p><!---->!</article><!-- open <p>no</p>", "yes, so !"),
    "empty": ("", ""),
    "null": (None, ""),
    "tags only": ("<div><p></p><br></div>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, expected = PAGES[name]
    assert main_text(html) == expected


class Article(HTMLParser):
    """Text of the article element of a page that has one, by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if self.inside and tag != "b":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if self.inside and tag != "b":
            self.parts.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_whole_table(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op12_html_main_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for row in got:
        parser = Article()
        parser.feed(pages[row["page_id"]]["html"])
        parser.close()
        assert row["text"] == " ".join("".join(parser.parts).split()) and row["n_chars"] == len(row["text"]) and row["url"] == pages[row["page_id"]]["url"]


def test_odd_rows(frame):
    long = "<article>" + "".join(f"<p>Paragraph {i}, of many.</p>" for i in range(50_000)) + "</article>"
    rows = [(1, "u", long), (2, None, None), (None, "u", PAGES["plain"][0]), (2, None, PAGES["short"][0]), (2, None, PAGES["short"][0]), (3, "v", "")]
    made = frame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' text", "1 n_chars", "2 keep_0")
    got = extract_main_text(made).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in got) == sorted((i or 0, u or "", len(main_text(h))) for i, u, h in rows)
    assert next(r["text"] for r in got if r["page_id"] == 1).endswith("Paragraph 49999, of many.")
    assert extract_main_text(made.limit(0)).collect() == []


@pytest.mark.parametrize("piece", ["<", "<a ", "<a \"", "<p title='", "<!--", "</", "</x", "<div>", "</div>", "<p>x, y", "<a href=x>", "&", "&#", "<script>", "<td>", "<li>x<ul>", "<b class=", "= ", "<div a=\"b\"c", "<p " + "x=" * 5])
def test_long_odd_pages_take_time_in_proportion(piece):
    def seconds(n):
        started = time.process_time()
        main_text(piece * n)
        return time.process_time() - started

    seconds(100)
    assert seconds(20_000) < 12


def test_deep_nesting_loses_no_text():
    page = read_page("<div>" * 3000 + "deep, text" + "</div>" * 3000 + "after")
    assert [b.text for b in page.blocks] == ["deep, text", "after"]
