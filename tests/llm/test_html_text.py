import random
import re

import pytest

from spindrift.llm.html_text import extract, main_text, marked

P1 = "A first paragraph with enough words to look like an article, and some more of them."
P2 = "A second one &amp; its <b>bold</b> part,\n   broken over <i>lines</i> and <a href='/x'>a link</a> in it &copy; 2020."
P2_TEXT = "A second one & its bold part, broken over lines and a link in it © 2020."
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News of the world</a></li><li><a href=/c>About</a></li></ul>"
OUT = [
    f"<nav>{MENU}</nav>",
    f"<div class='top-menu'>{MENU}</div>",
    "<div id=cookieNotice><p>We use cookies to make this site better for everybody who reads it, and so on.</p></div>",
    "<aside><p>Something that stands at the side and is as long as a paragraph of the article is.</p></aside>",
    "<div class='ad-slot'>Buy this thing now, it is cheap and good and it is made for you alone!</div>",
    "<form><label>Your name</label><input name=n><button>Send</button></form>",
    "<script>var a = '<p>not text</p>';</script><style>p { margin: 0 }</style><!-- a <p>comment</p> -->",
    "<section id='comments'><h2>Comments</h2><article class='comment'><p>I like this a lot, thank you for writing it all down.</p></article></section>",
    "<footer><p>&copy; somebody. All rights reserved by those who have them, and no others at all.</p></footer>",
    "<div role=complementary><p>Another thing that stands beside the text and belongs to something else.</p></div>",
]


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("shell", ["<article>{}</article>", "<div class=content>{}</div>", "<main><section>{}</section></main>", "<div id=page><div class='post-body'>{}</div></div>"])
def test_templates(seed, shell):
    rng = random.Random(seed)
    n = rng.randint(2, 9)
    body = "<h1>The title of it all</h1>" + "".join(f"<p>{rng.choice([P1, P2])}" + "</p>" * rng.randint(0, 1) for _ in range(n))
    want = ["The title of it all"] + [P1 if x.startswith(P1) else P2_TEXT for x in body.split("<p>")[1:]]
    around = rng.sample(OUT, rng.randint(0, 10))
    k = rng.randint(0, len(around))
    page = "<!DOCTYPE html><html><head><title>T</title></head><body><header><div>Site name</div></header>" + "".join(around[:k]) + shell.format(body) + "".join(around[k:]) + "</body></html>"
    assert main_text(page).split("\n") == want


LONG = [
    ("<ul>{}</ul>", "<li>{}</li>"),
    ("<table>{}</table>", "<tr><td>{}</td></tr>"),
    ("<div class=body>{}</div>", "<p>{}</p>"),
    ("<section>{}</section>", "<p>{}</p>"),
    ("<blockquote>{}</blockquote>", "<p>{}</p>"),
]


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div id=page>{}</div>", "{}"])
@pytest.mark.parametrize("long, item", LONG)
def test_text_beside_a_long_element(shell, long, item):
    items = [f"{P1} This is number {k}." for k in range(30)]
    body = "<h1>Title</h1><p>A lead.</p>" + long.format("".join(map(item.format, items))) + "<section><h2>Short</h2><p>A short section.</p></section>"
    page = f"<html><body>{OUT[0]}{OUT[3]}{shell.format(body)}{OUT[7]}{OUT[8]}</body></html>"
    assert main_text(page).split("\n") == ["Title", "A lead.", *items, "Short", "A short section."]


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<div class=content>{}</div>", "{}"])
def test_link_paragraphs_and_unmarked_menus(shell):
    link = "<p><a href=/more>Read on here</a></p>"
    assert main_text(f"<body>{shell.format(f'<p>{P1}</p>{link}<p>{P1}</p>')}</body>").split("\n") == [P1, "Read on here", P1]
    page = f"<body><div>{MENU}</div>{shell.format(f'<h1>T</h1><p>Intro sentence one.</p><div>{f"<p>{P1}</p>" * 12}</div>')}</body>"
    assert main_text(page).split("\n") == ["T", "Intro sentence one.", *[P1] * 12]


def plain_text(html):
    """What the generator of ``pages`` puts between its article tags, by regular expressions alone."""
    import html as h

    body = re.search(r"<article>(.*)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|section|blockquote|table|tr|td|pre)\b[^>]*>", body)
    lines = (" ".join(h.unescape(re.sub(r"<br\s*/?>", " ", x)).split()) for x in (re.sub(r"<(?!br)[^>]*>", "", p) for p in parts))
    return "\n".join(x for x in lines if x)


def test_pages_against_a_plain_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    rows = pages.select("page_id", "html").collect()
    assert len(got) == len(rows) > 2000
    for r in rows:
        assert got[r.page_id] == plain_text(r.html), r.page_id


def test_ids_beside_a_null(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "u", "<p>a</p>"), (None, "v", "<p>b</p>")], "page_id long, url string, html string").coalesce(1)
    assert {r.page_id for r in extract(df).collect()} == {big, None}


def test_articles_side_by_side():
    page = f"<body><div>Site</div><article><h1>One</h1><ul>{f'<li>{P1}</li>' * 30}</ul></article><article><h1>Two</h1><p>Short.</p></article></body>"
    assert main_text(page).split("\n") == ["One", *[P1] * 30, "Two", "Short."]


def test_edges():
    assert main_text(None) == main_text("") == main_text("<nav><a>x</a></nav>") == ""
    assert main_text("<article><p>Only this") == "Only this"
    assert main_text("plain text only") == "plain text only"
    assert main_text("<p>a&nbsp;&lt;b&gt;<br>c</p><![if x]><p>d e f</p>").startswith("a <b> c")
    assert main_text("<article>" + "<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"
    assert marked("site-header") and marked("cookieNotice") and not marked("post-header") and not marked("with-sidebar")


@pytest.mark.parametrize("odd", ["<![foo[x]]>", "<![if x]>", "<![endif]>", "<![ x]>", "<![>", "<![]>", "<![if x>", "<![CDATA[x>", "<![CDATA[<p>x</p>]]>", "<![1]>", "<!foo>", "<!>", "<!ELEMENT x>", "<!DOCTYPE x [<!foo>"])
def test_text_behind_odd_declarations(odd):
    assert main_text(f"<p>a</p>{odd}<p>b</p>{odd}<p>c</p>").split("\n") == ["a", "b", "c"]


def test_any_declaration_is_read_to_the_end():
    rng = random.Random(7)
    bits = ["<![", "<!", "[", "]", "]]", ">", "]>", "if", "CDATA", "foo", " ", "<!--", "-->", "x", "<", "</", "&", "<p>"]
    for _ in range(5000):
        assert main_text("<p>a</p>" + "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) + "--> ]]> <p>b</p>").endswith("b")


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a b</p>", "y"), (2, "v", "", "z")], "page_id long, url string, html string, text string")
    got = sorted(map(str, extract(df).collect()))
    assert got == sorted(map(str, extract(df.repartition(2)).collect())) and len(got) == 4
    assert [(r.text, r.n_chars) for r in extract(df).collect() if r.page_id is None] == [("a b", 3)]
    assert extract(df.limit(0)).count() == 0
