"""Main text of pages: what must stay and what must go, and the tables' pages against plain patterns."""

import html
import re

import pytest

from quern.llm import pages

A, B, C = ("The first paragraph says, at some length, what the article is about; it has commas, too.", "A second one goes on, in a manner of speaking, with what the first one began to say.", "Short one.")
JUNK = '<nav><ul><li><a href="/">Home</a></li><li>Menu item</li></ul></nav><div class="ad">Buy now, buy cheap, buy here, today, at once, in all of our many shops, everywhere.</div>'
COMMENTS = '<section id="comments"><h2>Comments</h2>' + "".join(f"<p>Reader {k} thinks, on the whole, that this is a good article, if a little long, and says so.</p>" for k in range(9)) + "</section>"
FOOT = "<footer>&copy; someone</footer><script>var t = '<p>no</p>';</script>"
ALL = f"{A}\n{B}\n{C}"

CASES = {
    "article": (f"<html><body>{JUNK}<article><p>{A}</p><p>{B}<p>{C}</article>{COMMENTS}{FOOT}</body></html>", ALL),
    "comments in the article": (f"<body>{JUNK}<article><p>{A}</p><p>{B}</p><p>{C}</p>{COMMENTS}</article>{FOOT}", ALL),
    "divs": (f"<body>{JUNK}<div id=wrap><div class='left-sidebar'>{A}</div><div><p>{A}</p><p>{B}</p><p>{C}</p></div></div>{COMMENTS}{FOOT}", ALL),
    "class around": (f"<body class='has-sidebar comments-open'><div class='content with-sidebar'><p>{A}</p><p>{B}</p><p>{C}</p></div>{FOOT}", ALL),
    "split over sections": (f"<body>{JUNK}<main><section><p>{A}</p></section><section><p>{B}</p><p>{C}</p></section></main>{FOOT}", ALL),
    "siblings": (f"<body><div>{JUNK}<h1>Title here</h1><div class='part'><p>{A}</p><p>{A}</p></div><div class='part'><p>{B}</p><p>{B}</p></div><ul><li><a href='x'>More of this</a></li></ul></div>{FOOT}", f"Title here\n{A}\n{A}\n{B}\n{B}"),
    "menu without marks": (f"<body><div>{''.join(f'<p><a href={k}>A long link, number {k}, to another page, of ours, elsewhere</a></p>' for k in range(30))}</div><div><p>{A}</p><p>{B}</p><p>{C}</p></div>", ALL),
    "bare text": (f"<body><div>{A}<br>{B}</div>", f"{A} {B}"),
    "no elements": ("Only  text\there, &lt;b&gt; and&nbsp;more.", "Only text here, <b> and\xa0more."),
    "references": ("<article><p>caf&eacute; &amp;amp; &#8364;&#x41; &bogus; &am</p></article>", "café &amp; €A &bogus; &am"),
    "notice and form": (f"<body><div role=alert>{A}</div><div class='cookie-notice'>{A}</div><form><p>{A}</p><input><button>Send it</button></form><article><p>{A}</p><p>{B}</p><p>{C}</p></article>", ALL),
    "one form": (f"<body><form id=f>{JUNK}<div><p>{A}</p><p>{B}</p><p>{C}</p></div></form>", ALL),
    "inline advert": (f"<article><p>{A}<span class=advert>Buy!</span></p><p>{B}</p><p>{C}</p></article>", ALL),
    "table": (f"<table><tr><td>{JUNK}<td><p>{A}<p>{B}<p>{C}</table>", ALL),
    "list": (f"<article><p>{A}</p><ul><li>one<li>two</ul><pre>x  y\n z</pre></article>", f"{A}\none\ntwo\nx y z"),
    "unclosed": (f"<article><p><b>{A}<br><p>{B}</p><p><i>{C}", ALL),
    "comment of markup": (f"<article><!-- <p>no</p> --><p>{A}</p></article>", A),
    "nothing but a menu": (JUNK + FOOT, ""),
    "empty": ("", ""),
    "none": (None, ""),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    given, want = CASES[name]
    assert "\n".join(pages.main_blocks(given) if given else []) == want


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + f"<p>{A}</p>" + "</div>" * 20_000
    assert pages.main_blocks(deep) == [A]
    assert pages.main_blocks(f"<article>{''.join(f'<p>{A}</p>' for _ in range(20_000))}</article>") == [A] * 20_000


def test_table_of_pages(spark):
    rows = [(k, None if k % 2 else f"u{k}", given, "x", 1) for k, (given, _) in enumerate(CASES.values())] * 2
    got = pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")).collect()
    assert sorted((r.page_id, r.url or "", r.text) for r in got) == sorted((k, "" if k % 2 else f"u{k}", want) for k, (_, want) in enumerate(CASES.values()) for _ in range(2))
    assert pages.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_pages_of_the_tables(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    htmls = {r.page_id: r.html for r in given.collect()}
    for r in pages.main_text(given).collect():
        body = htmls[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [re.sub(r"[\x20\x09-\x0D]+", " ", html.unescape(b.replace("<br>", " ").replace("<b>", "").replace("</b>", ""))).strip(" ") for b in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b)
