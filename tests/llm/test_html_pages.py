"""Extraction on hand-written pages, and a scanner whose time follows the page."""

import time

import pytest

from edgeloom.llm import html_text

PAGES = [
    ("<body><h1>A plain page</h1><p>First paragraph of it.</p><p>Second paragraph of it.</p></body>", "A plain page\nFirst paragraph of it.\nSecond paragraph of it."),
    ("<body><div><div class=wrap><h1>Nested boxes</h1><p>Some text stands here.</p><div>And some more there.</div></div></div></body>", "Nested boxes\nSome text stands here.\nAnd some more there."),
    ("<body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></nav><article><h1>On rain</h1><p>Rain &amp; wind\n  came.<p>Then sun&nbsp;shone &lt;bright&gt;.</article><footer>&copy; 2020 Us</footer></body>", "On rain\nRain & wind came.\nThen sun shone <bright>."),
    ('<main><h2>Story</h2><p>It <b>was</b> a <i>dark</i> night.</p><script src=/a/b/>var x=1;</script><script>if(a<b){"<p>no</p>"}</script><style>p{}</style><p>The end came.</p></main><aside><p>Read this too</p></aside>', "Story\nIt was a dark night.\nThe end came."),
    ('<div class="content"><p>Formula <math><mi>x</mi><mo>=</mo><mi>y</mi></math> and <svg><text>a label</text></svg> stay.</p><div class="comments"><p>Nice post!</p></div></div>', "Formula x=y and a label stay."),
    ('<header><p>The daily paper</p></header><article><h1>News</h1><p>Something happened today.</p><div class="advert"><p>Buy now, pay later.</p></div><p>More on it tomorrow.</p><form><label>Name</label><input><button>Send</button></form></article><div class="cookie-notice"><p>We use cookies.</p></div>', "News\nSomething happened today.\nMore on it tomorrow."),
    ("<article><table><tr><td>One cell</td><td>Two cells</td></tr></table><ul><li>an item</li><li>another item</li></ul></article>", "One cell\nTwo cells\nan item\nanother item"),
    ("", ""),
    (None, ""),
    ("<p>", ""),
    ("<article><p>It ends inside a <a href='x", "It ends inside a"),
]


@pytest.fixture(scope="module")
def model():
    return html_text.train(html_text.labelled(html_text.sample_pages()))


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_hand_written_pages(model, k):
    page, text = PAGES[k]
    assert html_text.main_text(model, page) == text


BAD = ["<a ", '<a "', "<div>", "<div>t", "<script", "<!--", "<p a='\"", "<li><p>", "<![CDATA[", "</p>", "<", "&", "<td><th>", "<dd><dt>"]


@pytest.mark.parametrize("part", BAD)
def test_broken_pages_of_a_megabyte_are_scanned_in_seconds(part):
    page = part * (1_000_000 // len(part))
    began = time.process_time()
    html_text.blocks(page)
    html_text.blocks("<div>" * 50_000 + page)
    assert time.process_time() - began < 8


def test_very_long_page_is_whole(model):
    body = [f"Paragraph {i} of a long page, which goes on." for i in range(20_000)]
    page = "<article>" + "".join(f"<p>{b}</p>" for b in body) + "</article>"
    assert html_text.main_text(model, page) == "\n".join(body)
