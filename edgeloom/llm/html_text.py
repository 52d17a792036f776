"""Main text of web pages by a linear-chain CRF over the leaf blocks of the DOM.

A tolerant scanner cuts a page into leaf blocks (runs of text between block
tags) with their ancestors. Each block has binary features: its tag, ancestor
tags, what the ancestors' class, id and role say (in a few categories), length,
link share, punctuation and place. A two-state chain weighs them together with
the neighbours' labels; Viterbi picks the best labelling and the blocks
labelled as text are joined in page order. Where some blocks stand in a
container that is named for its text, a feature tells the others that they do
not; where no container says so, blocks are judged by the rest alone.

The chain is trained by maximum likelihood on labelled pages. ``sample_pages``
makes such pages from seeded templates with made-up words, so no word of any
language carries weight; other labelled pages can be given to ``train``.

Defined results: null or empty html gives an empty text; a page without
text blocks too; unclosed, crossed and unknown tags are tolerated; a page that
ends inside a tag, a comment or a script ends before it; pages of any length
take time in proportion to it; null and repeated page_ids keep their rows; an
empty table gives no rows; equal pages give equal texts; extra columns are
ignored.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.workers import lean_batches, tidy

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTRS = re.compile(r"[\s/]*+([^\s/>=]++)?+(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?+)?+")
_TOLD = ("class", "id", "role")
_SILENT = {"script", "style", "title", "template", "iframe"}  # nothing of theirs is ever shown
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in (*_SILENT, "textarea")}
_VOID = {"br", "img", "input", "meta", "link", "hr", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
_BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select "
    "summary table tbody td textarea tfoot th thead tr ul".split()
)
_CATEGORY = {
    "ads": "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promoted promotion",
    "talk": "comment comments commentlist respond reply replies discussion disqus responses reviews",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs",
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular complementary teaser",
    "note": "cookie cookies consent notice alert popup modal gdpr overlay toast warning",
    "foot": "footer foot copyright legal contentinfo colophon",
    "head": "header masthead logo brand topbar tagline",
    "form": "form search newsletter subscribe login signup contact",
    "share": "share sharing social tags tag meta byline author",
    "text": "article content post entry story main text body maincontent",
}
_WORDS = {w: k for k, words in _CATEGORY.items() for w in words.split()}
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_AROUND = {"nav", "header", "footer", "aside", "form", "article", "main", "section", "table", "ul", "ol", "figure", "noscript", "button", "select", "blockquote", "menu", "dialog"}


_APART = {"nav", "header", "footer", "aside", "form", "noscript", "button", "select", "menu", "dialog"}


class Block:
    __slots__ = ("tag", "around", "said", "nearest", "text", "linked")

    def __init__(self, tag, around, said, nearest, text, linked):
        self.tag, self.around, self.said, self.nearest, self.text, self.linked = tag, around, said, nearest, text, linked


def _says(told: list[str]) -> tuple[str, ...]:
    out = []
    for value in told:
        for w in _SPLIT.split(value):
            kind = _WORDS.get(w.lower())
            if kind and kind not in out:
                out.append(kind)
    return tuple(out)


class _Open:
    """An open element with what it and the elements around it are and say."""

    __slots__ = ("tag", "around", "said", "nearest")

    def __init__(self, tag: str, words: tuple[str, ...], outer: _Open | None):
        around, said, nearest = (outer.around, outer.said, outer.nearest) if outer else (frozenset(), frozenset(), "")
        self.tag = tag
        self.around = around | {tag} if tag in _AROUND else around
        plain = not words or tag in ("html", "body")
        self.said, self.nearest = (said, nearest) if plain else (said | set(words), words[-1])


def _tag_end(page: str, at: int) -> tuple[int, list[str]]:
    """Place behind a tag whose attributes begin at ``at`` (-1: the page ends inside it) and its class, id and role.

    As browsers do it: an opening quote without a closing one belongs to its word.
    """
    told, n = [], len(page)
    while at < n:
        if page[at] == ">":
            return at + 1, told
        m = _ATTRS.match(page, at)
        if m[1] and m[1].lower() in _TOLD:
            told.append(m[2] or m[3] or m[4] or "")
        at = m.end() if m.end() > at else at + 1
    return -1, told


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order. Every character is passed a bounded number of times."""
    page = page or ""
    out: list[Block] = []
    stack: list[_Open] = []
    opened: dict[str, int] = {}
    parts: list[str] = []
    links, anchors, at, n = 0, 0, 0, len(page)

    def flush():
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                top = stack[-1] if stack else _Open("body", (), None)
                out.append(Block(top.tag, top.around, top.said, top.nearest, text, min(1.0, links / max(1, len(text)))))
            parts.clear()
        links = 0

    def add(text: str):
        nonlocal links
        if text:
            parts.append(text)
            if anchors:
                links += len(text.strip())

    def push(tag: str, words: tuple[str, ...]):
        stack.append(_Open(tag, words, stack[-1] if stack else None))
        opened[tag] = opened.get(tag, 0) + 1

    def drop_from(i: int):
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]

    def close(name: str):
        nonlocal anchors
        if opened.get(name):  # else nothing is searched, however deep the page is
            i = len(stack) - 1
            while stack[i].tag != name:
                i -= 1
            drop_from(i)
            anchors = 0

    while at < n:
        sign = page.find("<", at)
        if sign < 0:
            add(page[at:])
            break
        add(page[at:sign])
        m = _NAME.match(page, sign + 1)
        if m is None:
            if page.startswith("<!--", sign):
                end = page.find("-->", sign + 4)
                at = end + 3 if end >= 0 else n
            elif page.startswith("<![CDATA[", sign):
                end = page.find("]]>", sign + 9)
                add(page[sign + 9 : end if end >= 0 else n])
                at = end + 3 if end >= 0 else n
            elif page.startswith(("<!", "<?", "</"), sign):
                end = page.find(">", sign + 2)
                at = end + 1 if end >= 0 else n
            else:
                add("<")
                at = sign + 1
            continue
        at, told = _tag_end(page, m.end())
        if at < 0:
            break  # the page ends inside this tag
        name = m[1].lower()
        if page[sign + 1] == "/":
            if name == "a":
                anchors = max(0, anchors - 1)
            elif name in _BLOCK or name in _SILENT:
                flush()
                close(name)
        elif name in _SILENT:
            end = _END[name].search(page, at)
            at = _tag_end(page, end.end())[0] if end else n
            at = at if at >= 0 else n
            parts.append(" ")
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            anchors = 1
        elif name in _BLOCK:
            flush()
            if name == "hr":
                continue
            for closed in ("p", name) if name in ("li", "option", "tr", "td", "th", "dt", "dd") else ("p",):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == closed:
                        drop_from(i)
                        break
                    if stack[i].tag not in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):
                        break
            push(name, _says(told) or (("form",) if name == "textarea" else ()))
            if name == "textarea":  # its content is text without tags
                end = _END[name].search(page, at)
                add(page[at : end.start() if end else n])
                at = end.start() if end else n
        elif name not in _VOID and parts and name == "label":
            parts.append(" ")
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    out, n = [], len(page)
    inside = [bool(b.around & {"article", "main"}) or "text" in b.said for b in page]
    other = "outside" if any(inside) else "free"
    for i, b in enumerate(page):
        size = len(b.text)
        f = ["1", f"tag={b.tag}", f"near={b.nearest}", f"size={min(6, size.bit_length() // 2)}", f"link={int(b.linked * 3.99)}"]
        f += [f"in={t}" for t in b.around] + [f"says={s}" for s in b.said]
        f += [f"tag={b.tag}&in={t}" for t in b.around]
        f.append(f"stop={b.text[-1] in '.!?…。»”\"'}")
        own = "text" if inside[i] else other
        f += [f"own={own}", f"own={own}&apart={not b.around.isdisjoint(_APART) or bool(b.said - {'text'})}"]
        if i == 0 or i == n - 1:
            f.append("edge")
        out.append(f)
    return out


def _word(r: random.Random) -> str:
    return "".join(r.choice(("ba", "ne", "ti", "lo", "ru", "sha", "en", "or", "mi", "qua")) for _ in range(r.randint(1, 4)))


def _prose(r: random.Random, low: int, high: int) -> str:
    words = [_word(r) for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize() + r.choice((".", ".", ".", "!", "?", ""))


def sample_pages(count: int = 400, seed: int = 7) -> list[tuple[str, list[str]]]:
    """(html, texts of its text blocks) for seeded pages of many layouts."""
    r, pages = random.Random(seed), []
    for _ in range(count):
        good: list[str] = []

        def keep(text: str) -> str:
            good.append(text)
            return text

        def links(k: int) -> str:
            return "".join(f'<li><a href="/x">{_prose(r, 1, 3)}</a></li>' for _ in range(k))

        def named(kind: str, tag: str, inner: str) -> str:
            word = r.choice(_CATEGORY[kind].split())
            attr = r.choice(("class", "id"))
            extra = r.choice(("", "-box", " wide", "_1"))
            return f'<{tag} {attr}="{word}{extra}">{inner}</{tag}>'

        def noise() -> str:
            k = r.randrange(11)
            line = _prose(r, 3, 40)
            if k == 0:
                tag = r.choice(("div", "section", "p"))
                return named("ads", tag, line if tag == "p" or r.random() < 0.5 else f"<p>{line}</p>")
            if k == 1:
                return f"<aside>{r.choice((f'<p>{line}</p>', f'<h3>{_prose(r, 1, 3)}</h3><ul>{links(4)}</ul>', line))}</aside>"
            if k == 2:
                return named("side", "div", f"<h3>{_prose(r, 1, 3)}</h3><p>{line}</p>")
            if k == 3:
                return named("note", "div", f"<p>{line}</p><button>{_prose(r, 1, 2)}</button>")
            if k == 4:
                return f"<form><label>{_prose(r, 1, 3)}</label><p>{line}</p><input><button>{_prose(r, 1, 2)}</button></form>"
            if k == 5:
                return named("form", "div", f"<p>{line}</p>")
            if k == 6:
                return named("share", "div", f'<a href="#">{_prose(r, 1, 2)}</a> <a href="#">{_prose(r, 1, 2)}</a>')
            if k == 7:
                return named("menu", r.choice(("div", "ul")), f"<ul>{links(3)}</ul>")
            if k == 8:
                return f"<noscript>{line}</noscript>"
            if k == 9:
                return f"<nav><ul>{links(4)}</ul></nav>"
            return f"<script>var a='<p>{line}</p>';</script><style>p{{}}</style><!-- <p>{line}</p> -->"

        def talk() -> str:
            said = "".join(r.choice((f"<p>{_prose(r, 3, 60)}</p>", f'<div class="comment"><b>{_word(r)}</b><p>{_prose(r, 3, 60)}</p></div>', f"<li><p>{_prose(r, 3, 60)}</p></li>")) for _ in range(r.randint(1, 5)))
            return named("talk", r.choice(("div", "section", "ol", "ul")), f"<h2>{_prose(r, 1, 2)}</h2>{said}")

        body = []
        if r.random() < 0.8:
            body.append(f"<h1>{keep(_prose(r, 2, 9))}</h1>")
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            k = r.random()
            if k < 0.72:
                text = keep(_prose(r, 1, 90))
                body.append(r.choice((f"<p>{text}</p>", f"<p><b>{text}</b></p>", f"<p>{text}<br>", f"<div>{text}</div>", f"<p>{text}")))
            elif k < 0.78:
                body.append(f"<h2>{keep(_prose(r, 1, 6))}</h2>")
            elif k < 0.83:
                body.append("<ul>" + "".join(f"<li>{keep(_prose(r, 2, 14))}</li>" for _ in range(3)) + "</ul>")
            elif k < 0.87:
                body.append(f"<blockquote><p>{keep(_prose(r, 5, 40))}</p></blockquote>")
            elif k < 0.9:
                body.append("<table><tr>" + "".join(f"<td>{keep(_prose(r, 1, 4))}</td>" for _ in range(3)) + "</tr></table>")
            elif k < 0.97:
                body.append(noise())
        if r.random() < 0.25:
            body.append(talk())
        inner = "".join(body)
        shell = r.randrange(9)
        mute = lambda x: f'<div{r.choice(("", f" class={_word(r)}", f" id={_word(r)}"))}>{x}</div>'  # noqa: E731  a container that says nothing
        main = [f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", named("text", "div", inner), named("text", "section", inner), f"<article>{inner}", inner, mute(inner), mute(mute(inner))][shell]
        before, after = [], []
        if r.random() < 0.8:
            before.append(r.choice((f"<nav><ul>{links(r.randint(2, 7))}</ul></nav>", f"<header><h2>{_prose(r, 1, 4)}</h2><p>{_prose(r, 2, 12)}</p></header>", named("head", "div", f"<p>{_prose(r, 1, 8)}</p>"), named("menu", "div", f"<ul>{links(4)}</ul>"))))
        before += [noise() for _ in range(r.choice((0, 1, 1, 2)))]
        after += [noise() for _ in range(r.choice((0, 0, 1, 2)))]
        if shell < 5 and r.random() < 0.3:  # where the text has a container, what stands outside is none even if it says nothing
            r.choice((before, after)).append(mute(r.choice((f"<p>{_prose(r, 2, 30)}</p>", _prose(r, 2, 12)))))
        if r.random() < 0.4:
            after.append(talk())
        if r.random() < 0.85:
            after.append(r.choice((f"<footer>&copy; {_prose(r, 2, 12)}</footer>", named("foot", "div", f"<p>{_prose(r, 2, 14)}</p>"), f"<footer><p>{_prose(r, 3, 20)}</p><ul>{links(3)}</ul></footer>")))
        pages.append((f"<!DOCTYPE html><html><head><title>{_prose(r, 2, 5)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>", good))
    return pages


def labelled(pages: list[tuple[str, list[str]]]) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels (1: text) of pages whose text blocks are known, in order."""
    out = []
    for page, good in pages:
        found, labels, k = blocks(page), [], 0
        for b in found:
            hit = k < len(good) and b.text == " ".join(good[k].split())
            labels.append(int(hit))
            k += hit
        if found:
            out.append((features(found), labels))
    return out


def train(data: list[tuple[list[list[str]], list[int]]], steps: int = 120, rate: float = 0.1, shrink: float = 1e-3) -> dict:
    """Weights per feature (text minus not text) and moves between labels, by gradient ascent on the likelihood."""
    index: dict[str, int] = {}
    for feats, _ in data:
        for row in feats:
            for f in row:
                index.setdefault(f, len(index))
    n, t = len(data), max(len(y) for _, y in data)
    who = np.array([i * t + j for i, (feats, _) in enumerate(data) for j, row in enumerate(feats) for _ in row])
    what = np.array([index[f] for feats, _ in data for row in feats for f in row])
    real, y = np.zeros((n, t), bool), np.zeros((n, t), int)
    for i, (_, labels) in enumerate(data):
        real[i, : len(labels)] = True
        y[i, : len(labels)] = labels
    w, move = np.zeros(len(index)), np.zeros((2, 2))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, move)]
    pairs = real[:, 1:] & real[:, :-1]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], float)
    for step in range(1, steps + 1):
        s = np.bincount(who, w[what], n * t).reshape(n, t)
        unary = np.stack([np.zeros_like(s), s], 2)
        fwd, bwd = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fwd[:, 0] = unary[:, 0]
        for j in range(1, t):
            reach = np.logaddexp(fwd[:, j - 1, 0, None] + move[0], fwd[:, j - 1, 1, None] + move[1]) + unary[:, j]
            fwd[:, j] = np.where(real[:, j, None], reach, fwd[:, j - 1])
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        for j in range(t - 2, -1, -1):
            onward = unary[:, j + 1] + bwd[:, j + 1]
            reach = np.logaddexp(move[:, 0] + onward[:, 0, None], move[:, 1] + onward[:, 1, None])
            bwd[:, j] = np.where(real[:, j + 1, None], reach, bwd[:, j + 1])
        p = np.where(real, np.exp(fwd[:, :, 1] + bwd[:, :, 1] - total[:, None]), 0)
        both = fwd[:, :-1, :, None] + move + (unary + bwd)[:, 1:, None, :] - total[:, None, None, None]
        expect = np.where(pairs[:, :, None, None], np.exp(np.minimum(both, 0)), 0).sum((0, 1))
        grads = [np.bincount(what, (y * real - p).ravel()[who], len(w)) / n - shrink * w, (seen - expect) / n - shrink * move]
        for q, g, m in zip((w, move), grads, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            q += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return {"weights": {f: float(w[i]) for f, i in index.items()}, "move": move.tolist()}


def viterbi(model: dict, feats: list[list[str]]) -> list[int]:
    weights, ((aa, ab), (ba, bb)) = model["weights"], model["move"]
    back, a, b = [], 0.0, 0.0
    for i, row in enumerate(feats):
        s = sum(weights.get(f, 0.0) for f in row)
        if i == 0:
            a, b = 0.0, s
            continue
        from_a, from_b = a + aa >= b + ba, a + ab > b + bb
        back.append((0 if from_a else 1, 0 if from_b else 1))
        a, b = (a + aa if from_a else b + ba), (a + ab if from_b else b + bb) + s
    labels = [int(b > a)] if feats else []
    for pair in reversed(back):
        labels.append(pair[labels[-1]])
    return labels[::-1]


def main_text(model: dict, page: str | None) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, y in zip(found, viterbi(model, features(found)), strict=True) if y)


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    lean_batches(pages.sparkSession)
    model = model or train(labelled(sample_pages()))

    def run(batches):
        for b in batches:
            texts = [main_text(model, p) for p in b["html"].to_pylist()]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]  # lone surrogates cannot leave Python
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
        tidy()

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
