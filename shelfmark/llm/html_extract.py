"""Main text of web pages: a conditional random field over the leaf blocks of the page's tree.

A tolerant reader turns the html into leaf blocks, runs of text between the borders of block elements,
each with its open ancestors. A linear-chain CRF with features of the ancestors (tags, class and id
words) and of the text (length, link share, punctuation, stock words) labels the blocks; Viterbi decoding
marks the article's. It is trained on the driver from a fixed number of labelled pages that a small
generator writes in many layouts; the weights, some kilobytes, go with the task's closure.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .quality_rules import batches_by_size

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: The attributes of a tag, in runs without a way back.
_ATTRS = re.compile(r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+>""")
_MARK = re.compile("['\">]")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-label|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
#: Elements of html (fixed by its standard): without content, whose text is no markup, inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mi mn mo mrow ms msub msup mtext noscript object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text isn't the page's: drawings, the choices of forms, what scripts fill in.
_UNREAD = frozenset("svg select datalist template canvas audio video".split())
#: What an opening tag closes when it is still open (fixed by the standard).
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_SPACE = re.compile(r"\s+")
#: Ancestors that are features by themselves, and of these the ones that tell little.
_TOLD = "article main section nav header footer aside form button fieldset figure figcaption table ul ol li dl p h1 h2 h3 h4 h5 h6 blockquote pre head dialog label details address menu div".split()
_TAG = {t: 1 << i for i, t in enumerate(_TOLD)}
_PLAIN = sum(_TAG[t] for t in ("p", "div", "li", "ul"))
#: Words of class names and ids, by what they tell (our own list).
_HINTS = {
    "good": "article content post story entry main body text prose blog news detail",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pager pagination skip",
    "top": "header masthead banner topbar logo brand hero",
    "foot": "footer foot bottom copyright legal colophon",
    "side": "sidebar aside side rail widget related recommended popular trending more promo teaser",
    "ad": "ad ads advert advertisement advertising sponsor sponsored sponsors dfp promoted",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall toast",
    "form": "form search login signin signup register contact input",
    "talk": "comment comments disqus reply replies respond discussion reviews review reaction",
    "share": "share social sharing follow tags tag meta byline author date",
    "hidden": "hidden none",
}
_KINDS = list(_HINTS)
_HINT = {w: 1 << _KINDS.index(k) for k, ws in _HINTS.items() for w in ws.split()}
_HIDDEN, _DROPPED = 1 << _KINDS.index("hidden"), 1 << len(_KINDS)


class Block:
    """A leaf block: its text, how much of it is linked, its element, its ancestors and what their names hint
    at, both as sets of bits."""

    __slots__ = ("text", "linked", "leaf", "tags", "hints")

    def __init__(self, text: str, linked: int, leaf: str, tags: int, hints: int):
        self.text, self.linked, self.leaf, self.tags, self.hints = text, linked, leaf, tags, hints


@lru_cache(maxsize=4096)
def _hints(attrs: str) -> int:
    out = 0
    if "=" in attrs or "hidden" in attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
            if key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower():
                out |= _HIDDEN
            elif key != "style":
                for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value)):
                    out |= _HINT.get(w.lower(), 0)
    return out


class _TagEnds:
    """Where the tags of a page end. Once one's quotes don't close, the ways through quotes that lead
    nowhere are remembered, so that a page of such tags is still read in time by its length."""

    def __init__(self, page: str):
        self.page, self.all_close, self.lost = page, True, set()

    def __call__(self, at: int) -> int:
        page = self.page
        if self.all_close:
            if m := _ATTRS.match(page, at):
                return m.end()
            self.all_close = False
        way, here = [], at
        while (m := _MARK.search(page, here)) and m.start() not in self.lost:
            if m[0] == ">":
                return m.end()
            way.append(m.start())
            here = page.find(m[0], m.end()) + 1
            if not here:
                break
        self.lost.update(way)
        return page.index(">", at) + 1


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in its order. Scripts, styles, the fields of forms and drawings have none;
    unclosed elements end with their parents; a lone '<' is text; a tag whose quotes don't close ends at the
    next '>'. What an element inherits is kept with it, so the time grows with the page's length alone."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # tag, and the bits of it and its ancestors
    opened: dict[str, int] = {}
    buf: list[str] = []
    linked, end = 0, len(page)
    last, tag_end = page.rfind(">"), _TagEnds(page)

    def flush() -> None:
        nonlocal linked
        if buf:
            text = _SPACE.sub(" ", html.unescape("".join(buf))).strip()
            buf.clear()
            if text:
                out.append(Block(text, linked, *(stack[-1] if stack else ("none", 0, 0))))
            linked = 0

    def text(s: str) -> None:
        nonlocal linked
        if stack and stack[-1][2] & _DROPPED:
            return
        buf.append(s)
        if opened.get("a"):
            linked += len(s.strip())

    def close(tag: str) -> None:
        if not opened.get(tag):
            return
        at = len(stack) - 1
        while stack[at][0] != tag:
            at -= 1
        if any(t not in INLINE for t, _, _ in stack[at:]):
            flush()
        for t, _, _ in stack[at:]:
            opened[t] -= 1
        del stack[at:]

    at = 0
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None or m[2] is not None and m.end() > last:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        stop = tag_end(at)
        attrs, at, tag = page[at : stop - 1], stop, m[2].lower()
        if m[1]:
            if tag in ("br", "p") and not opened.get(tag):
                text(" ") if tag == "br" else flush()
            else:
                close(tag)
            continue
        if tag in RAW:
            stop = _END[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if tag == "br":
            text("\n")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in ("body", "html") and opened.get(tag):
            continue
        for other in _CLOSES.get(tag, ()):
            close(other)
        if tag in _ENDS_P:
            close("p")
        if tag == "body":
            close("head")
        if tag not in INLINE and tag not in _UNREAD:
            flush()
        _, tags, hints = stack[-1] if stack else ("", 0, 0)
        stack.append((tag, tags | _TAG.get(tag, 0), hints | (_hints(attrs) if attrs else 0) | (_DROPPED if tag in _UNREAD else 0)))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


_BLOCKY = re.compile("<(?:p|div|ul|h[1-6]|article)")
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_LEGAL = re.compile(r"©|copyright|all rights reserved|\(c\) \d{4}", re.I)
#: What stands over the comments of readers.
_TALK = re.compile(r"(?:\d+ )?(?:comments?|replies|responses|discussion|leave a (?:reply|comment)|join the (?:discussion|conversation))(?: \(?\d+\)?)?:?", re.I)
_STOCK = re.compile(r"cookie|subscribe|sign (?:in|up)|log ?in|newsletter|advert|sponsor|click here|read (?:more|next)|share|comments?\b|reply|privacy|terms|imprint|contact us|follow us|menu|search", re.I)


_INSIDE, _OUTSIDE = (sum(_TAG[t] for t in ts.split()) for ts in ("article main", "nav header footer aside form button dialog"))
_GOOD, _H1 = 1 << _KINDS.index("good"), _TAG["h1"]


@lru_cache(maxsize=4096)
def _of_ancestors(tags: int, hints: int) -> tuple[str, ...]:
    out = [f"in-{t}" for t, bit in _TAG.items() if tags & bit]
    out += [f"name-{k}" for i, k in enumerate(_KINDS) if hints >> i & 1]
    if tags & _INSIDE and not tags & _OUTSIDE and not hints & ~_GOOD:
        out.append("inside")
    return tuple(out if hints or tags & ~_PLAIN else [*out, "untold"])


def features(page: list[Block]) -> list[list[str]]:
    out, shape = [], []
    n, longest = len(page), max((len(b.text) for b in page), default=1)
    for b in page:
        chars, share = len(b.text), b.linked / len(b.text)
        size = 0 if chars < 20 else 1 if chars < 60 else 2 if chars < 160 else 3 if chars < 400 else 4
        shape.append((size, 0 if share < 0.05 else 1 if share < 0.4 else 2, b.text[-1] in ".!?…\"”»:"))
    count = f"of{0 if n < 3 else 1 if n < 7 else 2 if n < 20 else 3}"
    headlines, talk = sum(bool(b.tags & _H1) for b in page), False
    for i, b in enumerate(page):
        size, link, stop = shape[i]
        told = _of_ancestors(b.tags, b.hints)
        f = ["bias", "leaf-" + b.leaf, *told, f"size{size}", f"link{link}", "stop" if stop else "open", count, f"size{size}-link{link}-{stop}", f"part{4 * i // n}"]
        if told and told[-1] == "untold":
            f.append(f"untold-size{size}-link{link}-{stop}")
        if 4 * len(b.text) > longest:
            f.append("long")
        if b.tags & _H1:
            where = "inside" if b.tags & _INSIDE else "header" if b.tags & _TAG["header"] else "outside"
            f += [f"headline-{where}", f"headline-{where}-{'only' if headlines == 1 else 'of-some'}"]
        if talk:
            f.append("below-talk")
        elif size < 2 and _TALK.fullmatch(b.text):
            talk = True
            f.append("talk")
        if size < 3 and _LEGAL.search(b.text):
            f += ["legal", "legal-" + told[-1]] if told else ["legal"]
        if size < 3 and _STOCK.search(b.text):
            f += ["stock", f"stock{size}"]
        f.append("first" if i == 0 else "after-{}-{}".format(*shape[i - 1]))
        f.append("last" if i == n - 1 else "before-{}-{}".format(*shape[i + 1]))
        out.append(f)
    return out


def training_pages(n: int = 420, seed: int = 11) -> list[tuple[str, set[str]]]:
    """Generated pages, each with the set of its article's block texts. Articles are prose of one to many
    paragraphs, lists, verse, dialogue, questions and tables; pages mark their parts by elements, by names
    of classes, or not at all, and put other blocks before, in and after the article."""
    rnd = random.Random(seed)
    pick = rnd.choice

    def word() -> str:
        return "".join(pick("bdfghklmnprstvz") + pick("aeiouéöí") for _ in range(rnd.randint(1, 4)))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(rnd.randint(lo, hi)))

    def sentence(lo: int = 2, hi: int = 22) -> str:
        return words(lo, hi).capitalize() + pick("....?!")

    def prose() -> str:
        return " ".join(sentence() for _ in range(pick([1, 1, 2, 3, 4, 8])))

    def any_text() -> str:
        kind = rnd.random()
        if style != "bare" and rnd.random() < 0.06:  # what a page says elsewhere too, as the article's own words
            return pick(["All rights reserved.", f"Copyright 2011 {words(1, 2)}.", f"Read more in {words(1, 4)}.", f"The cookie {words(1, 9)}.", f"Share the {words(1, 6)}.", f"No comments {words(0, 3)}."])
        return prose() if kind < 0.82 else words(1, 50) if kind < 0.9 else words(2, 40).upper() if kind < 0.94 else pick([", ", " - ", " / ", " · "]).join(word() for _ in range(rnd.randint(3, 30)))

    def link(text: str = "") -> str:
        return f'<a href="/{word()}">{text or words(1, 3)}</a>'

    def links() -> str:
        some = [link() for _ in range(rnd.randint(2, 8))]
        return pick(["<ul>" + "".join(f"<li>{x}</li>" for x in some) + "</ul>", "<ul><li>" + "<li>".join(some) + "</ul>", pick([" ", " | ", "<br>"]).join(some), "".join(f"<div>{x}</div>" for x in some)])

    def named(tag: str, names: str, body: str) -> str:
        """An element that its name tells, or one of a name that tells nothing, or of none."""
        if style == "bare" and tag not in ("form", "button"):
            return f"<p>{body}</p>" if rnd.random() < 0.4 and not _BLOCKY.search(body) else f"<div>{body}</div>"
        name = pick(names.split())
        if rnd.random() < 0.25:
            name = pick([f"{name}-{word()}", f"js-{name}", f"{word()} {name}", f"{name}Box"])
        return f'<{tag} {pick(["class", "class", "id"])}="{name}">{body}</{tag}>'

    def other(kind: str) -> str:
        s = prose() if rnd.random() < 0.5 else sentence(2, 8)
        by = style == "semantic" and rnd.random() < 0.8
        if kind == "menu":
            return f"<nav>{links()}</nav>" if by else named("div", "menu main-nav navbar breadcrumb topnav", links())
        if kind == "top":
            body = pick([f"<h1>{words(1, 4)}</h1>{link()}", f"<p>{words(1, 6)}</p>", f"<div>{link()}</div><p>{sentence(2, 8)}</p>", f"<p>{s}</p>"])
            return f"<header>{body}</header>" if by else named("div", "header masthead site-header logo brand", body)
        if kind == "side":
            body = f"<h3>{pick([words(1, 3), 'Read next', 'More ' + word(), 'Related'])}</h3>" + pick([links(), f"<p>{s}</p>", f"<p>{s}</p>{links()}"])
            return f"<aside>{body}</aside>" if by else named("div", "sidebar widget related-posts rail recommended", body)
        if kind == "ad":
            body = pick([s, f"<p>{s}</p>", f"<p>Advertisement</p><p>{link(words(2, 8))}</p>", f"Sponsored: {link(s)}"])
            return named(pick(["div", "div", "aside"]) if style != "bare" else "div", "ad ads advert sponsored advertisement promo", body)
        if kind == "notice":
            body = pick([f"<p>{s}</p><button>{words(1, 2)}</button>", f"<p>We use cookies {words(1, 9)}.</p>", f"<p>Subscribe to our newsletter {words(0, 5)}.</p>"])
            return pick([f'<div role="alert">{body}</div>', f"<dialog>{body}</dialog>"]) if by else named("div", "cookie-notice consent gdpr newsletter notice popup", body)
        if kind == "form":
            return named("form", "search login contact signup", f"<label>{pick([words(1, 3), 'Search', 'Sign in'])}</label><input name=x>{pick(['', f'<p>{s}</p>'])}<select><option>{word()}<option>{word()}</select><button>{words(1, 2)}</button><textarea>{s}</textarea>")
        if kind == "talk":
            each = [f"<b>{word()}</b><p>{sentence()} {sentence()}</p>" for _ in range(rnd.randint(1, 4))]
            head = f"<h2>{pick([words(1, 3) if style != 'bare' else 'Discussion', 'Comments', str(len(each)) + ' comments', 'Leave a reply'])}</h2>"
            if by:
                return f'<section {pick(["class", "id"])}="{pick(["comments", "discussion", "replies"])}">{head}' + "".join(pick([f"<article>{x}</article>", f"<div>{x}</div>"]) for x in each) + "</section>"
            return named("div", "comments comment-list discussion replies", head * (style == "bare" or rnd.random() < 0.5) + "".join(f'<{tag} class="{pick(["comment", "reply", word()])}">{x}</{tag}>' for tag, x in ((pick(["div", "li", "article"]), x) for x in each)))
        if kind == "share":
            return named("div", "share social-links tags byline", pick([f"{link()} {link()}", f"Share {link()} {link()}", f"<span>{word()} {rnd.randint(1, 28)}.{rnd.randint(1, 12)}.20{rnd.randint(10, 24)}</span>"]))
        body = pick([f"&copy; 20{rnd.randint(10, 24)} {words(1, 3)}", f"Copyright 20{rnd.randint(10, 24)} {words(1, 2)}. All rights reserved.", f"<p>{s}</p>{links()}", f"<p>{sentence(2, 9)}</p>", f"{links()}<p>All rights reserved</p>", f"{link('Privacy')} {link('Terms')} {link()}"])
        return f"<footer>{body}</footer>" if by else named("div", "footer site-footer legal copyright", body)

    out = []
    for _ in range(n):
        style = pick(["semantic", "semantic", "named", "named", "bare"])
        want: list[str] = []
        body: list[str] = []
        hero = ""

        def add(text: str, shown: str) -> None:
            want.append(text)  # noqa: B023
            body.append(shown)  # noqa: B023

        def part() -> None:
            kind = rnd.random()
            if kind < 0.62:
                text = any_text()
                shown = text.replace(" ", " <b>", 1) if rnd.random() < 0.1 else text
                add(text, f"<p>{shown}" + pick(["</p>", "</p>", ""]) if style != "bare" or rnd.random() < 0.5 else f"<div>{shown}</div>")
            elif kind < 0.7:
                text = words(1, 8)
                add(text, f"<h2>{text}</h2>" if rnd.random() < 0.8 else f"<h3>{text}</h3>")
            elif kind < 0.8:
                tag, rows = pick(["ul", "ol"]), [pick([words(1, 5), sentence(2, 9), any_text()]) for _ in range(rnd.randint(1, 6))]
                want.extend(rows)  # noqa: B023
                body.append(f"<{tag}>" + "".join(f"<li>{x}" + pick(["</li>", ""]) for x in rows) + f"</{tag}>")  # noqa: B023
            elif kind < 0.86:
                rows = [words(2, 7) + pick(["", ",", ".", ""]) for _ in range(rnd.randint(2, 9))]
                add(" ".join(rows), "<p>" + "<br>".join(rows) + "</p>")
            elif kind < 0.92:
                text = prose()
                add(text, f"<blockquote><p>{text}</p></blockquote>")
            else:
                rows = [pick([words(1, 3), sentence(2, 8), str(rnd.randint(1, 900)) + " " + word()]) for _ in range(rnd.randint(1, 6))]
                want.extend(rows)  # noqa: B023
                body.append(pick(["<table><tr>" + "".join(f"<td>{x}</td>" for x in rows) + "</tr></table>", "<dl>" + "".join(f"<{d}>{x}</{d}>" for d, x in ((pick(["dt", "dd"]), x) for x in rows)) + "</dl>"]))  # noqa: B023

        if rnd.random() < 0.75:
            title, kind = words(1, 12), rnd.random()
            shown = f"<h1>{title}</h1>" if style != "bare" or kind < 0.7 else f"<div>{title}</div>"
            if style == "semantic" and kind < 0.4:  # in a header of the article's own
                shown = f"<header>{shown}{pick(['', '', other('share')])}</header>"
            elif style == "named" and kind < 0.35:
                shown = f'<div class="{pick(["hero", "post-header", "entry-header", "article-header", "title"])}">{shown}</div>'
                if kind < 0.15:  # over the article, not in it
                    want.append(title)
                    hero, shown = shown, ""
            if shown:
                add(title, shown)
        for _ in range(pick([1, 1, 1, 2, 3, 5, 9])):
            part()
        for kind in rnd.sample(["ad", "share", "side", "form", "notice"], pick([0, 0, 0, 1, 2])) if style != "bare" else []:
            body.insert(rnd.randint(min(1, len(body)), len(body)), other(kind))
        whole = "".join(body)
        if style == "semantic":
            whole = pick(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>"]).format(whole)
        elif style == "named":
            whole = pick(['<div class="post-content">{}</div>', '<div id="content"><div class="entry">{}</div></div>', '<div class="article-body">{}</div>', '<main class="w">{}</main>', '<section class="story">{}</section>', "<div><div>{}</div></div>"]).format(whole)
        else:
            whole = pick(["<div>{}</div>", "<div><div>{}</div></div>", "{}", "<table><tr><td>{}</td></tr></table>", "<section>{}</section>"]).format(whole)
        often = 0.25 if rnd.random() < 0.2 else 0.5
        before = [other(k) for k in ("top", "menu", "notice", "ad", "form", "side") if rnd.random() < often and (style != "bare" or k in ("top", "menu", "notice"))]
        after = [other(k) for k in ("talk", "share", "side", "ad", "form", "foot", "notice") if rnd.random() < often and (style != "bare" or k in ("foot", "share", "notice"))]
        if rnd.random() < 0.1:  # nothing but the article
            before, after = [], []
        out.append(("<html><body>" * rnd.randint(0, 1) + "".join(before) + hero + whole + "".join(after), {_SPACE.sub(" ", w) for w in want}))
    return out


@lru_cache(maxsize=1)
def model() -> crf.Crf:
    sequences, gold = [], []
    for page, want in training_pages():
        bs = blocks(page)
        sequences.append(features(bs))
        gold.append([int(b.text in want) for b in bs])
    return crf.train(sequences, gold, l2=0.1)


def main_texts(pages: list[str], field: crf.Crf) -> list[str]:
    cut = [blocks(p) for p in pages]
    n = np.fromiter(map(len, cut), np.int64, len(cut))
    label = field.viterbi(n, field.emissions(list(chain.from_iterable(features(c) for c in cut)))).tolist()
    out, at = [], 0
    for c in cut:
        out.append(" ".join(b.text for b, y in zip(c, label[at : at + len(c)], strict=True) if y))
        at += len(c)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: the article of each page, its blocks in page order, joined by one space;
    character references decoded, white space inside a block made one space.

    A null or empty page, and one without an article, gives an empty text; null ids and urls stay null;
    repeated rows give repeated rows; pages of any length and depth are read whole, in time that grows with
    their length; an empty table gives no rows; other columns, whatever their names, are dropped."""
    field = model()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("text"), F.col("url").cast("string").alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls, at = b.column(2), 0
            for ids, texts in batches_by_size(b):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), urls.slice(at, len(ids)), pa.array(main_texts(texts, field), pa.string())], ["page_id", "url", "text"])
                at += len(ids)

    return rows.mapInArrow(run, "page_id long, url string, text string")
