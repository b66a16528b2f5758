"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a sequence of tags, which score below zero, and words, which score above zero where their
surroundings look like an article. One linear scan finds the contiguous stretch of the highest sum: the content region. Blocks in it
whose surroundings are those of menus, adverts or comments are left out.

The weights come from labelled pages, made by a seeded generator from the layouts in common use: a logistic
regression on the surroundings of a block gives the words' weight, and the odds of a tag inside and outside of articles its own.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

# What is not a tag is text: also a lone "<". Quoted values end at "<" at the latest, which keeps the scan linear.
TAG = re.compile(r"""<!--|<(/?)([A-Za-z][^\s>/]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([A-Za-z][^\s>/]*)([^>]*)>|<[!?][^>]*>""")
#: A tag that the page breaks off in.
OPEN_END = re.compile(r"<[/A-Za-z!?]")
#: What a page doesn't show as text, or only in a form.
RAW = frozenset(("script", "style", "template", "textarea", "title", "iframe", "noscript", "svg", "select", "annotation", "annotation-xml"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"))
INLINE = frozenset(("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "acronym", "ruby", "rt", "rp", "math", "semantics", "mrow", "mi", "mo", "mn", "ms", "mtext", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mstyle", "mspace", "mfenced", "mpadded", "object", "canvas", "audio", "video", "picture"))
#: An opening tag that ends an open element of these names.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PLACES = frozenset(("nav", "header", "footer", "aside", "article", "main", "form", "menu", "dialog", "button", "section", "figure", "table", "ul", "ol", "p", "h1", "h2", "h3", "blockquote", "pre", "a", "address"))
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Attributes whose values name the part of the page.
NAMING = frozenset(("class", "id", "role", "aria-label"))
WORD = re.compile(r"[a-z]+")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)


def attributes_of(source: str) -> tuple[set[str], bool]:
    """Words of the values that name an element, and whether it is hidden."""
    names: set[str] = set()
    hidden = False
    for name, *values in ATTRIBUTE.findall(source):
        name, value = name.lower(), "".join(values)
        if name in NAMING:
            names.update(WORD.findall(value.lower()))
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.strip().lower() == "true"
        elif name == "style":
            hidden |= bool(NOT_SHOWN.search(value))
    return names, hidden


@dataclass
class Block:
    text: str
    around: frozenset[str]
    linked: float


    @property
    def linked_list(self) -> bool:
        """Mostly links, as menus are; in an article that says nothing: its paragraphs may be links too."""
        return self.linked > 0.5 and not {"article", "main"} & self.around


@dataclass
class Tag:
    name: str
    around: frozenset[str]


def parse(page: str) -> list[Tag | Block]:
    """Tags and blocks of text in page order, with the features of the elements around them."""
    out: list[Tag | Block] = []
    stack: list[tuple[str, frozenset[str]]] = [("", frozenset())]
    words: list[tuple[str, bool]] = []
    at, n = 0, len(page)

    def flush() -> None:
        if words:
            text = " ".join("".join(w for w, _ in words).split())
            if text:
                linked = sum(len(w.strip()) for w, link in words if link)
                out.append(Block(text, stack[-1][1] - {"a"}, linked / max(1, sum(len(w.strip()) for w, _ in words))))
            words.clear()

    def add(text: str) -> None:
        if text and "head" not in stack[-1][1]:
            words.append((html.unescape(text), "a" in stack[-1][1]))

    while at < n:
        m = TAG.search(page, at) if page.find(">", at) >= 0 or page.find("<!--", at) >= 0 else None
        if m is None:
            cut = OPEN_END.search(page, at)
            add(page[at : cut.start()] if cut else page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            out.append(Tag(f"/{name}", stack[-1][1] - {"a"}))
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = n if close < 0 else close + 1
            if name not in INLINE:
                flush()
            continue
        if name == "br":
            words.append((" ", False))
            continue
        if name not in INLINE:
            flush()
            if name == "body":
                del stack[1:]
            ends = CLOSES.get(name, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in PLACES and stack[k][0] not in ("p", "a"):
                    break
        if name in VOID:
            continue
        attributes = m[3] or m[6] or ""
        inside, own = stack[-1][1], set()
        if name in PLACES:
            own.add(f"{name} in article" if name in ("header", "footer", "section") and "article" in inside else name)
        named, hidden = attributes_of(attributes) if attributes else ((), False)
        own.update(f".{w}" for w in named)
        if name == "head" or hidden:
            own.add("head")
        if attributes.endswith("/") and name not in ("p", "div", "a", "span"):
            continue
        stack.append((name, inside | own if own else inside))
        out.append(Tag(" ".join(sorted(own - {"a"})) or name, inside - {"a"}))
    flush()
    return out


# ---- labelled pages

FILLER = ("the", "onde", "raste", "milo", "ter", "and", "of", "sana", "quel", "der", "ist", "para", "uno")
# Names that layouts in common use give to parts of a page.
NOISE = {
    "nav": [("nav", ""), ("ul", "menu"), ("div", "navbar"), ("div", "breadcrumb"), ("div", "breadcrumbs"), ("ul", "navigation"), ("div", "nav"), ("div", "pagination"), ("div", "pager"), ("div", "toc"), ("div", "skip")],
    "text": [("header", ""), ("footer", ""), ("aside", ""), ("div", "header"), ("div", "footer"), ("div", "sidebar"), ("div", "widget"), ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("section", "sponsor"), ("div", "sponsored"), ("div", "promo"), ("div", "banner"), ("div", "cookie"), ("div", "cookies"), ("div", "consent"), ("div", "notice"), ("div", "alert"), ("div", "popup"), ("div", "modal"), ("div", "overlay"), ("div", "newsletter"), ("div", "subscribe"), ("div", "signup"), ("div", "related"), ("div", "recommended"), ("div", "share"), ("div", "social"), ("div", "copyright"), ("div", "legal"), ("div", "masthead"), ("div", "tags"), ("div", "gdpr"), ("div", "paywall"), ("dialog", ""), ("menu", ""), ("p", "ad"), ("p", "notice"), ("p", "copyright"), ("aside", "sidebar"), ("div", "rail"), ("div", "teaser"), ("div", "disclaimer"), ("div", "privacy"), ("div", "complementary"), ("div", "contentinfo"), ("div", "navigation")],
    "form": [("form", ""), ("div", "login"), ("div", "search"), ("form", "subscribe"), ("form", "newsletter"), ("form", "search")],
    "comments": [("section", "comments"), ("div", "comment"), ("div", "comments"), ("ol", "comments"), ("div", "replies"), ("div", "disqus"), ("div", "discussion"), ("section", "responses"), ("div", "reply"), ("ul", "commentlist"), ("article", "comment"), ("div", "reviews")],
}
CONTENT = [("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "post"), ("div", "entry"), ("div", "article"), ("section", "article"), ("div", "main"), ("div", "story"), ("div", "body"), ("div", "text"), ("section", ""), ("div", "")]


def labelled_pages(n: int, seed: int) -> Iterator[list[tuple[str, frozenset[str], bool, int, bool]]]:
    """Pages as the blocks and tags that parse() gives, each with whether it is of the article."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    words = lambda low, high: " ".join(pick(FILLER) for _ in range(int(rng.integers(low, high))))
    mark = {True: "wanted", False: "other"}  # the first word of a block tells its label

    def wrap(place: tuple[str, str], inner: str) -> str:
        tag, name = place
        return f"<{tag}{f' {pick(("class", "id"))}={chr(34)}{name}{chr(34)}' if name else ''}>{inner}</{tag}>"

    def noise() -> str:
        kind = pick(("nav", "text", "text", "text", "form", "comments"))
        place = pick(NOISE[kind])
        line = lambda: f"{mark[False]} {words(2, 30)}"
        links = lambda: "<ul>" + "".join(f'<li><a href="/">{mark[False]} {words(1, 3)}</a></li>' for _ in range(int(rng.integers(2, 7)))) + "</ul>"
        if kind == "nav":
            return wrap(place, pick((links(), links(), line())))
        if kind == "form":
            return wrap(place, f"<label>{line()}</label><input><button>{line()}</button>")
        if kind == "comments":
            return wrap(place, "".join(pick((f"<div class='comment'><p>{line()}</p></div>", f"<p>{line()}</p>", f"<li>{line()}</li>", f"<article><p>{line()}</p></article>")) for _ in range(int(rng.integers(1, 4)))))
        return wrap(place, pick((line(), f"<p>{line()}</p>", f"<h3>{line()}</h3><p>{line()}</p>", links(), f'<p>{line()} <a href="/">{words(1, 3)}</a></p>')))

    def good() -> str:
        line = f"{mark[True]} {words(3, 60)}"
        return pick((f"<p>{line}</p>", f"<p>{line}</p>", f"<p>{line}</p>", f"<h2>{line}</h2>", f"<h3>{line}</h3>", f"<ul><li>{line}</li></ul>", f"<blockquote><p>{line}</p></blockquote>", f"<pre>{line}</pre>", f"<table><tr><td>{line}</td></tr></table>", f'<p>{line} <a href="/x">{words(1, 2)}</a></p>', f"<figure><figcaption>{line}</figcaption></figure>", f"<div>{line}</div>", f"<section><p>{line}</p></section>"))

    for _ in range(n):
        title = f"<h1>{mark[True]} {words(2, 9)}</h1>"
        parts = [pick((title, title, f"<header>{title}</header>")) if (article := pick(CONTENT))[0] == "article" else title]
        for _ in range(int(rng.integers(1, 9))):
            parts.append(good())
            if rng.random() < 0.15:
                parts.append(noise())
        page = "".join(noise() for _ in range(int(rng.integers(1, 4)))) + wrap(article, "".join(parts)) + "".join(noise() for _ in range(int(rng.integers(1, 4))))
        items = parse(f"<html><head><title>x</title></head><body>{pick((page, f'<div class={chr(34)}{pick(('page', 'wrapper', 'container', 'site'))}{chr(34)}>{page}</div>'))}</body></html>")
        kinds = [x.text.split()[0] == mark[True] if isinstance(x, Block) else None for x in items]
        inside = [i for i, k in enumerate(kinds) if k]
        yield [(x.name if isinstance(x, Tag) else "", x.around, False if isinstance(x, Tag) else x.linked_list, 0 if isinstance(x, Tag) else len(x.text.split()), bool(kinds[i]) if kinds[i] is not None else inside[0] - 1 <= i <= inside[-1] + 1) for i, x in enumerate(items)]


@dataclass
class Weights:
    words: dict[str, float]
    bias: float
    linked: float
    tags: dict[str, float]
    other_tag: float

    def place(self, around: frozenset[str]) -> float:
        """Log odds that what has these surroundings is of the article."""
        return self.bias + sum(self.words.get(f, 0.0) for f in around)

    def block(self, b: Block) -> float:
        return self.place(b.around) + self.linked * b.linked_list

    def tag(self, t: Tag) -> float:
        """A menu or an advert counts once, by its own tags: what is inside it scores nothing."""
        return self.tags.get(t.name, self.other_tag) if self.place(t.around) > 0 else 0.0


@lru_cache(maxsize=4)
def learn(n: int = 600, seed: int = 17) -> Weights:
    blocks, tags = [], defaultdict(Counter)
    for page in labelled_pages(n, seed):
        for name, around, linked, size, inside in page:
            if size:
                blocks.append((around, linked, inside))
            else:
                tags[inside][name] += 1
    seen = Counter(f for around, _, _ in blocks for f in around)
    names = sorted(f for f, k in seen.items() if k >= 3)
    index = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(blocks), len(names) + 2))
    for i, (around, linked, _) in enumerate(blocks):
        x[i, [index[f] for f in around if f in index]] = 1
        x[i, -2:] = linked, 1
    y = np.array([inside for _, _, inside in blocks], dtype=float)
    w, small = np.zeros(x.shape[1]), 0.05 * np.eye(x.shape[1])
    for _ in range(12):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + small, x.T @ (y - p) - small @ w)
    total = {k: sum(c.values()) for k, c in tags.items()}
    odds = {t: log((tags[False][t] + 1) / (total[False] + 1)) - log((tags[True][t] + 1) / (total[True] + 1)) for t in set(tags[False]) | set(tags[True])}
    # a tag never speaks for content: it scores at least a little below zero
    return Weights(dict(zip(names, w[:-2].tolist(), strict=True)), float(w[-1]), float(w[-2]), {t: -min(6.0, max(0.1, o)) for t, o in odds.items()}, -0.3)


def extract(page: str | None, weights: Weights) -> str:
    """The article's blocks, joined by line feeds; empty if there are none."""
    if not page:
        return ""
    items = parse(page)
    kept: list[tuple[int, str]] = []
    best = total = 0.0
    start, region = 0, (0, -1)
    for i, x in enumerate(items):
        if isinstance(x, Block):
            odds = weights.block(x)
            if odds > 0:
                kept.append((i, x.text))
                total += min(odds, 3.0) * len(x.text.split())
        else:
            total += weights.tag(x)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, region = total, (start, i)
    return "\n".join(t for i, t in kept if region[0] <= i <= region[1])


def main_text(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for every page.

    A null or empty page has an empty text. Pages that end in mid-tag, in mid-comment or in mid-script are read as far as they go. Repeated rows are
    treated alike. An empty table gives no rows. Further columns are ignored.
    """
    weights = learn()

    def make(texts: list[str | None]) -> tuple:
        out = [extract(t, weights) for t in texts]
        return None, [out, list(map(len, out))]

    return map_texts(pages, [key, "url"], markup, "_main string, n_chars long", make).select(key, "url", F.col("_main").alias("text"), "n_chars")
