"""Main text of web pages by a tree-structured graphical model.

A page is parsed into a tree of elements. Every element has a binary state, main
text or not; potentials tie it to its own features and to its parent's state.
Sum-product messages pass upward and then downward through the tree, which gives
each element's exact marginal. Blocks of text whose element is more likely than
not main text make up the result.

The potentials are trained from labelled pages: gradient ascent on the
likelihood of their labels, whose gradient is the difference between the
labelled states and the marginals that the same message passing gives. The
labelled pages are written here: layouts with known main text, from a grammar.

What holds for any page: comments, scripts, styles, templates and form controls
aren't text; character references are decoded; white space in a block becomes one
space; blocks are joined by two line feeds in page order.

Nulls: null html is an empty page, its text empty. A page without main text has an
empty text. Unclosed and misnested tags are repaired as browsers do in outline.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _io, _text

#: A tag; quotes count after an equals sign only.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]+|=\s*(?:\"[^\"]*\"|'[^']*')|[\"'=])*+)>")
#: A tag up to the next end sign, whatever its quotes.
_TAG_AT_LEAST = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WHITE = re.compile(r"[\s\xa0]+")
_NAME = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their own closing tag. Without one, the rest of the page is theirs if they are code; else they are passed over.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in "script style textarea title xmp iframe noscript noembed noframes".split()}
CODE = ("script", "style")
#: Elements with markup that is never text of the page; one that is never closed is passed over.
DROPPED = frozenset("head template object svg math canvas select optgroup option button datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br input".split())
#: Elements that end an open paragraph.
BLOCK = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
#: Elements that end an open one of the same group, up to the element that holds the group.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_TAGS = "html body article main section div p h1 h2 h3 h4 ul ol li table tr td nav header footer aside form figure figcaption blockquote pre dl address details text".split()
#: Elements that hold text themselves.
_TEXT = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 ul ol dl table".split())
#: Words of class, id and role, by what they speak of.
_HINTS = {
    "main": "article articlebody entry content story post main body text",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination tabs links skip",
    "edge": "header footer masthead banner topbar copyright legal colophon contentinfo bottom",
    "side": "sidebar side aside rail related widget widgets trending popular recommended recommendations more tags complementary",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion promoted",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe signup paywall privacy dialog",
    "comment": "comment comments reply replies disqus respond discussion feedback review reviews thread",
    "share": "share sharing social byline author meta toolbar login search buttons",
}
_HINT = {w: k for k, words in _HINTS.items() for w in words.split()}
STEPS = 70
#: Characters of pages whose trees are worked on at once.
AT_ONCE = 1 << 18
FEATURES = [*(f"tag:{t}" for t in _TAGS), "tag:other", *(f"hint:{k}" for k in _HINTS), "links", "no_text", "hidden", "top", "top_text", "most", "bias"]
_AT = {f: i for i, f in enumerate(FEATURES)}


class Node:
    __slots__ = ("children", "hints", "links", "parent", "parts", "size", "tag")

    def __init__(self, tag: str, parent: int, hints: frozenset[str] = frozenset()) -> None:
        self.tag, self.parent, self.hints = tag, parent, hints
        self.children: list[int] = []
        self.parts: list[tuple[int, str]] = []
        self.size = self.links = 0


def _hints(attributes: str) -> frozenset[str]:
    found = set()
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            found.update(_HINT[w] for w in _NAME.findall(value) if w in _HINT)
        elif name in ("hidden", "data-hidden") or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "aria-hidden" and value == "true":
            found.add("hidden")
    return frozenset(found)


def parse(source: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements (parents first; inline ones belong to the element around them) and blocks (element, text) in page order."""
    nodes, blocks = [Node("html", -1)], []
    open_ = [(0, "html", False)]  # element, name, whether its text is dropped
    text: list[str] = []
    last_end = source.rfind(">")
    lasts: dict[str, int] = {}
    lower = ""
    links = at = seek = 0
    tag = _TAG

    def flush() -> None:
        said = _WHITE.sub(" ", entities.unescape("".join(text))).strip()
        text.clear()
        if said:
            blocks.append((open_[-1][0], said))

    def say(said: str) -> None:
        if said and not open_[-1][2]:
            text.append(said)
            if links:
                nodes[open_[-1][0]].links += len(said.strip())

    def close(names: set[str] | frozenset[str], limits: set[str] | frozenset[str]) -> None:
        for i in range(len(open_) - 1, 0, -1):
            if open_[i][1] in names:
                if not open_[i][2]:
                    flush()
                del open_[i:]
                return
            if open_[i][1] in limits:
                return

    while (start := source.find("<", seek)) >= 0 and start < last_end:
        if source.startswith("<!--", start):
            say(source[at:start])
            end = _COMMENT_END.search(source, start + 2)  # "<!-->" is a whole comment
            at = seek = end.end() if end else len(source)
            continue
        if source[start + 1] in "!?" or source[start + 1] == "/" and not source[start + 2 : start + 3].isalpha():
            say(source[at:start])
            at = seek = source.index(">", start) + 1
            continue
        m = tag.match(source, start)
        if m is None and tag is _TAG and source[start + 1 : start + 2].isascii() and source[start + 1 : start + 2].isalpha() or m is None and source[start + 1] == "/" and tag is _TAG:
            tag = _TAG_AT_LEAST  # from here on, no end sign stands outside of quotes
            m = tag.match(source, start)
        if m is None:
            seek = start + 1
            continue
        say(source[at:start])
        at = seek = m.end()
        name, dropped = m[2].lower(), open_[-1][2]
        if m[1]:
            if name == "a":
                links = 0
            elif name not in INLINE and name not in VOID:
                close({name}, frozenset())
        elif name in RAW:
            end = RAW[name].search(source, at) if lasts.get(name, 0) >= 0 else None
            if end:
                at = seek = end.end()
            elif name in CODE:
                at = seek = len(source)
            else:
                lasts[name] = -1
        elif name in DROPPED:
            if name in ("svg", "math") and m[3].endswith("/"):
                continue
            if name not in lasts:
                lower = lower or source.lower()
                lasts[name] = lower.rfind(f"</{name}")
            if name == "button":
                close({"button"}, frozenset())
            if lasts[name] >= at:
                open_.append((open_[-1][0], name, True))
        elif dropped:
            if name == "body":
                close({"head"}, frozenset())
            elif name not in INLINE and name not in VOID and not m[3].endswith("/"):
                open_.append((open_[-1][0], name, True))
        elif name == "br":
            text.append(" ")
        elif name == "a":
            links = 1
        elif name in VOID:
            if name == "hr":
                close({"p"}, frozenset())
                flush()
        elif name not in INLINE and name not in ("html", "body"):
            flush()
            if name in BLOCK:
                close({"p"}, {"td", "th", "li", "div", "article", "section", "main"} - {"p"})
            if name in _ENDS:
                close(*_ENDS[name])
            links = 0
            nodes.append(Node(name, open_[-1][0], _hints(m[3])))
            nodes[open_[-1][0]].children.append(len(nodes) - 1)
            open_.append((len(nodes) - 1, name, False))
    say(source[at:])
    flush()
    for i, said in blocks:
        nodes[i].size += len(said)
    return nodes, blocks


def _indexes(nodes: list[Node]) -> list[list[int]]:
    """The features that each element has."""
    held = [x.size for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        held[nodes[i].parent] += held[i]
    every = []
    for node, free, size in zip(nodes, _free(nodes), held, strict=True):
        out = [_AT["bias"], _AT.get(f"tag:{node.tag}", _AT["tag:other"])]
        out += [_AT["hidden"] if h == "hidden" else _AT[f"hint:{h}"] for h in node.hints]
        if not node.size:
            out.append(_AT["no_text"])
        elif 2 * node.links > node.size:
            out.append(_AT["links"])
        if free:
            out.append(_AT["top_text" if node.tag in _TEXT else "top"])
        if 2 * size > held[0]:
            out.append(_AT["most"])
        every.append(out)
    return every


def _free(nodes: list[Node]) -> list[bool]:
    """Whether each element's state is untied from its parent's: the page as a whole is neither main text nor not."""
    return [nodes[x.parent].tag in ("html", "body") for x in nodes]


def levels(parents: list[int]) -> list[np.ndarray]:
    """The nodes of each depth, the roots' first; parents (below 0: none) come before their children."""
    depth = []
    for p in parents:
        depth.append(depth[p] + 1 if p >= 0 else 0)
    depth = np.array(depth)
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


def marginals(parents: list[int], free: list[bool], own: np.ndarray, pair: np.ndarray, by_depth: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product on trees: messages upward, then downward, a depth at a time, in logarithms.

    own[i, s]: log potential of state s; pair[s, t]: of a parent in s over a child in t, unless the child is free.
    Returns each node's marginal, and for each node but the roots that of (its parent's state, its own).
    """
    by_depth = by_depth or levels(parents)
    over = np.asarray(parents)
    ties = np.where(np.asarray(free)[:, None, None], 0.0, pair[None])
    up, sent = own.astype(np.float64), np.zeros((len(over), 2))
    for at in by_depth[:0:-1]:
        sent[at] = np.logaddexp(ties[at, :, 0] + up[at, :1], ties[at, :, 1] + up[at, 1:])
        np.add.at(up, over[at], sent[at])
    belief, edge = np.zeros((len(over), 2)), np.zeros((len(over), 2, 2))
    at = by_depth[0]
    belief[at] = up[at] - np.logaddexp(up[at, 0], up[at, 1])[:, None]
    for at in by_depth[1:]:
        both = (belief[over[at]] - sent[at])[:, :, None] + ties[at] + up[at][:, None, :]
        both -= np.logaddexp.reduce(both.reshape(-1, 4), 1)[:, None, None]
        edge[at] = np.exp(both)
        belief[at] = np.logaddexp(both[:, 0], both[:, 1])
    return np.exp(belief), edge


def content(pages: list[list[Node]], weights: np.ndarray, pair: np.ndarray) -> list[np.ndarray]:
    """The probability of main text for each element of each page."""
    starts = np.cumsum([0, *map(len, pages)]).tolist()
    parents = [x.parent + a if x.parent >= 0 else -1 for nodes, a in zip(pages, starts[:-1], strict=True) for x in nodes]
    own = np.zeros((len(parents), 2))
    own[:, 1] = [weights[found].sum() for nodes in pages for found in _indexes(nodes)]
    belief = marginals(parents, [x for nodes in pages for x in _free(nodes)], own, pair)[0][:, 1]
    return [belief[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def training_pages(n: int = 180, seed: int = 6) -> list[tuple[str, list[str]]]:
    """Labelled pages: html, and the main text's blocks. Layouts from a grammar, words without meaning."""
    r = random.Random(seed)

    def say(a: int, b: int) -> str:
        return " ".join("".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b)))

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{say(1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    def named(words: str) -> str:
        return r.choice([f'class="{w}"' for w in words.split()] + [f'id="{w}"' for w in words.split()])

    def junk(kind: str) -> str:
        many = "".join(f"<p>{say(4, 60)}</p>" for _ in range(r.randint(1, 3)))
        few = r.choice([say(3, 30), f"<p>{say(3, 40)}</p>", many])
        if kind == "menu":
            return r.choice([f"<nav>{links(r.randint(2, 8))}</nav>", f"<div {named(_HINTS['menu'])}>{links(4)}</div>"])
        if kind == "edge":
            return r.choice([f"<footer>&copy; {few}</footer>", f"<header><h1>{say(1, 4)}</h1>{few}</header>", f"<div {named(_HINTS['edge'])}>{few}</div>"])
        if kind == "side":
            return r.choice([f"<aside><h3>{say(1, 3)}</h3>{few}</aside>", f"<aside>{links(4)}</aside>", f"<div {named(_HINTS['side'])}>{few}</div>"])
        if kind == "form":
            return f"<form><label>{say(1, 3)}</label><input name=q><p>{say(3, 30)}</p></form>"
        if kind == "comment":
            return f'<{(t := r.choice(["div", "section", "ol"]))} {named(_HINTS["comment"])}><h2>{say(1, 2)}</h2>{many}<div>{few}</div><article><p>{say(5, 40)}</p></article></{t}>'
        return f"<div {named(_HINTS[kind])}>{few}</div>"

    out = []
    for _ in range(n):
        said: list[str] = []

        def block(tag: str, a: int, b: int, said=said) -> str:
            t = say(a, b)
            said.append(t)
            return f"<{tag}>{t}</{tag}>"

        def body() -> str:
            parts = [block("h1", 2, 12)] if r.random() < 0.8 else []
            for _ in range(r.randint(1, 9)):
                x = r.random()
                if x < 0.7:
                    parts.append(block("p", 1, 80))
                elif x < 0.76:
                    parts.append(block(r.choice(["h2", "h3", "h4"]), 1, 8))
                elif x < 0.82:
                    t = r.choice(["ul", "ol"])
                    parts.append(f"<{t}>" + "".join(block("li", 1, 20) for _ in range(r.randint(1, 4))) + f"</{t}>")
                elif x < 0.86:
                    parts.append("<blockquote>" + block("p", 3, 40) + "</blockquote>")
                elif x < 0.9:
                    parts.append(r.choice(["<section>", "<div>"]) + block("p", 3, 40) + block("p", 3, 40) + "</section>")
                elif x < 0.93:
                    parts.append("<table><tr>" + block("td", 1, 4) + block("td", 1, 4) + "</tr></table>")
                elif x < 0.95:
                    parts.append(block("pre", 2, 20))
                else:
                    parts.append(junk(r.choice(["advert", "notice", "share", "side", "form", "comment"])))
            return "".join(parts)

        shape = r.random()
        hint = named(_HINTS["main"])
        if r.random() < 0.15:  # next to nothing but the text
            few = "".join(block("p", 1, 60) for _ in range(r.randint(1, 3)))
            if r.random() < 0.2:  # not even a paragraph
                few = said[0]
                del said[1:]
            out.append((r.choice(["<body>{}</body>", "<body><article>{}</article></body>", "{}", "<html><body><div>{}</div></body></html>", "<main>{}</main>", "<body><nav>" + links(3) + "</nav>{}</body>"]).format(few), said))
            continue
        inner = f"<article>{body()}</article>" if shape < 0.45 else f"<main>{body()}</main>" if shape < 0.6 else f"<div {hint}>{body()}</div>" if shape < 0.75 else f"<main><article {hint}>{body()}</article>{junk('comment')}</main>" if shape < 0.9 else f"<div>{body()}</div>"
        if r.random() < 0.3:
            inner = f"<div>{inner}{junk('side')}</div>"
        before = "".join(junk(k) for k in ("edge", "menu", "notice", "advert", "form") if r.random() < 0.5)
        after = "".join(junk(k) for k in ("comment", "side", "advert", "share", "menu", "edge") if r.random() < 0.5)
        out.append((f"<html><head><title>{say(1, 5)}</title></head><body>{before}{inner}{after}</body></html>", said))
    return out


@lru_cache(1)
def model() -> tuple[np.ndarray, np.ndarray]:
    """(weights of features, log potentials of a parent's state over a child's), trained from the labelled pages."""
    pages = []
    for source, said in training_pages():
        nodes, blocks = parse(source)
        main, left = np.zeros(len(nodes), int), list(said)
        for i, text in blocks:
            if left and text == left[0]:
                left.pop(0)
                main[i] = 1
        held = np.zeros(len(nodes), int)  # main text beneath, other text beneath
        other = np.zeros(len(nodes), int)
        for i, text in blocks:
            (held if main[i] else other)[i] += len(text)
        for i in range(len(nodes) - 1, 0, -1):
            held[nodes[i].parent] += held[i]
            other[nodes[i].parent] += other[i]
        pages.append((nodes, (held > other).astype(int) | main))
    weights, pair = np.zeros(len(FEATURES)), np.zeros((2, 2))
    state = np.concatenate([x for _, x in pages])
    free = np.concatenate([_free(nodes) for nodes, _ in pages])
    starts = np.cumsum([0, *(len(nodes) for nodes, _ in pages)])
    parents = [x.parent + a if x.parent >= 0 else -1 for (nodes, _), a in zip(pages, starts[:-1].tolist(), strict=True) for x in nodes]
    by_depth, over = levels(parents), np.array(parents)
    has = np.zeros((len(parents), len(FEATURES)))
    for i, found in enumerate(x for nodes, _ in pages for x in _indexes(nodes)):
        has[i, found] = 1
    tied = np.flatnonzero(~free & (over >= 0))
    wanted = np.zeros((2, 2))
    np.add.at(wanted, (state[over[tied]], state[tied]), 1)
    squares, pair_squares = np.full(len(FEATURES), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(STEPS):  # AdaGrad
        own = np.zeros((len(parents), 2))
        own[:, 1] = has @ weights
        belief, edge = marginals(parents, free, own, pair, by_depth)
        gradient = has.T @ (state - belief[:, 1]) - 1e-3 * weights * len(pages)
        pair_gradient = wanted - edge[tied].sum(0) - 1e-3 * pair * len(pages)
        squares += gradient**2
        pair_squares += pair_gradient**2
        weights = weights + 0.6 * gradient / np.sqrt(squares)
        pair = pair + 0.6 * pair_gradient / np.sqrt(pair_squares)
    return weights, pair


def main_texts(sources: list[str | None], weights: np.ndarray, pair: np.ndarray) -> list[str]:
    """The main text of each page."""
    parsed = [parse(x or "") for x in sources]
    held = content([nodes for nodes, _ in parsed], weights, pair) if parsed else []
    return ["\n\n".join(text for i, text in blocks if main[i] > 0.5) for (_, blocks), main in zip(parsed, held, strict=True)]


def main_text(source: str | None, weights: np.ndarray, pair: np.ndarray) -> str:
    return main_texts([source], weights, pair)[0]


_SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html)."""
    weights, pair = (x.tolist() for x in model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, p = np.array(weights), np.array(pair)
        for batch in batches:
            texts = [x for _, some in _text.text_lists(batch.column(2), AT_ONCE) for x in main_texts(some, w, p)]
            yield _io.to_batch(_SCHEMA, {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": list(map(len, texts))})

    return _io.pick(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(run, _SCHEMA)
