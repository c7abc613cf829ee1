"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements whose leaves are blocks of text. Each node has a hidden state,
content or not. A node's tag, the words of its class, id and role, and a leaf's length, link share and
ending are drawn given its state, and its state given its parent's; these tables are counted, with
Laplace smoothing, on labelled pages. Sum-product messages go from the leaves to the root and back, and
the blocks whose marginal probability of content is at least one half are the main text.

The labelled pages are made here from ten layouts with seeded filler words; ``data-main`` marks where
content begins and ``data-noise`` what is none inside it. Those marks are read in training only.
"""

from __future__ import annotations

import html
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What may start a token, and a plain tag: attributes have quoted values or none. Neither goes past the next "<", so all tries together are linear.
_OPENS = re.compile(r"<(?=[!?/a-zA-Z])")
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:\s++(?:[^\s<>"'=/]++(?:=(?:"[^"<>]*+"|'[^'<>]*+'))?)?)*+)(/?)>""")
_NAME_END, _SPACES = re.compile(r"[\s/>]"), re.compile(r"\s*")
_NAME_OR_EQUALS, _UNQUOTED_END = re.compile(r"[\s/>=]"), re.compile(r"[\s>]")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_MARK = re.compile(r"\bdata-(main|noise)\b")
_NAME = re.compile(r"[a-z]+")
#: Elements whose source is text up to their end tag, which is never shown.
_RAW = frozenset("script style noscript iframe textarea title".split())
#: Elements whose content is not shown, if they are closed.
_HIDDEN = frozenset("template object svg canvas audio video select annotation annotation-xml".split())
_FOREIGN = frozenset("svg math".split())
_HTML_IN_FOREIGN = frozenset("foreignobject annotation-xml".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "html head body address article aside blockquote button center details dialog dd div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr "
    "legend li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul".split()
)
#: An element that opens ends the open element of these names, up to the nearest of the scope.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr"}, {"table"}), "body": ({"head"}, {"html"}),
}
_ENDS_P = _BLOCK - {"html", "head", "body", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}
_P_SCOPE = frozenset("html body table td th caption button".split())


class Page:
    """Nodes of a page in document order: parent, features, and the text of leaves (None for elements). marks: 1 content, 0 none, when asked for."""

    def __init__(self, source: str, marks: bool = False):
        self.parent, self.features, self.text, self.label = [-1], [("t:root",)], [None], [0]
        self._stack, self._open = [("root", 0)], {"root": 1}
        self._run, self._linked, self._in_link = [], 0, 0
        at = 0
        for start, stop, closes, name, attributes in _tags(source):
            if start < at:
                continue
            self._add(source[at:start])
            at = stop
            if name is None:
                continue
            if closes:
                self._close(name)
            elif name not in _HIDDEN and name not in _RAW:
                self._begin(name, attributes, marks)
        self._add(source[at:])
        self._flush()

    def _add(self, text: str) -> None:
        if text:
            self._run.append(text)
            if self._in_link:
                self._linked += len(text)

    def _flush(self) -> None:
        if not self._run:
            return
        text = " ".join(html.unescape("".join(self._run)).split())
        size = sum(map(len, self._run))
        linked, self._run, self._linked = self._linked, [], 0
        if text:
            words = text.count(" ") + 1
            share = 0 if not linked else 1 if linked < size / 2 else 2
            top = self._stack[-1][1]
            self.parent.append(top)
            self.features.append(("t:text", f"w:{min(int(math.log2(words)), 5)}", f"l:{share}", f"e:{text[-1] in '.!?…:;' or text[-1] == chr(34)}"))
            self.text.append(text)
            self.label.append(self.label[top])

    def _begin(self, name: str, attributes: str, marks: bool) -> None:
        if name not in _BLOCK:
            if name == "a":
                self._in_link = 1
            elif name == "br":
                self._run.append("\n")
            return
        self._flush()
        self._in_link = 0
        if name in _ENDS_P and self._open.get("p"):
            self._end_within({"p"}, _P_SCOPE)
        if name in _ENDS:
            self._end_within(*_ENDS[name])
        if name in _VOID:
            return
        words = ["t:" + name]
        if "=" in attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                words.extend("c:" + x for x in _NAME.findall((m[2] or m[3] or m[4] or "").lower()))
        top = self._stack[-1][1]
        self.parent.append(top)
        self.features.append(tuple(dict.fromkeys(words)))
        self.text.append(None)
        mark = _MARK.search(attributes) if marks else None
        self.label.append(int(mark[1] == "main") if mark else self.label[top])
        self._stack.append((name, len(self.parent) - 1))
        self._open[name] = self._open.get(name, 0) + 1

    def _end_within(self, names, scope) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] in names:
                return self._pop(k)
            if self._stack[k][0] in scope:
                return None
        return None

    def _close(self, name: str) -> None:
        if name not in _BLOCK:
            if name == "a":
                self._in_link = 0
            return
        self._flush()
        if self._open.get(name):
            k = len(self._stack) - 1
            while self._stack[k][0] != name:
                k -= 1
            self._pop(k)

    def _pop(self, k: int) -> None:
        for n, _ in self._stack[k:]:
            self._open[n] -= 1
        del self._stack[k:]


class _Tokens:
    """Tags, comments and declarations of a page, each place read a fixed number of times.

    A tag by the HTML tokenizer: a quote begins a value only after "="; one that is never closed is part of an unquoted value. A walk over
    attributes that finds no end of its tag leaves its places behind, and one that comes to such a place has none either.
    """

    def __init__(self, source: str):
        self.source, self.end = source, len(source)
        self.last = {c: source.rfind(c) for c in ">\"'"}
        self.lost: set[int] = set()
        self.runs: dict[re.Pattern, tuple[int, int]] = {}

    def next(self, at: int) -> tuple[int, int, str | None, str | None, str, str] | None:
        """(start, stop, slash, name, attributes, slash at the end) of the first token from a place on; the name is None for what is no tag."""
        while m := _OPENS.search(self.source, at):
            start = m.start()
            found = self._token(start)
            if found:
                return start, *found
            at = start + 1
        return None

    def _token(self, start: int):
        source = self.source
        if source.startswith("<!--", start):
            stop = source.find("-->", start + 4)
            return self.end if stop < 0 else stop + 3, None, None, "", ""
        if m := _PLAIN.match(source, start):
            return m.end(), m[1], m[2], m[3], m[4]
        name = start + 1 + (source[start + 1] == "/")
        if name < self.end and source[name].isascii() and source[name].isalpha() and (found := self._walk(start, name)):
            return found
        if source[start + 1] in "!?/" and start < self.last[">"]:
            return source.find(">", start) + 1, None, None, "", ""
        return None

    def _first(self, pattern: re.Pattern, at: int) -> int:
        """Where a pattern is first found from a place on; searches that begin within the last one's way end where it did."""
        low, high = self.runs.get(pattern, (0, -1))
        if not low <= at <= high:
            m = pattern.search(self.source, at)
            high = m.start() if m else self.end
            self.runs[pattern] = at, high
        return high

    def _walk(self, start: int, name: int):
        if start >= self.last[">"]:
            return None
        high = self._first(_NAME_END, name)
        at, source, seen = high, self.source, []
        while at < self.end:
            if at in self.lost:
                break
            seen.append(at)
            c = source[at]
            if c == ">":
                return at + 1, source[start + 1 : name], source[name:high], source[high:at], ""
            if c == "/":
                if source.startswith(">", at + 1):
                    return at + 2, source[start + 1 : name], source[name:high], source[high:at], "/"
                at += 1
            elif c.isspace():
                at = _SPACES.match(source, at).end()
            else:
                at = self._value(self._first(_NAME_OR_EQUALS, at + 1))
        self.lost.update(seen)
        return None

    def _value(self, at: int) -> int:
        """Where an attribute ends whose name ends at a place."""
        equals = _SPACES.match(self.source, at).end()
        if not self.source.startswith("=", equals):
            return at
        value = _SPACES.match(self.source, equals + 1).end()
        quote = self.source[value : value + 1]
        if quote in ("'", '"') and value < self.last[quote]:
            return self.source.find(quote, value + 1) + 1
        return self._first(_UNQUOTED_END, value)


def _tags(source: str) -> list[tuple[int, int, bool, str | None, str]]:
    """(start, stop, whether it closes, name, attributes) of the tags of a page; name is None for comments and the like.

    stop of an element that is not shown is where its content ends: at the end tag that nests with it, for svg and math also at
    a tag of HTML that ends them. One that is empty or never closed stops at its start tag. Raw text without an end tag goes on to the end.
    """
    out: list[tuple[int, int, bool, str | None, str]] = []
    opened: dict[str, list[int]] = {}
    at, end, low = 0, len(source), None

    def hide(k: int, stop: int) -> None:
        out[k] = (out[k][0], stop, *out[k][2:])

    tokens = _Tokens(source)
    while token := tokens.next(at):
        start, at, slash, name, attributes, empty = token
        if name is None:
            out.append((start, at, False, None, ""))
            continue
        name, closes = name.lower(), bool(slash)
        if name in _BLOCK and (opened.get("svg") or opened.get("math")) and not any(map(opened.get, _HTML_IN_FOREIGN)):
            for f in _FOREIGN:
                for k in opened.pop(f, ()):
                    if f in _HIDDEN:
                        hide(k, start)
        foreign = bool(opened.get("svg") or opened.get("math"))
        out.append((start, at, closes, name, attributes))
        if closes:
            if opened.get(name):
                k = opened[name].pop()
                if name in _HIDDEN:
                    hide(k, start)
                if name in _FOREIGN:
                    opened.pop("foreignobject", None)
        elif name in _HIDDEN or name in _FOREIGN or name in _HTML_IN_FOREIGN:
            if not empty:
                opened.setdefault(name, []).append(len(out) - 1)
        elif name in _RAW and not (foreign and empty):
            low = low or source.lower()
            low = low if len(low) == end else _ascii_lower(source)
            stop = _end_tag(low, name, at)
            if foreign:
                ends = [x for x in (stop, *(_end_tag(low, f, at) for f in _FOREIGN if opened.get(f))) if x >= 0]
                stop = min(ends, default=at)
            at = end if stop < 0 else stop
            hide(len(out) - 1, at)
    return out


def _end_tag(low: str, name: str, at: int) -> int:
    """Where the next end tag of the name begins, or -1."""
    stop = low.find("</" + name, at)
    while stop >= 0 and (after := low[stop + 2 + len(name) : stop + 3 + len(name)]) and after not in " \t\n\f\r/>":
        stop = low.find("</" + name, stop + 2)
    return stop


def _ascii_lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


class TreeModel:
    """Log tables: ``emit[feature]`` and ``unseen[kind]`` for (no content, content), ``root`` and ``step[parent state][state]``."""

    def __init__(self, pages: list[Page]):
        kinds: dict[str, set] = {}
        counts: dict[str, np.ndarray] = {}
        root, step = np.ones(2), np.ones((2, 2))
        for page in pages:
            for parent, features, label in zip(page.parent, page.features, page.label, strict=True):
                if parent < 0:
                    root[label] += 1
                else:
                    step[page.label[parent], label] += 1
                for f in features:
                    kinds.setdefault(f[0], set()).add(f)
                    counts.setdefault(f, np.ones(2))[label] += 1
        total = {k: sum(counts[f] for f in fs) for k, fs in kinds.items()}
        self.emit = {f: tuple(np.log(c / total[f[0]])) for f, c in counts.items()}
        self.root, self.step = np.log(root / root.sum()), np.log(step / step.sum(1, keepdims=True))

    def marginals(self, page: Page) -> list[float]:
        """Probability of content of each node, by one pass of messages upward and one downward. Features not seen in training say nothing."""
        n, emit = len(page.parent), self.emit
        (s00, s01), (s10, s11) = np.exp(self.step).tolist()
        # ratios content : none; messages stay finite as logs of ratios
        own = [0.0] * n
        for v, features in enumerate(page.features):
            for f in features:
                if (e := emit.get(f)) is not None:
                    own[v] += e[1] - e[0]
        up = [0.0] * n
        exp, log, parent = math.exp, math.log, page.parent
        for v in range(n - 1, 0, -1):
            r = exp(min(max(own[v], -500.0), 500.0))
            up[v] = log((s10 + s11 * r) / (s00 + s01 * r))
            own[parent[v]] += up[v]
        out = [0.0] * n
        out[0] = own[0] + float(self.root[1] - self.root[0])
        for v in range(1, n):
            r = exp(min(max(out[parent[v]] - up[v], -500.0), 500.0))
            out[v] = own[v] + log((s01 + s11 * r) / (s00 + s10 * r))
        return [1 / (1 + exp(-min(max(x, -500.0), 500.0))) for x in out]

    def text(self, source: str) -> str:
        page = Page(source)
        p = self.marginals(page)
        return "\n".join(t for t, q in zip(page.text, p, strict=True) if t is not None and q >= 0.5)


def labelled_pages(n: int = 400, seed: int = 3) -> list[str]:
    """Pages of ten layouts; paragraphs of 1 to 120 words, menus, notices, adverts, forms, side columns, comments and footers."""
    rng = random.Random(seed)
    stock = "ala bero cinta domu eran fasti golem hira ista jolan kemi luro menta nolis oran pesti quon rela sito tamen uldo vari weno xeri yama zuno".split()

    def words(a: int, z: int) -> str:
        return " ".join(rng.choice(stock) for _ in range(rng.randint(a, z)))

    def sentence(a: int = 3, z: int = 25) -> str:
        return words(a, z).capitalize() + rng.choice([".", ".", ".", "!", "?", "", ","])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))

    def paragraphs() -> str:
        out = [f"<h{rng.choice('112')}>{words(1, 12)}</h1>" if rng.random() < 0.3 else f"<h1>{words(1, 12)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 12)):
            body = " ".join(sentence(1, 25) for _ in range(rng.choice([1, 1, 1, 2, 4, 6])))
            kind = rng.random()
            out.append(
                f"<p>{body}</p>" if kind < 0.6 else f"<p><b>{body}<br>" if kind < 0.7 else f"<ul><li>{sentence()}</li><li>{words(1, 4)}</li></ul>" if kind < 0.76
                else f"<blockquote><p>{body}</p></blockquote>" if kind < 0.8 else f'<p>{body} <a href="/x">{words(1, 3)}</a> {sentence()}</p>' if kind < 0.88 else f"<h2>{words(1, 5)}</h2>" if kind < 0.93
                else f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 4)}</td></tr></table>" if kind < 0.96 else f"<pre>{words(2, 9)}</pre>" if kind < 0.98 else f"<div>{body}</div>"
            )
        return "".join(out)

    def noise(*names: str) -> str:
        name = rng.choice(names)
        inner = rng.choice([lambda: f"<p>{sentence(1, 14)}</p>", lambda: sentence(2, 20), lambda: f"<ul>{links(rng.randint(1, 6))}</ul>", lambda: f"<h3>{words(1, 3)}</h3><p>{sentence()}</p>", lambda: f'<p>{sentence()} <a href="/y">{words(1, 2)}</a></p>'])()
        attr = rng.choice(["class", "class", "id"])
        return f'<div {attr}="{name}">{inner}</div>'

    def comments() -> str:
        box = rng.choice(["section", "div"])
        each = "".join(f'<div class="{rng.choice(["comment", "comment-body", "reply"])}"><p>{sentence(2, 30)}</p></div>' for _ in range(rng.randint(1, 5)))
        return f'<{box} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "responses", "discussion", "user-comments"])}" data-noise><h3>{words(1, 2)}</h3>{each}</{box}>'

    def form() -> str:
        return f'<form data-noise><label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button><p>{sentence(2, 9)}</p></form>'

    def inside() -> str:
        pick = rng.random()
        return (
            comments() if pick < 0.25 else form() if pick < 0.4 else f"<aside data-noise><p>{sentence()}</p></aside>" if pick < 0.55
            else noise("ad", "advert", "share", "related", "newsletter", "promo", "social").replace("<div ", "<div data-noise ", 1) if pick < 0.8 else f"<footer data-noise>{sentence(1, 8)}</footer>" if pick < 0.9 else f"<nav data-noise><ul>{links(3)}</ul></nav>"
        )

    out = []
    for i in range(n):
        before = [f"<nav><ul>{links(rng.randint(2, 9))}</ul></nav>"] if rng.random() < 0.7 else []
        before += [f"<header><h1>{words(1, 4)}</h1><p>{sentence(1, 8)}</p></header>"] if rng.random() < 0.4 else []
        before += [noise("ad", "ads", "advert", "banner", "sponsor", "cookie-notice", "cookie consent", "notice", "menu", "topbar", "breadcrumb", "header", "alert", "popup") for _ in range(rng.randint(0, 3))]
        after = [noise("sidebar", "side", "widget", "related", "ad", "newsletter", "subscribe", "share social", "tags", "pagination", "promo", "login") for _ in range(rng.randint(0, 3))]
        after += [f'<aside class="{rng.choice(["sidebar", "widget", ""])}"><h3>{words(1, 3)}</h3><p>{sentence()}</p></aside>'] if rng.random() < 0.4 else []
        after += [comments()] if rng.random() < 0.3 else []
        after += [form()] if rng.random() < 0.3 else []
        after += [f"<footer>&copy; {words(1, 3)} &middot; {sentence(1, 14)}</footer>"] if rng.random() < 0.6 else [noise("footer", "copyright", "legal")]
        if rng.random() < 0.3:
            rng.shuffle(before)
        body = paragraphs() + (inside() if rng.random() < 0.3 else "") + (paragraphs() if rng.random() < 0.2 else "")
        names = ["content", "main-content", "post", "post-body", "entry-content", "article-body", "story", "text", "page-content", "article"]
        main = [
            f"<article data-main>{body}</article>", f"<main data-main>{body}</main>", f"<main><article data-main>{body}</article></main>", f'<div class="{rng.choice(names)}" data-main>{body}</div>',
            f'<div id="{rng.choice(names)}" data-main>{body}</div>', f'<section class="{rng.choice(names)}" data-main>{body}</section>', f'<div class="wrapper"><article class="{rng.choice(names)}" data-main>{body}</article></div>',
            f'<div role="main" data-main>{body}</div>', f"<article data-main><div>{body}</div></article>", f"<article data-main>{body}</article>",
        ][i % 10]
        out.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>")
    return out


@lru_cache(maxsize=1)
def trained() -> TreeModel:
    return TreeModel([Page(p, marks=True) for p in labelled_pages()])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """(id, url, text, n_chars) of every row and whole page: the content blocks in page order, joined by one line feed.

    Character references are decoded; white space inside a block, line breaks included, is one space; a null or empty page, and
    one without content, has an empty text. n_chars are code points.
    """
    table = pages.sparkSession.sparkContext.broadcast(model or trained())
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("_html"))
    kinds = dict(rows.dtypes)

    def run(batches):
        for b in batches:
            text = [table.value.text(x) if x else "" for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint")
