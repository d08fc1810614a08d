"""Operator 4 - main text of web pages by boosted trees over DOM nodes.

A tolerant parser makes a tree of block elements from the whole page; inline
elements belong to their block.  As in the HTML standard, what may not stand in a
head ends it and opens the body, which ends with the page; script, style, title,
textarea and iframe without an end tag go on to the end of the page.  Elements of
``_DROP`` (controls, media, templates) go with their content if they have an end
tag; without one only the tag itself goes.  Every block node has features: tag, depth,
subtree text, link and tag density, tokens of its class, id and role and of those
above it (whole words, or run-together names by the stem at either end), words of
share bars, counts and statistics of its siblings, siblings of equal names.  Gradient-boosted trees give
the odds that the node's subtree holds main text.  They are trained here, on
pages made by a fixed generator of many layouts; the trees are kept in
``html_trees.json`` (``write_trees``).  Decoding is hierarchical: the
most likely labelling in which nothing below a rejected node is kept, found
exactly by one pass from the leaves (a node is rejected with its whole subtree or
kept with the best choice for each child).

The text of kept nodes is decoded (character references), white space becomes
one space, blocks are joined in page order by one space.

Scale: a map over Arrow batches without shuffle, linear in the page; the model
is a few thousand numbers in the task closure.

Defined results: a null or empty html, and a page without main text, give an
empty string; repeated rows get equal results; a null page_id is allowed; empty
tables give empty results; other columns are ignored.  Very long pages are read
whole.  A node whose two best labellings are equally likely (a tie) is rejected.
"""

from __future__ import annotations

import functools
import html as html_lib
import json
import pathlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .gbt import BoostedTrees

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_TOKEN = re.compile(r"[a-z]+")
_RAW = {"script", "style", "title", "textarea", "iframe"}  # their content is text up to the end tag
_DROP = {"noscript", "template", "svg", "math", "select", "button", "object", "canvas", "audio", "video"}
_FLAT = {"select", "button"}  # a second start tag ends the first
_DROP_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<({"|".join(sorted(_RAW))})(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)|<(/?)({"|".join(sorted(_DROP))})(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", re.S | re.I)
_IN_HEAD = {"html", "head", "body", "base", "link", "meta", "noscript", "template", *_RAW} - {"textarea", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th",
    "blockquote", "pre", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "fieldset", "address", "details", "summary", "dialog", "menu", "hgroup", "center", "caption", "search", "head",
}
#: A start tag of the key closes an open element of the values that stands above it (up to a stop).
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "body": set()}
_AGAINST = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion sidebar side rail menu nav navigation navbar breadcrumb breadcrumbs crumbs footer foot header masthead top cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments reply replies respond discussion disqus share sharing social follow related recommended more trending popular widget subscribe subscription newsletter signup login search form pagination pager tags meta toolbar tool skip bottom colophon copyright legal contentinfo complementary hidden".split()
)
#: Names of the page's furniture that are also found joined to others (``commentlist``, ``sitefooter``).
_STEMS = ("comment", "sidebar", "footer", "header", "navbar", "cookie", "banner", "widget", "newsletter", "subscribe", "related", "share", "sharing", "social", "advert", "sponsor", "breadcrumb", "menu", "popup", "copyright", "pagination")
_SOCIAL = re.compile(r"\b(?:share|tweet|retweet|follow us|facebook|twitter|whatsapp|pinterest|linkedin|reddit|instagram|telegram)\b", re.I)
_FOR = frozenset("article content main post entry story body text blog page prose single detail".split())
#: Words that make a name speak of the page's state (``has-sidebar``, ``comments-open``), not of the element.
_STATE = frozenset("with has no not without free open closed off accepted enabled disabled".split())
_TAG_GROUPS = (("nav", "menu"), ("header", "hgroup"), ("footer",), ("aside",), ("form", "fieldset", "dialog", "search"), ("article",), ("main",), ("section",), ("div", "center"), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "thead", "tbody", "tr"), ("td", "th"), ("blockquote", "pre", "figure", "figcaption"), ("body", "html"), ("address", "details", "summary"))
_GROUP = {t: i for i, g in enumerate(_TAG_GROUPS) for t in g}
N_FEATURES = 31 + len(_TAG_GROUPS)


def _drop_ends(s: str) -> dict[int, int]:
    """Start of every element of ``_DROP`` that has an end tag -> end of that tag."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {name: [] for name in _DROP}
    for m in _DROP_TAG.finditer(s):
        if not m[3]:
            continue
        name = m[3].lower()
        starts = opened[name]
        if m[2]:
            if starts:
                ends[starts.pop()] = m.end()
        elif name not in ("svg", "math") or s[m.end() - 2] != "/":
            if name in _FLAT:
                starts.clear()
            starts.append(m.start())
    return ends


@functools.lru_cache(maxsize=4096)
def _named(name: str) -> tuple[int, int]:
    """Tokens of one class name or id that speak for main text and against it."""
    tokens = _TOKEN.findall(name)
    against = 0 if _STATE.intersection(tokens) else sum(t in _AGAINST or (t.startswith(_STEMS) or t.endswith(_STEMS)) and not t.startswith("commentar") for t in tokens)
    return sum(t in _FOR for t in tokens), against


class Page:
    """Block nodes in page order (parents first) and text pieces."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.attrs, self.hidden = ["html"], [-1], [0], [""], [False]
        self.pieces: list[tuple[int, str, bool]] = []  # (node, decoded text, inside a link); text " " marks a break
        self.inputs = [0]
        self._parse(source)

    def _parse(self, s: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements with the block node they belong to
        links, at, n, in_body, ends = 0, 0, len(s), False, None
        pieces, unescape = self.pieces, html_lib.unescape

        def open_body() -> None:
            del stack[1:]
            stack.append(("body", self._node("body", 0)))

        for m in iter(lambda: _TAG.search(s, at), None):
            if m.start() > at:
                raw = s[at : m.start()]
                if not in_body and not raw.isspace():
                    open_body()
                    in_body, links = True, 0
                pieces.append((stack[-1][1], unescape(raw) if "&" in raw else raw, links > 0))
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            closing = (m[1] or m[4]) == "/"
            if closing:
                if name == "br":
                    pieces.append((stack[-1][1], " ", False))
                if name in ("body", "html"):  # what follows still belongs to the body
                    continue
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        if name in _BLOCK:
                            pieces.append((stack[i][1], " ", False))
                        links -= sum(e[0] == "a" for e in stack[i:])
                        del stack[i:]
                        break
                    if stack[i][0] in _BLOCK and name not in _BLOCK:
                        break
                continue
            attrs = m[3] if m[2] else m[6]
            if not in_body and name not in _IN_HEAD:
                open_body()
                in_body, links = True, 0
            if name in ("select", "textarea", "button"):
                self.inputs[stack[-1][1]] += 1
            if name in _RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(s, at)
                stop = s.find(">", end.start()) if end else -1
                at = n if stop < 0 else stop + 1
                continue
            if name in _DROP:
                ends = _drop_ends(s) if ends is None else ends
                at = ends.get(m.start(), at)
                if at == m.end() and not (name in ("svg", "math") and (attrs or "").rstrip().endswith("/")):
                    stack.append((name, stack[-1][1]))
                continue
            if name in _VOID:
                if name == "br" or name == "hr":
                    pieces.append((stack[-1][1], " ", False))
                elif name == "input":
                    self.inputs[stack[-1][1]] += 1
                continue
            if name == "html" or (name in ("head", "body") and in_body):
                continue
            in_body = in_body or name == "body"
            if name in _BLOCK:
                for i in range(len(stack) - 1, 0, -1):  # an open paragraph ends where a block begins
                    if stack[i][0] == "p":
                        links -= sum(e[0] == "a" for e in stack[i:])
                        del stack[i:]
                        break
                    if stack[i][0] in _BLOCK:
                        break
                for i in range(len(stack) - 1, 0, -1) if name in _CLOSES else ():
                    if stack[i][0] in _CLOSES[name]:
                        del stack[i:]
                        break
                    if stack[i][0] in _STOPS.get(name, ()):
                        break
                node = self._node(name, stack[-1][1], attrs)
                stack.append((name, node))
            else:
                stack.append((name, stack[-1][1]))
                links += name == "a"
        if at < n:
            raw = s[at:]
            if not re.match(r"</?[a-zA-Z]", raw):
                if not in_body and not raw.isspace():
                    open_body()
                pieces.append((stack[-1][1], unescape(raw), links > 0))

    def _node(self, name: str, parent: int, attrs: str | None = None) -> int:
        """A new block node, after a break."""
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        tokens, hidden = "", False
        if attrs:
            low = attrs.lower()
            tokens = " ".join(v1 or v2 or v3 for k, v1, v2, v3 in _ATTRIBUTE.findall(low) if k in ("class", "id", "role", "aria-label", "itemprop"))
            hidden = "display:none" in low.replace(" ", "") or bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", low))
        self.attrs.append(tokens)
        self.hidden.append(hidden)
        self.inputs.append(0)
        self.pieces.append((node, " ", False))
        return node

    def features(self) -> np.ndarray:
        n = len(self.tag)
        text, link, points, words, marks, social = (np.zeros(n) for _ in range(6))
        for node, piece, linked in self.pieces:
            if piece == " ":
                continue
            k = len(piece) - piece.count(" ")
            text[node] += k
            words[node] += piece.count(" ") + 1 if k else 0
            points[node] += piece.count(".") + piece.count(",")
            if linked:
                link[node] += k
            marks[node] += "\xa9" in piece or "opyright" in piece
            social[node] += len(_SOCIAL.findall(piece))
        parent = np.asarray(self.parent)
        own = text.copy()
        tags, paragraphs, inputs = np.ones(n), np.asarray([t == "p" for t in self.tag], dtype=float), np.asarray(self.inputs, dtype=float)
        stacked = np.stack([text, link, points, words, tags, paragraphs, inputs, marks, social])
        for i in range(n - 1, 0, -1):
            stacked[:, parent[i]] += stacked[:, i]
        text, link, points, words, tags, paragraphs, inputs, marks, social = stacked
        children = np.bincount(parent[1:], minlength=n).astype(float) if n > 1 else np.zeros(n)
        rank, same, twins, top = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        seen: dict = {}
        kinds: dict = {}
        for i in range(1, n):
            p = self.parent[i]
            rank[i] = seen.get(p, 0)
            seen[p] = rank[i] + 1
            for kind in (self.tag[i],), (self.tag[i], self.attrs[i]):
                kinds[p, *kind] = kinds.get((p, *kind), 0) + 1
            top[p] = max(top[p], text[i])
        for i in range(1, n):
            same[i] = kinds[self.parent[i], self.tag[i]]
            twins[i] = kinds[self.parent[i], self.tag[i], self.attrs[i]] if self.attrs[i] else 0
        up = np.maximum(parent, 0)
        good, bad = np.zeros(n), np.zeros(n)
        above_good, above_bad, group, above = np.zeros(n), np.zeros(n), np.full(n, -1), np.zeros((n, 2))
        for i in range(n):
            for name in self.attrs[i].split() if self.tag[i] not in ("html", "body") else ():
                one = _named(name)
                good[i], bad[i] = good[i] + one[0], bad[i] + one[1]
            bad[i] += self.hidden[i]
            group[i] = _GROUP.get(self.tag[i], -1)
            if i:
                p = self.parent[i]
                above_good[i], above_bad[i] = above_good[p] + good[p], above_bad[p] + bad[p]
                above[i] = above[p] + (self.tag[p] in ("article", "main"), self.tag[p] in ("nav", "footer", "header", "aside", "form"))
        total = max(1.0, text[0])
        x = np.zeros((n, N_FEATURES))
        columns = (
            self.depth, np.log1p(text), link / np.maximum(text, 1), np.log1p(text / tags), np.log1p(paragraphs), np.log1p(children), np.log1p(children[up]), np.log1p(same), rank / np.maximum(children[up] - 1, 1),
            text / total, points / np.maximum(words, 1), text / np.maximum(words, 1), good, bad, above_good, above_bad, above[:, 0], above[:, 1], np.log1p(inputs), marks > 0, text / np.maximum(top[up], 1),
            np.log1p((text[up] - text) / np.maximum(children[up] - 1, 1)), own / np.maximum(text, 1), np.asarray(self.hidden), np.log1p(words), good[up] > 0, bad[up] > 0, np.log1p(twins), social / np.maximum(words, 1), good > bad, own[up] / np.maximum(text[up], 1),
        )
        for k, c in enumerate(columns):
            x[:, k] = c
        known = group >= 0
        x[np.flatnonzero(known), len(columns) + group[known]] = 1
        return x

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """Kept nodes of the most likely labelling closed under rejection."""
        n = len(self.tag)
        keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            keep[p] += max(keep[i], drop[i])
            drop[p] += drop[i]
        kept = np.zeros(n, dtype=bool)
        kept[0] = True
        for i in range(1, n):
            kept[i] = kept[self.parent[i]] and keep[i] > drop[i] and self.tag[i] != "head"
        return kept

    def text(self, kept: np.ndarray) -> str:
        return " ".join("".join(piece if kept[node] else " " for node, piece, _ in self.pieces if node).split())


# --- training ---------------------------------------------------------------------

_SENTINEL = "\ue000"


def training_page(rng: np.random.Generator) -> str:
    """One page of a random layout; main text begins with ``_SENTINEL``."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    letters = "abcdefghijklmnoprstuvw\xe9\xf1\xfc"
    word = lambda: "".join(letters[int(i)] for i in rng.integers(len(letters), size=int(rng.integers(2, 11))))

    def sentence(low=4, high=18):
        ws = [word() + ("," if chance(0.08) else "") for _ in range(int(rng.integers(low, high)))]
        return " ".join(ws).capitalize() + pick(".", ".", ".", "!", "?", "!!", "***")

    def attr(*names):
        name = pick(*names)
        return pick("", f' class="{name}"', f' class="{name} {word()}"', f' id="{name}"', f" class='{word()}-{name}'") if name else ""

    def prose(n, main):
        mark = _SENTINEL if main else ""
        out = []
        for _ in range(n):
            t = mark + " ".join(sentence() for _ in range(int(rng.integers(1, 7)))) if chance(0.85) else mark + sentence(1, 4)
            if chance(0.2):
                t = f"<b>{t}"
            if chance(0.1):
                t += f' <a href="/{word()}">{word()}</a> ' + word()
            if chance(0.1):
                t += "<br>" + mark + sentence()
            if main and chance(0.1):
                t += f" {pick('Share', 'Follow us', 'Facebook', 'Twitter', 'Tweet')} {word()}."
            kind = rng.random()
            if main and chance(0.05):
                out.append(f"<h{pick(2, 3, 4)}>{mark}{sentence(1, 4)}</h3><{pick('ul', 'ol')}>" + "".join(f'<li>{pick("", mark + sentence(1, 5))}<a href="/{word()}">{mark}{sentence(1, 9)}</a>{pick("", ", " + word())}</li>' for _ in range(int(rng.integers(2, 7)))) + "</ul></ol>")
            elif kind < 0.8:
                out.append(f"<p>{t}" + ("</p>" if chance(0.85) else ""))
            elif kind < 0.86:
                out.append(f"<blockquote><p>{t}</p></blockquote>")
            elif kind < 0.93:
                out.append("<ul>" + "".join(f"<li>{mark}{sentence(2, 9)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            elif kind < 0.97:
                out.append(f"<h{pick(2, 3)}>{mark}{sentence(2, 7)}</h{pick(2, 3)}><p>{t}</p>")
            else:
                out.append("<table>" + "".join(f"<tr><td>{mark}{word()}</td><td>{mark}{word()}</td></tr>" for _ in range(3)) + "</table>")
        return "".join(out)

    def links(n):
        return "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n)) + "</ul>"

    def boiler():
        kind = int(rng.integers(18))
        n = int(rng.integers(2, 9))
        return (
            lambda: f"<nav{attr('nav', 'menu', '')}>{links(n)}</nav>",
            lambda: f"<div{attr('menu', 'navbar', 'navigation')}>{links(n)}</div>",
            lambda: f'<div class="{pick("ad", "ads", "advert", "banner", "sponsored", "promo")}">{pick("", "<p>")}{" ".join(sentence() for _ in range(int(rng.integers(1, 4))))}</div>',
            lambda: f"<aside{attr('sidebar', 'side', 'widget', '')}><h3>{word()}</h3>{prose(int(rng.integers(1, 4)), False) if chance(0.5) else links(n)}</aside>",
            lambda: f'<div class="{pick("sidebar", "widget", "related", "recommended", "rail")}"><h3>{word()}</h3>{links(n) if chance(0.5) else prose(int(rng.integers(1, 3)), False)}</div>',
            lambda: f'<div class="{pick("cookie", "consent", "notice", "alert", "popup")}"><p>{sentence()} {sentence()}</p><button>{word()}</button></div>',
            lambda: f"<form{attr('search', 'newsletter', 'subscribe', '')}><p>{sentence()}</p><label>{word()}</label><input name=q><button>{word()}</button></form>",
            lambda: f'<section class="{pick("comments", "replies", "discussion")}"><h3>{word()}</h3>' + "".join(f'<div class="{pick("comment", "reply")}"><p>{sentence()} {sentence()}</p></div>' for _ in range(int(rng.integers(1, 5)))) + "</section>",
            lambda: f'<div id="comments">{prose(int(rng.integers(1, 5)), False)}</div>',
            lambda: f'<div class="{pick("share", "social", "tags", "breadcrumb", "pagination")}">{links(n)}</div>',
            lambda: f"<div hidden><p>{sentence()}</p></div>" if chance(0.5) else f'<div style="display:none">{sentence()}</div>',
            lambda: f"<aside>{sentence()} {sentence()}</aside>",
            lambda: f'<div role="{pick("navigation", "complementary", "banner", "search")}">{links(n) if chance(0.6) else sentence()}</div>',
            lambda: f'<{pick("ol", "ul", "div")} {pick("class", "id")}="{pick("comment", "reply", "comments")}{pick("list", "area", "section", "-list", "_thread")}">' + "".join(f'<li class="{pick("comment", "item", "depth")}">{pick("", "<b>" + word() + "</b> ")}<p>{sentence()} {sentence()}</p></li>' for _ in range(int(rng.integers(1, 6)))) + "</ol></ul></div>",
            lambda: f"<{pick('div', 'p')}{attr('share', 'sharebar', 'socials', '', '', '')}>{pick('Share this', 'Share', 'Follow us', 'Share on', word())}{pick(':', '')} " + pick(" ", " | ", "<br>").join(f'<a href="/{word()}">{x}</a>' for x in rng.permutation(["Facebook", "Twitter", "WhatsApp", "Email", "Pinterest", "LinkedIn", "Reddit", "Tweet"])[: int(rng.integers(2, 6))]) + "</div>",
            lambda: f'<div class="{pick("related", "popular", "latest", "more")}{pick("posts", "articles", "stories", "-links")}"><h3>{sentence(1, 4)}</h3>' + "".join(f'<div class="{pick("item", "card", "teaser")}"><a href="/{word()}">{sentence(2, 8)}</a><p>{sentence()}</p></div>' for _ in range(n)) + "</div>",
            lambda: f'<{pick("div", "footer")} class="{pick("post", "entry", "article", "story")}-{pick("footer", "meta", "footer", "tags")}">{sentence(2, 6) if chance(0.6) else links(2)}</div></footer>',
            lambda: f'<div class="{pick("top", "site", "page", "left", "main")}{pick("menu", "navbar", "sidebar", "banner", "header")}">{links(n) if chance(0.7) else sentence()}</div>',
        )[kind]()

    def some(p):
        out = ""
        while chance(p):
            out += boiler()
        return out

    head = f"<!DOCTYPE html><html><head><title>{sentence()}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body{pick('', '', ' class="home sidebar-right"', f' class="{word()} no-menu header-fixed comments-closed"')}>"
    top = pick("", f"<header{attr('header', 'masthead', '')}><h1>{word()}</h1>{links(4)}</header>", f'<div class="{pick("header", "top", "masthead")}"><a href="/">{word()}</a></div>', f"<header>{word()}</header>", f"<header{attr('header', '')}><p>{pick(word(), sentence(2, 8))}</p></header>")
    foot = pick(f"<footer{attr('footer', '')}>&copy; {word()} &middot; {sentence()} {pick('', sentence())}</footer>", f'<div class="{pick("footer", "copyright", "legal")}">Copyright {word()}. {sentence()}</div>', f"<footer><p>{sentence()}</p>{links(5)}</footer>", "", f'<div {pick("class", "id")}="{pick("bottom", "colophon", "sitefooter", "siteinfo", "footer-inner")}">{pick("&copy;", "Copyright", "Copyright &copy;")} {pick("2019", "2021", "2024")} {word()}. {pick("", sentence())}</div>')
    title = f"<h{pick(1, 1, 2)}>{_SENTINEL}{sentence(2, 12)}</h1>" if chance(0.85) else ""
    own_header = bool(title) and chance(0.25)
    size = int(rng.choice([0, 1, 1, 2, 3, 5, 8, 14, 25])) if chance(0.97) else 60
    half = int(rng.integers(size + 1))
    body = title + prose(half, True) + (boiler() if chance(0.15) else "") + prose(size - half, True)
    if own_header:
        kind = pick("header", "header", "div")
        name = pick("", "", "entry-header", "post-header", "article-header", "entry-title-wrap") if kind == "header" else pick("entry-header", "post-header", "article-header", "entry-top")
        body = f"<{kind}" + (f' class="{name}"' if name else "") + f">{title}</{kind}>" + body[len(title) :]
    if not title and not size:
        body = f"<p>{_SENTINEL}{sentence(1, 5)}</p>"
    wrap = int(rng.integers(4 if own_header else 7))
    state = f' class="{pick("content", "article", "post", word())}{pick(" ", "-")}{pick("has-sidebar", "with-sidebar", "no-comments", "ad-free", "with-menu", "comments-open")}"'
    inner = (
        lambda: f"<article>{body}</article>",
        lambda: f"<article{pick(attr('post', 'entry', 'story', ''), state)}>{body}</article>",
        lambda: f"<main{pick('', state)}>{body}</main>",
        lambda: f"<main><article>{body}</article></main>",
        lambda: f'<div class="{pick("content", "main", "post", "article", "entry", "story-body")}">{body}</div>',
        lambda: f'<div id="{pick("content", "main")}"><div class="{pick("post", "text", "entry")}">{body}</div>{some(0.2)}</div>',
        lambda: f"<div><section{pick('', state)}>{body}</section></div>",
    )[wrap]()
    if chance(0.08):  # text that stands in the body itself, between paragraphs or without any
        bare = [_SENTINEL + " ".join(sentence() for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(2, 6)))]
        inner = "".join(f"<p>{t}</p>" if k % 2 else t for k, t in enumerate(bare)) if chance(0.7) else "<br><br>".join(bare)
        top, foot = pick("", "", top), pick("", "", foot)
        if chance(0.6):
            return head + top + inner + foot
    page = top + some(0.6) + inner + some(0.45) + foot
    if chance(0.25):
        page = f'<div class="{pick("wrapper", "container", "page", "site")}">{page}</div>'
    return head + page + ("</body></html>" if chance(0.9) else "")


def training_set(n: int = 1200, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (subtree holds main text) of the nodes of ``n`` pages."""
    rng, xs, ys = np.random.default_rng(seed), [], []
    for _ in range(n):
        page = Page(training_page(rng))
        y = np.zeros(len(page.tag))
        for node, piece, _ in page.pieces:
            if _SENTINEL in piece:
                while node >= 0 and not y[node]:
                    y[node] = 1
                    node = page.parent[node]
        page.pieces = [(k, p.replace(_SENTINEL, ""), a) for k, p, a in page.pieces]
        with_text = page.features()
        use = with_text[:, 1] > 0  # nodes without text decide nothing
        xs.append(with_text[use])
        ys.append(y[use])
    return np.concatenate(xs), np.concatenate(ys)


TREES = pathlib.Path(__file__).with_name("html_trees.json")


def write_trees() -> None:
    """Fit the trees and keep them in ``TREES``."""
    TREES.write_text(json.dumps(BoostedTrees().fit(*training_set()).to_dict() | {"features": N_FEATURES}) + "\n")


@functools.lru_cache(maxsize=1)
def model() -> BoostedTrees:
    """The trees fitted to ``training_set``, as written by ``write_trees``."""
    kept = json.loads(TREES.read_text())
    if kept.pop("features") != N_FEATURES:
        raise ValueError("the written trees are of other features: call write_trees()")
    return BoostedTrees.from_dict(kept)


# --- application -----------------------------------------------------------------


def main_texts(pages: list[str | None], trees: BoostedTrees) -> list[str]:
    """Main text of every page; features of all pages are scored together."""
    parsed = [Page(p) if p else None for p in pages]
    features = [p.features() for p in parsed if p]
    if not features:
        return [""] * len(pages)
    odds, at, out = trees.score(np.concatenate(features)), 0, []
    for p in parsed:
        if p is None:
            out.append("")
            continue
        n = len(p.tag)
        out.append(p.text(p.decode(odds[at : at + n])))
        at += n
    return out


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    trees = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                texts = main_texts(part.column(2).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"]).mapInArrow(run, SCHEMA)


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Contract query: main text of every page."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
