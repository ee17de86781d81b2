"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of its block elements; inline elements belong to their block.  Each node has features of its subtree
(length and density of text and links, tags, punctuation), of the tokens of its class, id and role and of its ancestors',
of depth, and of its siblings.  Boosted oblivious trees give each node a probability of holding main text.  Decoding picks the most
probable labelling in which nothing is kept inside a dropped node.

The trees are fitted on pages that training_pages() makes from templates of many layouts with random words, as no labelled pages
exist; the fit is deterministic and takes a few seconds on the driver.

Defined cases: null and empty html give the empty text; broken markup is read as far as it goes (an element without end tag
ends with its parent, an open head at the first tag or text of the body, script and the like at the end of the page; "<" that
starts no tag is text); reading takes time in proportion to the page; repeated rows and ties do not matter; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, table

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose text is no markup, up to their end tag or the page's end; in DROPPED ones markup counts and text does not.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
DROPPED = frozenset("button select template noscript svg canvas audio video object".split())
IN_HEAD = frozenset("title meta link style script base noscript template".split())
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW | DROPPED}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body div p section article main nav header footer aside ul ol li dl dt dd table tbody thead tfoot tr td th caption h1 h2 h3 h4 h5 h6 form fieldset legend blockquote pre figure figcaption address details summary dialog menu center hr".split())
#: An open element of the second kind ends where one of the first kind starts.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody"), "option": ("option",)}
#: An implied end tag reaches no further out than these.
_SCOPE = ("ul", "ol", "dl", "table", "menu", "div", "section", "article")
TAG_GROUPS = (("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd"), ("ul", "ol", "dl", "menu"), ("div", "center"), ("article", "main"), ("section",), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "legend", "dialog"), ("table", "tbody", "thead", "tr", "td", "th", "tfoot", "caption"), ("blockquote", "pre"), ("figure", "figcaption"), ("address", "details", "summary"), ("body", "html"))
_GROUP = {t: k for k, ts in enumerate(TAG_GROUPS) for t in ts}
TOKENS = (
    ("nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "topbar", "tabs", "skip", "links", "toolbar"),
    ("ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "dfp", "adslot", "advertising", "affiliate"),
    ("header", "footer", "masthead", "copyright", "legal", "colophon", "foot", "top", "bottom", "imprint", "credits"),
    ("comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "reader", "readers", "responses", "guestbook"),
    ("cookie", "cookies", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "disclaimer", "warning", "message", "toast", "privacy", "announcement", "paywall"),
    ("form", "login", "signin", "signup", "subscribe", "subscription", "newsletter", "search", "register", "contact", "survey", "poll"),
    ("sidebar", "side", "aside", "related", "recommended", "widget", "share", "sharing", "social", "popular", "trending", "more", "tags", "rail", "recent", "teaser", "outbrain", "taboola", "bio", "meta", "byline"),
    ("article", "content", "post", "entry", "story", "main", "body", "text", "articlebody", "maincontent", "prose", "page", "blog", "news"),
)
_KIND = {t: k for k, ts in enumerate(TOKENS) for t in ts}


class Page:
    """Block nodes in page order: tag, token kinds, parent, and own text pieces as (order, text, in a link)."""

    def __init__(self, html: str | None):
        self.tags, self.kinds, self.parents, self.own = ["html"], [0], [-1], [[]]
        self._read(html or "")

    def _read(self, html: str) -> None:
        """One pass over the markup; for each open element's tag its places on the stack are kept, so nothing is searched for."""
        stack = [("html", 0)]  # open elements, inline ones with their block's node
        places: dict[str, list[int]] = defaultdict(list)  # of open elements but the root
        blocks: list[int] = []
        links, dropped, at, order, head = 0, 0, 0, 0, False
        end = html.rfind(">") + 1  # no tag ends behind it

        def close(place: int) -> None:
            nonlocal links, dropped
            while len(stack) > place:
                tag, _ = stack.pop()
                places[tag].pop()
                links -= tag == "a"
                dropped -= tag in DROPPED
                if tag in BLOCKS:
                    blocks.pop()

        def put(text: str, linked: bool = False) -> None:
            nonlocal order
            self.own[stack[-1][1]].append((order, text, linked))
            order += 1

        last = {}  # where the last end tag of an element with text of no use is

        def ends(tag: str) -> int:
            if tag not in last:
                last[tag] = max((m.start() for m in _END[tag].finditer(html)), default=-1)
            return last[tag]

        while True:
            m = _MARKUP.search(html, at, end)
            text = html[at : m.start()] if m else html[at:].partition("<!--")[0]
            if text:
                head = head and text.isspace()
                if not dropped and not head:
                    put(unescape(text) if "&" in text else text, links > 0)
            if not m or m[0].startswith("<!--") and not m[0].endswith("-->"):
                return
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing, attributes = name.lower(), m[1] or m[4], m[3] if m[2] else m[6]
            block = tag in BLOCKS
            if closing:
                if tag == "head":
                    head = False
                if tag == "p" and not places["p"]:
                    continue
                if places[tag] and (block or not blocks or places[tag][-1] > blocks[-1]):
                    close(places[tag][-1])
                if block:
                    put(" ")
                continue
            if tag == "head":
                head = True
                continue
            head = head and tag in IN_HEAD
            if tag in RAW and not attributes.endswith("/"):
                found = _END[tag].search(html, at) if ends(tag) >= at else None
                at = found.end() if found else len(html)
                continue
            if tag in VOID:
                if tag in {"br", "hr"}:
                    put(" ")
                continue
            if not block:
                if not attributes.endswith("/"):
                    if tag in DROPPED:
                        if ends(tag) < at:
                            continue  # no end tag follows: what comes next is not within it
                        if places[tag] and (not blocks or places[tag][-1] > blocks[-1]):
                            close(places[tag][-1])
                        dropped += 1
                    places[tag].append(len(stack))
                    stack.append((tag, stack[-1][1]))
                    links += tag == "a"
                continue
            if tag in {"html", "body"} and places[tag]:
                continue
            if tag not in {"tr", "td", "th", "tbody", "thead", "li", "dt", "dd"} and blocks and stack[blocks[-1]][0] == "p":
                close(blocks[-1])
            if tag in _CLOSES:
                open_ = max((places[t][-1] for t in _CLOSES[tag] if places[t]), default=-1)
                if open_ > max((places[t][-1] for t in _SCOPE if places[t]), default=0):
                    close(open_)
            kinds = 0
            if attributes:
                for a in _ATTRIBUTE.findall(attributes):
                    for token in _TOKEN.findall(" ".join(a)):
                        k = _KIND.get(token.lower())
                        kinds |= 0 if k is None else 1 << k
                kinds |= 1 << len(TOKENS) if _HIDDEN.search(attributes) else 0
            parent = stack[-1][1]
            put(" ")
            self.tags.append(tag)
            self.kinds.append(kinds)
            self.parents.append(parent)
            self.own.append([(order, " ", False)])
            order += 1
            blocks.append(len(stack))
            places[tag].append(len(stack))
            stack.append((tag, len(self.tags) - 1))

    def text(self, kept: list[bool]) -> str:
        pieces = [p for own, keep in zip(self.own, kept, strict=True) if keep for p in own]
        pieces.sort()
        return " ".join("".join(p[1] for p in pieces).split())


N_KINDS = len(TOKENS) + 1


def node_features(page: Page) -> np.ndarray:
    """One row of features for each node."""
    n = len(page.tags)
    parents = page.parents
    own = [sum(len(x[1].strip()) for x in o) for o in page.own]
    linked = [sum(len(x[1]) for x in o if x[2]) for o in page.own]
    points = [sum(x[1].count(".") + x[1].count(",") for x in o) for o in page.own]
    text, link, point, nodes, paragraphs, longest, inside = own[:], linked[:], points[:], [1] * n, [float(t == "p") for t in page.tags], own[:], page.kinds[:]
    depth, above, groups, children = [0] * n, [0] * n, [0] * n, [0] * n
    for k in range(n - 1, 0, -1):
        p = parents[k]
        text[p] += text[k]
        link[p] += link[k]
        point[p] += point[k]
        nodes[p] += nodes[k]
        paragraphs[p] += paragraphs[k]
        inside[p] |= inside[k]
        children[p] += 1
        if longest[k] > longest[p]:
            longest[p] = longest[k]
    before, seen = [0] * n, 0
    for k in range(n):
        before[k] = seen
        seen += own[k]
        if k:
            p = parents[k]
            depth[k] = depth[p] + 1
            above[k] = above[p] | page.kinds[p]
            groups[k] = groups[p] | 1 << _GROUP.get(page.tags[p], 5)
    total = max(1, text[0])
    previous, following, last = [0] * n, [0] * n, {}
    same: dict[tuple[int, str], int] = {}
    for k in range(1, n):
        p = parents[k]
        same[p, page.tags[k]] = same.get((p, page.tags[k]), 0) + 1
        if p in last:
            previous[k] = text[last[p]]
            following[last[p]] = text[k]
        last[p] = k
    a = lambda x: np.array(x, dtype=np.float64)
    t, o = a(text), a(own)
    up = a([text[max(0, p)] for p in parents])
    out = [np.log1p(t), np.log1p(o), a(link) / (t + 1), np.log1p(a(link)), a(point) / (t + 1), np.log1p(a(point)), np.log1p(a(nodes)), t / a(nodes), np.log1p(a(longest)), a(paragraphs) / a(nodes), np.log1p(a(paragraphs)), a(depth), t / total, (a(before) + t / 2) / total, t / (up + 1), np.log1p(a(previous)), np.log1p(a(following)), np.log1p(a([same.get((p, g), 0) for p, g in zip(parents, page.tags, strict=True)])), np.log1p(a(children)), np.log1p(a([children[max(0, p)] for p in parents]))]
    masks = np.array([page.kinds, above, inside, groups, [1 << _GROUP.get(g, 5) for g in page.tags]], dtype=np.int64)
    sizes = (N_KINDS, N_KINDS, N_KINDS, len(TAG_GROUPS), len(TAG_GROUPS))
    for mask, size in zip(masks, sizes, strict=True):
        out += [((mask >> k) & 1).astype(np.float64) for k in range(size)]
    return np.stack(out, axis=1)


class Trees:
    """Boosted oblivious trees: at each level of a tree all rows meet the same split; a leaf's number is the splits' answers."""

    def __init__(self, base: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.base, self.trees = base, trees

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for features, cuts, leaves in self.trees:
            out += leaves[((x[:, features] > cuts) << np.arange(len(cuts))).sum(axis=1)]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray, count: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 2.0) -> "Trees":
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        cuts = [c[c < col.max()] for c, col in zip(cuts, x.T, strict=True)]
        binned = [np.searchsorted(c, col, side="left").astype(np.int64) for c, col in zip(cuts, x.T, strict=True)]  # > cut k when bin > k
        share = float(np.average(y, weights=w))
        score = np.full(len(x), np.log(share / (1 - share)))
        model = cls(float(score[0]), [])
        for _ in range(count):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (y - p), w * p * (1 - p)
            leaf, chosen = np.zeros(len(x), dtype=np.int64), []
            for level in range(depth):
                best = (-1.0, 0, 0)
                for f, b in enumerate(binned):
                    size = cuts[f].size + 1
                    if size == 1:
                        continue
                    key = leaf * size + b
                    sums = [np.bincount(key, weights=v, minlength=size << level).reshape(-1, size).cumsum(axis=1) for v in (g, h)]
                    (gl, hl), (gt, ht) = [s[:, :-1] for s in sums], [s[:, -1:] for s in sums]
                    gain = (gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge)).sum(axis=0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
                _, f, k = best
                chosen.append((f, cuts[f][k]))
                leaf |= (binned[f] > k).astype(np.int64) << level
            gs, hs = (np.bincount(leaf, weights=v, minlength=1 << depth) for v in (g, h))
            leaves = rate * gs / (hs + ridge)
            score += leaves[leaf]
            model.trees.append((np.array([f for f, _ in chosen]), np.array([c for _, c in chosen]), leaves))
        return model


def decode(parents: list[int], score: np.ndarray) -> list[bool]:
    """The most probable labels in which a kept node's parent is kept. score: log odds of holding main text."""
    n = len(parents)
    keep = (-np.logaddexp(0, -score)).tolist()
    drop = (-np.logaddexp(0, score)).tolist()
    best = keep[:]  # of the subtree if its node is kept
    none = drop[:]  # of the subtree dropped whole
    for k in range(n - 1, 0, -1):
        p = parents[k]
        best[p] += max(best[k], none[k])
        none[p] += none[k]
    kept = [False] * n
    for k in range(n):
        kept[k] = (k == 0 or kept[parents[k]]) and best[k] > none[k]
    return kept


# Training pages -------------------------------------------------------------------------------------------------------------

_SYLLABLES = "ka lo mi ne ru ta vel dor en is ura pho gra tem bi son lar que ix am oth ei".split()


def _words(r: random.Random, low: int, high: int, ends: bool = True) -> str:
    words = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
    if ends:
        words = [w + ("." if r.random() < 0.08 else "," if r.random() < 0.08 else "") for w in words]
        words[-1] = words[-1].rstrip(".,") + "."
    return " ".join(words).capitalize()


def _tagged(r: random.Random, tag: str, inner: str, names: list[str], hint: float = 0.8) -> str:
    if r.random() > hint or not names:
        return f"<{tag}>{inner}</{tag}>"
    name = r.choice(names)
    return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">{inner}</{tag}>'


def _links(r: random.Random, low: int, high: int) -> str:
    items = [f'<a href="#">{_words(r, 1, 4, False)}</a>' for _ in range(r.randint(low, high))]
    style = r.random()
    return f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>" if style < 0.6 else r.choice([" | ", " ", " &middot; "]).join(items) if style < 0.85 else "".join(f"<div>{i}</div>" for i in items)


def _junk(r: random.Random, kind: str) -> str:
    text = lambda a=3, b=25: _words(r, a, b)
    hint = 1.0 if r.random() < 0.8 else 0.4
    if kind == "nav":
        return _tagged(r, r.choice(["nav", "nav", "div", "ul"]), _links(r, 3, 12), ["nav", "main-nav", "menu", "navbar", "topmenu", "breadcrumbs"], hint)
    if kind == "header":
        return _tagged(r, r.choice(["header", "header", "div"]), r.choice([f"<h1>{text(1, 4)}</h1>", f"<a href='/'>{text(1, 3)}</a>", f"<p>{text(2, 10)}</p>", f"<div>{text(1, 4)}</div>{_links(r, 2, 6)}"]), ["header", "site-header", "masthead", "page-top"], hint)
    if kind == "footer":
        return _tagged(r, r.choice(["footer", "footer", "div"]), r.choice([f"&copy; {text(1, 12)}", f"&copy; {text(1, 2)} &middot; {text(2, 15)}", f"&copy; {text(1, 2)} &middot; {text(2, 15)}", f"<p>&copy; 2020 {text(2, 30)}</p>", f"{_links(r, 2, 8)}<p>{text(3, 20)}</p>", text(3, 25)]), ["footer", "site-footer", "colophon", "page-footer"], hint)
    if kind == "ad":
        return _tagged(r, r.choice(["div", "div", "aside", "section"]), r.choice([text(3, 25), f"<p>{text(3, 30)}</p>", f'<a href="#">{text(2, 12)}</a>', f"<h3>{text(2, 5)}</h3><p>{text(5, 25)}</p>"]), ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner", "advertisement"], 1.0)
    if kind == "aside":
        return _tagged(r, r.choice(["aside", "aside", "div"]), r.choice([f"<h3>{text(1, 4)}</h3>{_links(r, 3, 8)}", f"<p>{text(5, 40)}</p>", f"<h4>{text(1, 4)}</h4><p>{text(5, 40)}</p>", _links(r, 3, 10), text(3, 20)]), ["sidebar", "related", "widget", "recommended", "side-bar", "share", "social", "popular-posts"], hint)
    if kind == "notice":
        return _tagged(r, r.choice(["div", "div", "section", "p"]), r.choice([text(5, 30), f"{text(5, 25)} <button>{text(1, 2)}</button>"] if r.random() < 0.5 else [f"<span>{text(5, 30)}</span>"]), ["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr-banner", "popup", "privacy-notice"], 1.0)
    if kind == "form":
        return _tagged(r, r.choice(["form", "form", "div"]), f"<label>{text(1, 5)}</label><input name='q'><button>{text(1, 2)}</button>" if r.random() < 0.6 else f"<p>{text(3, 15)}</p><input type='email'><label>{text(1, 6)}</label>", ["search", "newsletter", "subscribe", "login-form", "signup", "contact-form"], hint if r.random() < 0.5 else 1.0)
    each = r.choice(["div", "li", "article", "p", "section"])
    items = "".join(_tagged(r, each, (f"<b>{text(1, 2)}</b> " if r.random() < 0.5 else "") + (f"<p>{text(4, 50)}</p>" if each != "p" and r.random() < 0.6 else text(4, 50)), ["comment", "comment-body", "reply"], 0.7) for _ in range(r.randint(1, 7)))
    head = f"<h3>{text(1, 3)}</h3>" if r.random() < 0.6 else ""
    return _tagged(r, "ol" if each == "li" else r.choice(["section", "div", "div", "aside"]), head + items, ["comments", "comment-list", "discussion", "responses", "reader-comments"], 1.0)


def _body(r: random.Random, junk: bool) -> str:
    """Blocks of an article; main text is between marks."""
    mark = lambda s: f"\x01{s}\x02"
    inline = lambda s: s if r.random() < 0.7 else f"{s} <a href='#'>{_words(r, 1, 3)}</a> {_words(r, 2, 12)}" if r.random() < 0.5 else f"<b>{s}</b>"
    out = []
    for _ in range(r.choice([1, 1, 1, 2, 2, 3, 4, 6, 9, 14])):
        kind = r.random()
        size = r.choice([(1, 6), (5, 30), (20, 90), (40, 160)])
        if kind < 0.74:
            out.append(f"<p>{mark(inline(_words(r, *size)))}" + ("</p>" if r.random() < 0.9 else ""))
        elif kind < 0.82:
            out.append(f"<h2>{mark(_words(r, 1, 8, False))}</h2>")
        elif kind < 0.88:
            out.append("<ul>" + "".join(f"<li>{mark(inline(_words(r, 2, 20)))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif kind < 0.92:
            out.append(f"<blockquote>{mark(_words(r, 5, 40))}</blockquote>")
        elif kind < 0.95:
            out.append("<table>" + "".join(f"<tr><td>{mark(_words(r, 1, 4))}</td><td>{mark(_words(r, 1, 5))}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>")
        elif kind < 0.97:
            out.append(f"<pre>{mark(_words(r, 3, 25))}</pre>")
        else:
            out.append(f"<div>{mark(inline(_words(r, *size)))}</div>")
    if junk:
        for kind in r.sample(["ad", "aside", "notice", "form", "nav"], r.randint(0, 2)):
            out.insert(r.randint(0, len(out)), _junk(r, kind))
    return "".join(out)


def training_pages(count: int, seed: int = 11) -> list[str]:
    """Pages whose main text stands between \\x01 and \\x02."""
    r, pages = random.Random(seed), []
    for _ in range(count):
        title = f"<h1>\x01{_words(r, 2, 14)}\x02</h1>" if r.random() < 0.85 else ""
        if r.random() < 0.15:
            title = f"<header>{title}</header>" if title else ""
        main = _tagged(r, r.choice(["article", "article", "article", "main", "div", "section"]), title + _body(r, r.random() < 0.4), ["article", "content", "post", "entry-content", "story", "main-content", "post-body"], 0.5)
        if not main.startswith(("<article", "<main")) and " " not in main.split(">", 1)[0]:
            main = f'<div class="{r.choice(["content", "post", "article-body", "story"])}">{main}</div>'
        if r.random() < 0.3:
            main = _tagged(r, r.choice(["div", "main", "section"]), main + (_junk(r, "aside") if r.random() < 0.4 else ""), ["wrapper", "container", "page", "layout", "main"], 0.7)
        above = [_junk(r, k) for k in ("notice", "header", "nav", "ad", "form", "aside") if r.random() < 0.45]
        below = [_junk(r, k) for k in ("comments", "aside", "form", "ad", "nav", "footer", "notice") if r.random() < 0.42]
        r.shuffle(above)
        inner = "".join(above) + main + "".join(below)
        if r.random() < 0.25:
            inner = _tagged(r, "div", inner, ["wrapper", "page", "container", "site"], 0.8)
        pages.append(f"<html><head><title>x</title></head><body>{inner}</body></html>")
    return pages


@lru_cache(maxsize=2)
def trained(pages: int = 1000) -> Trees:
    """Trees fitted on training pages: a node is positive if its subtree holds main text."""
    xs, ys = [], []
    for html in training_pages(pages):
        page = Page(html)
        main, inside = [False] * len(page.tags), False
        for _, piece, k in sorted((x[0], x[1], k) for k, own in enumerate(page.own) for x in own):
            main[k] |= inside or "\x01" in piece
            inside = (inside or "\x01" in piece) and not piece.rfind("\x02") > piece.rfind("\x01")
        for k in range(len(main) - 1, 0, -1):
            main[page.parents[k]] |= main[k]
        for own in page.own:
            own[:] = [(o, t.replace("\x01", "").replace("\x02", ""), link) for o, t, link in own]
        xs.append(node_features(page))
        ys.append(np.array(main, dtype=np.float64))
    x, y = np.vstack(xs), np.concatenate(ys)
    return Trees.fit(x, y, np.ones(len(y)))


def extract(htmls: list[str | None], model: Trees) -> list[str]:
    pages = [Page(h) for h in htmls]
    rows = [node_features(p) for p in pages]
    score = model(np.vstack(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for page, row in zip(pages, rows, strict=True):
        out.append(page.text(decode(page.parents, score[at : at + len(row)])))
        at += len(row)
    return out


TEXT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and main text of each row of pages (page_id, url, html)."""
    model = trained()

    def make():
        return lambda rows: {"page_id": rows["page_id"], "url": rows["url"], "text": extract(rows["html"], model)}

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), make, TEXT)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
