"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, with the
open ancestors.  Features are ancestor tags, word stems in their class, id and role
attributes, the block's own tag, and its text (length, link share, closing punctuation,
place).  The chain has two states, article and other; it is trained by penalised
likelihood (forward-backward, Adam) on labelled pages and decoded by Viterbi.

Labelled pages: the given ones, or ``sample_pages`` made here from templates of
common layouts (``TRAINING_PAGES`` of them: a documented bound), whose words are
random syllables so that nothing depends on a language.

Text: character references decoded, white space in a block (and line breaks) one space,
trimmed; empty blocks dropped; article blocks joined in page order by a newline.
Nothing is cut short.  Scripts, styles, templates, the head and markup never form blocks;
formulas, drawings and fallback content are text of their block.  Open elements are followed at any depth.

Defined cases: a null or empty page has the empty text; a page whose blocks are
all other has the empty text; broken markup closes with its parents; repeated rows
are pages each; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES = 400

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">]++)*+)>|</?[a-zA-Z!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|hidden|style)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
# Their content is no text of the page.
_RAW = {"script", "style", "template", "title", "head"}
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>" if t != "head" else r"</head\b[^>]*>|(?=<body\b)", re.I) for t in _RAW}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
# Elements that run along with the text around them; formulas, drawings and fallback content are text of their block.
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_INLINE |= set("noscript object iframe canvas svg g text tspan desc math semantics annotation mrow mi mn mo mtext ms mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded menclose".split())
_CLOSES_P = set("address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "html"}

# Tags and stems that features are made of.
_TAGS = "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd td th tr table blockquote pre figure figcaption article main section div nav header footer aside form label button select option textarea fieldset legend details summary dialog address body a title menu caption".split()
_STEMS = "advert sponsor promo banner cookie consent gdpr notice alert warning popup modal overlay menu nav breadcrumb crumb sidebar widget related recommend share social follow subscri newsletter signup login search comment reply respond discuss disqus footer copyright legal header masthead logo brand toolbar tag categor author byline meta date pagination pager skip content article post entry main story text body prose".split()
_EXACT = {"ad": "advert", "ads": "advert", "adv": "advert", "dfp": "advert", "top": "header", "bottom": "footer", "foot": "footer", "head": "header", "side": "sidebar", "aside": "sidebar", "search": "search", "contentinfo": "footer", "navigation": "nav", "complementary": "sidebar", "banner": "header", "dialog": "popup"}
_OTHER_FEATURES = [*(f"own:{t}" for t in _TAGS), *(f"words{k}" for k in range(7)), *(f"links{k}" for k in range(4)), "closed", "first", "early", "late", "same_parent", "bar", "copyright", "digits", "hidden", "depth<3", "depth<5", "bias"]
FEATURES = {name: i for i, name in enumerate([*(f"in:{t}" for t in _TAGS), *(f"has:{s}" for s in _STEMS), *_OTHER_FEATURES])}


class Element:
    """An open element and, through its parent, all around it; their features are united once."""

    __slots__ = ("tag", "parent", "depth", "found", "likeness")

    def __init__(self, tag: str, own: tuple[int, ...], parent: Element | None) -> None:
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        around = parent.found if parent else frozenset()
        self.found = around if around.issuperset(own) else around.union(own)
        #: Equal for elements whose paths look alike.
        self.likeness = hash((parent.likeness if parent else 0, tag, own))


@dataclass
class Block:
    text: str
    within: Element
    linked: int


@lru_cache(maxsize=65536)
def _element(tag: str, attributes: str) -> tuple[str, tuple[int, ...]]:
    """A tag with the features that it gives to all blocks below it."""
    found = [FEATURES[f"in:{tag}"]] if f"in:{tag}" in FEATURES else []
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                found.append(FEATURES["hidden"])
            continue
        for token in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
            if token in _EXACT:
                found.append(FEATURES[f"has:{_EXACT[token]}"])
            else:
                found += [FEATURES[f"has:{s}"] for s in _STEMS if s in token]
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes):
        found.append(FEATURES["hidden"])
    return tag, tuple(sorted(set(found)))


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    root = top = Element("", (), None)
    is_open: Counter[str] = Counter()
    text: list[str] = []
    linked = in_link = 0

    def close() -> None:
        nonlocal linked
        whole = " ".join(entities.unescape("".join(text)).split()) if text else ""
        if whole:
            out.append(Block(whole, top, linked))
        text.clear()
        linked = 0

    def leave(tags: set[str], scope: set[str] = frozenset()) -> None:  # type: ignore[assignment]
        """Close the innermost open element of these tags and all within it, unless one of the scope stands between."""
        nonlocal top
        if not any(is_open[t] for t in tags):
            return
        end = top
        while end.tag not in tags:
            if end is root or end.tag in scope:
                return
            end = end.parent
        while top is not end.parent:
            is_open[top.tag] -= 1
            top = top.parent

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None or m.start() > at:
            part = page[at : m.start() if m else n]
            text.append(part)
            if in_link:
                linked += len(part)
        if m is None:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag in _RAW and not m[1]:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else (n if tag in ("script", "style") else at)
            continue
        if tag == "a":
            in_link = 0 if m[1] else 1
        if tag in _INLINE:
            if tag == "br":
                text.append(" ")
            continue
        close()
        in_link = 0
        if m[1]:
            leave({tag})
        elif tag not in _VOID:
            if tag in _CLOSES_P:
                if top.tag == "p":
                    leave({"p"})
            elif tag in _CLOSED_BY_SAME:
                leave(_CLOSED_BY_SAME[tag], _SCOPE)
            top = Element(*_element(tag, m[3]), top)
            is_open[tag] += 1
    close()
    return out


_DIGIT = re.compile(r"\d")
_LENGTHS = (2, 5, 10, 20, 40, 80)


def features(page: list[Block]) -> list[set[int]]:
    """Active features of each block of a page."""
    out, before = [], None
    for k, b in enumerate(page):
        n = b.text.count(" ") + 1
        found = {*b.within.found, FEATURES.get(f"own:{b.within.tag or 'body'}", FEATURES["bias"]), FEATURES["bias"]}
        found |= {FEATURES[f"depth<{d}"] for d in (3, 5) if b.within.depth < d}
        found.add(FEATURES[f"words{sum(n > x for x in _LENGTHS)}"])
        share = b.linked / len(b.text)
        found.add(FEATURES[f"links{sum(share > x for x in (0, 0.3, 0.7))}"])
        if b.text[-1] in ".!?…。！？\"'”’»)":
            found.add(FEATURES["closed"])
        if k == 0:
            found.add(FEATURES["first"])
        if 4 * k < len(page):
            found.add(FEATURES["early"])
        if 4 * k >= 3 * len(page):
            found.add(FEATURES["late"])
        around = b.within.parent.likeness if b.within.parent else None
        if around == before and k:
            found.add(FEATURES["same_parent"])
        if "|" in b.text:
            found.add(FEATURES["bar"])
        if "©" in b.text or "(c)" in b.text:
            found.add(FEATURES["copyright"])
        if _DIGIT.search(b.text):
            found.add(FEATURES["digits"])
        before = around
        out.append(found)
    return out


@dataclass
class Crf:
    """Weights [feature, state], transitions [state, state], start [state]; state 1 is the article."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def decode(self, pages: list[list[set[int]]]) -> list[np.ndarray]:
        """Viterbi over all pages side by side."""
        lengths = np.array([len(p) for p in pages])
        out = [np.zeros(n, dtype=bool) for n in lengths]
        if not len(pages) or not lengths.max(initial=0):
            return out
        emit = np.zeros((lengths.max(), len(pages), 2))
        for j, p in enumerate(pages):
            for i, f in enumerate(p):
                emit[i, j] = self.weights[list(f)].sum(0)
        best, back = self.start + emit[0], np.zeros((len(emit), len(pages), 2), dtype=np.int8)
        ends = np.where(lengths[:, None] == 1, best, 0.0)
        for i in range(1, len(emit)):
            ways = best[:, :, None] + self.moves[None]
            back[i] = ways.argmax(1)
            best = ways.max(1) + emit[i]
            ends = np.where(lengths[:, None] == i + 1, best, ends)
        for j, n in enumerate(lengths):
            if n:
                s = int(ends[j].argmax())
                for i in range(n - 1, -1, -1):
                    out[j][i] = s == 1
                    s = int(back[i, j, s])
        return out


def fit(pages: list[list[set[int]]], labels: list[list[int]], rounds: int = 150, penalty: float = 1e-3, rate: float = 0.1) -> Crf:
    """Maximum penalised likelihood; pages are padded and worked on side by side."""
    k, t, n = len(FEATURES), max(map(len, pages)), len(pages)
    x = np.zeros((t, n, k), dtype=np.float32)
    y, mask = np.zeros((t, n), dtype=np.int64), np.zeros((t, n), dtype=bool)
    for j, (p, own) in enumerate(zip(pages, labels, strict=True)):
        mask[: len(p), j], y[: len(p), j] = True, own
        for i, f in enumerate(p):
            x[i, j, list(f)] = 1
    flat, live = x.reshape(-1, k), mask.reshape(-1)
    gold = np.zeros((t, n, 2))
    gold[np.arange(t)[:, None], np.arange(n)[None], y] = mask
    gold_moves = np.einsum("tna,tnb->ab", gold[:-1], gold[1:])
    theta = [np.zeros((k, 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(a) for a in theta], [np.zeros_like(a) for a in theta]
    lse = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    total = mask.sum()
    for r in range(1, rounds + 1):
        w, moves, start = theta
        emit = (flat @ w).reshape(t, n, 2)
        ahead, behind = np.zeros((t, n, 2)), np.zeros((t, n, 2))
        ahead[0] = start + emit[0]
        for i in range(1, t):
            ahead[i] = np.where(mask[i][:, None], lse(ahead[i - 1][:, :, None] + moves, 1) + emit[i], ahead[i - 1])
        for i in range(t - 2, -1, -1):
            behind[i] = np.where(mask[i + 1][:, None], lse(moves[None] + (emit[i + 1] + behind[i + 1])[:, None, :], 2), behind[i + 1])
        z = lse(ahead[-1], 1)
        node = np.exp(ahead + behind - z[None, :, None]) * mask[:, :, None]
        edge = np.exp(ahead[:-1, :, :, None] + moves + (emit[1:] + behind[1:])[:, :, None, :] - z[None, :, None, None]) * mask[1:, :, None, None]
        grads = [flat[live].T @ (gold - node).reshape(-1, 2)[live] / total - penalty * w, (gold_moves - edge.sum((0, 1))) / total - penalty * moves, (gold[0] - node[0]).sum(0) / total - penalty * start]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            theta[i] = theta[i] + rate * (first[i] / (1 - 0.9**r)) / (np.sqrt(second[i] / (1 - 0.999**r)) + 1e-8)
    return Crf(*theta)


def sample_pages(n: int = TRAINING_PAGES, seed: int = 1) -> list[tuple[str, list[int]]]:
    """Pages of common layouts and the label of each of their blocks."""
    return [_Sample(random.Random(f"{seed}/{k}")).page() for k in range(n)]


class _Sample:
    """Writes a page and, beside it, the label of every block it writes."""

    def __init__(self, r: random.Random) -> None:
        self.r, self.html, self.labels = r, [], []

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        syllables = "an be cor de el fi go hu in jo ka li mo ne or pa qui re sa tu un ve wi xo ya zé ür ñe ça".split()
        out = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        return " ".join(out).capitalize()

    def prose(self, lo: int = 1, hi: int = 6) -> str:
        return " ".join(self.words(3, 25) + self.r.choice("...!?") for _ in range(self.r.randint(lo, hi)))

    def put(self, tag: str, text: str, label: int, attributes: str = "") -> None:
        closing = "" if tag in ("p", "li") and self.r.random() < 0.15 else f"</{tag}>"
        self.html.append(f"<{tag}{attributes}>{text}{closing}")
        self.labels.append(label)

    def named(self, *names: str) -> str:
        name = self.r.choice(names)
        return self.r.choice([f' class="{name}"', f' id="{name}"', f' class="x{self.r.randint(1, 99)} {name}"', f" class='{name}-{self.r.choice(['box', 'wrap', 'area', 'inner'])}'"])

    def within(self, tag: str, attributes: str, *parts) -> None:
        self.html.append(f"<{tag}{attributes}>")
        for part in parts:
            part()
        self.html.append(f"</{tag}>")

    def links(self, lo: int = 3, hi: int = 9) -> None:
        def item() -> None:
            self.put("li", f'<a href="/{self.r.randint(1, 99)}">{self.words(1, 3)}</a>', 0)

        self.within("ul", self.r.choice(["", ' class="menu"', ""]), *[item] * self.r.randint(lo, hi))

    def other(self) -> None:
        """One piece that is not the article."""
        r = self.r
        kind = r.randrange(11)
        line = lambda: self.put(r.choice(["p", "div", "span2", "h3"]).replace("span2", "div"), self.prose(1, 3), 0)
        if kind == 0:
            self.within(*r.choice([("nav", ""), ("div", self.named("menu", "nav", "navbar", "navigation")), ("nav", ' role="navigation"')]), self.links)
        elif kind == 1:
            self.within(*r.choice([("aside", ""), ("div", self.named("sidebar", "side", "widget", "related")), ("aside", ' class="sidebar"')]), *r.choice([(line, self.links), (self.links,), (line,), (line, line)]))
        elif kind == 2:
            self.within(r.choice(["div", "section", "p2"]).replace("p2", "div"), self.named("cookie", "consent", "notice", "alert", "cookie-banner", "gdpr", "warning"), *[line] * r.randint(1, 2))
        elif kind == 3:
            self.put(r.choice(["div", "aside", "section"]), self.prose(1, 2), 0, self.named("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"))
        elif kind == 4:
            self.within("form", r.choice(["", self.named("search", "newsletter", "signup", "login")]), lambda: self.put("label", self.words(1, 4), 0), lambda: self.put("button", self.words(1, 2), 0), *r.choice([(), (line,), (lambda: self.put("textarea", self.prose(1, 2), 0),)]))
        elif kind == 5:
            self.within("div", self.named("share", "social", "follow"), self.links)
        elif kind == 6:
            self.put(r.choice(["div", "p"]), f'<a href="/">{self.words(1, 2)}</a> &raquo; <a href="/a">{self.words(1, 3)}</a>', 0, self.named("breadcrumb", "breadcrumbs", "crumbs"))
        elif kind == 7:
            self.within("div", self.named("newsletter", "subscribe", "popup", "modal", "overlay"), *[line] * r.randint(1, 2))
        elif kind == 8:
            self.within(*r.choice([("div", ' role="alert"'), ("div", ' role="dialog"'), ("dialog", "")]), line)
        elif kind == 9:
            self.comments()
        else:
            self.within("aside", "", *[line] * r.randint(1, 3))

    def comments(self) -> None:
        r = self.r
        title = lambda: self.put("h3", self.words(1, 3), 0)
        one = lambda: self.within(*r.choice([("div", self.named("comment", "reply")), ("li", ' class="comment"'), ("article", ' class="comment"')]), *[lambda: self.put("p", self.prose(1, 4), 0)] * r.randint(1, 3))
        self.within(r.choice(["section", "div", "ol", "aside"]), self.named("comments", "comment-list", "responses comments", "discussion", "respond"), title, *[one] * r.randint(1, 6))

    def piece(self) -> None:
        """One piece of the article."""
        r = self.r
        kind = r.random()
        if kind < 0.65:
            text = self.prose(1, 8) if r.random() < 0.85 else self.words(1, 5) + "."
            self.put("p", text.replace(" ", f' <a href="/x">{self.words(1, 3)}</a> ', 1) if r.random() < 0.2 else "<b>" * (r.random() < 0.1) + text, 1)
        elif kind < 0.78:
            self.put(r.choice(["h2", "h3", "h2", "h4"]), self.words(1, 8), 1)
        elif kind < 0.86:
            self.within(r.choice(["ul", "ol"]), "", *[lambda: self.put("li", self.words(1, 15) + r.choice([".", ""]), 1)] * r.randint(2, 7))
        elif kind < 0.9:
            self.within("blockquote", "", lambda: self.put("p", self.prose(1, 3), 1))
        elif kind < 0.93:
            self.put("pre", self.words(3, 20), 1)
        elif kind < 0.96:
            row = lambda: self.within("tr", "", *[lambda: self.put("td", self.words(1, 4), 1)] * 3)
            self.within("table", "", *[row] * r.randint(2, 4))
        elif kind < 0.98:
            self.within("figure", "", lambda: self.put("figcaption", self.words(3, 12) + ".", 1))
        else:
            self.put("div", self.prose(1, 3), 1)

    def article(self) -> None:
        r = self.r
        if r.random() < 0.7:
            h1 = lambda: self.put("h1", self.words(2, 10), 1)
            self.within("header", "", h1) if r.random() < 0.1 else h1()
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            self.piece()
            if r.random() < 0.08:
                self.other()

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.html.append(f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>")
        bare = r.random() < 0.2  # the article comes first
        if not bare and r.random() < 0.6:
            top = lambda: self.put(r.choice(["div", "p", "h1", "h2"]), f'<a href="/">{self.words(1, 3)}</a>' if r.random() < 0.5 else self.words(1, 5), 0)
            self.within(*r.choice([("header", ""), ("div", self.named("header", "masthead", "top", "banner", "logo"))]), top, *r.choice([(), (self.links,), (lambda: self.put("p", self.prose(1, 2), 0),)]))
        for _ in range(0 if bare else r.choice([0, 1, 1, 2, 3])):
            self.other()
        wrappers = [[("article", "")], [("main", "")], [("main", ""), ("article", "")], [("div", self.named("content", "main-content", "post", "entry-content", "article-body", "story"))], [("div", self.named(f"c{r.randint(1, 99)}"))], [("section", "")], [("article", ""), ("div", self.named("body", "text"))], [("article", ""), ("div", ""), ("div", "")], [("div", ""), ("article", ""), ("div", self.named(f"c{r.randint(1, 99)}"))], [("table", ""), ("tr", ""), ("td", "")], []]
        wrap = r.choice([*wrappers, wrappers[0], wrappers[0]])
        for tag, attributes in wrap:
            self.html.append(f"<{tag}{attributes}>")
        self.article()
        if r.random() < 0.1:
            self.comments()
        for tag, _ in reversed(wrap):
            self.html.append(f"</{tag}>")
        if r.random() < 0.4:
            self.comments()
        for _ in range(r.choice([0, 0, 1, 2])):
            self.other()
        if r.random() < 0.85:
            foot = lambda: self.put(r.choice(["p", "div", "small2"]).replace("small2", "div"), f"&copy; {self.words(1, 3)} &middot; {self.prose(1, 2)}" if r.random() < 0.7 else self.prose(1, 2), 0)
            self.within(*r.choice([("footer", ""), ("footer", ""), ("div", self.named("footer", "bottom", "copyright", "legal"))]), foot, *r.choice([(), (self.links,)]))
        if r.random() < 0.9:
            self.html.append("</body></html>")
        return "".join(self.html), self.labels


def train(pages: list[tuple[str, list[int]]] | None = None) -> Crf:
    """A model from labelled pages: (html, label of each leaf block); the made ones if None."""
    cut = [(blocks(h), y) for h, y in (pages if pages is not None else sample_pages())]
    good = [(features(b), y) for b, y in cut if b and len(b) == len(y)]
    return fit([x for x, _ in good], [y for _, y in good])


def main_text(pages: list[str], model: Crf) -> list[str]:
    cut = [blocks(p) for p in pages]
    kept = model.decode([features(b) for b in cut])
    return ["\n".join(x.text for x, k in zip(b, keep, strict=True) if k) for b, keep in zip(cut, kept, strict=True)]


def extract(pages: DataFrame, model: Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = main_text([x or "" for x in part.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
