"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into blocks, the texts between block-level tags.  Each block has binary features:
its own tag, the tags and class words of all its ancestors, and classes of its text (length,
link share, punctuation, first and last sign).  The chain has the states *boilerplate* and
*article*; its weights are learned by stochastic gradient ascent on the likelihood of
labelled pages (forward-backward), and a page is decoded by Viterbi.

The labelled pages are written by ``labelled_pages``: layouts drawn from common markup for
menus, headers, notices, adverts, sidebars, forms, comments, footers and articles around
invented words, each block with its label.  No corpus text is involved.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed, and article blocks are joined by two line feeds.  Scripts, styles, comments and
the head are never blocks; ``br`` is white space.  A page is scanned once, in time linear in its length:
a ``<`` that begins no tag is text, a quote that is never closed is no quote, and of elements whose
content is skipped all but scripts and styles are skipped only if they are closed.  Defined results: null html is empty;
pages without article blocks give the empty text; rows with null or repeated ids are rows of
their own; no pages give no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Elements of HTML by their role here; fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; the rest of a page is theirs where a raw one is not closed.
RAW = frozenset("script style".split())
SKIPPED = RAW | frozenset("head template noscript iframe object svg title textarea canvas audio video".split())
#: Skipped elements that may hold others of their kind, and block-level elements that end an open formula.
NESTED = frozenset("template object svg canvas audio video".split())
BREAKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section table td th tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html".split())
#: Training: pages, passes, step.
PAGES, EPOCHS, RATE, SEED = 1500, 6, 0.1, 11

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/><]*+)")
_VALUE = re.compile(r"=\s*+([\"'])|>")
_CLASS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Words of a name: parted by other signs and by a change to capitals.
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SPACE = re.compile(r"\s+")


class _Scanner:
    """Tags of a page, found left to right; what was once not found is not looked for again."""

    def __init__(self, page: str):
        self.page, self.absent = page, set()
        self.ends: dict[str, dict[int, int]] = {}

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at`` (the place of its ``>``), or -1."""
        if self.find(">", at) < 0:
            return -1
        while True:
            m = _VALUE.search(self.page, at)
            if m is None:
                return -1
            if m[1] is None:
                return m.start()
            close = self.find(m[1], m.end())
            inner = self.page.find(">", m.end(), close) if close >= 0 else -1
            if close < 0 or inner >= 0 and self.page.find("<", inner, close) >= 0:
                # the quote is not closed, or only by one of a later tag
                return self.find(">", m.end())
            at = close + 1

    def element_end(self, tag: str, start: int, at: int) -> int:
        """Behind the closing tag of a skipped element that begins at ``start`` and whose tag ends before ``at``, or -1."""
        if tag in NESTED and tag not in self.ends:
            self.ends[tag] = self._matched(tag)
        if start in self.ends.get(tag, ()):
            return self.ends[tag][start]
        if "</" + tag in self.absent:
            return -1
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.page, at)
        end = self.find(">", m.end()) if m else -1
        if end < 0:
            self.absent.add("</" + tag)
        return end + 1 if end >= 0 else -1

    def _matched(self, tag: str) -> dict[int, int]:
        """Of each element of a kind that is closed: where it begins, and behind its own closing tag."""
        open_, ends = [], {}
        for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])", re.I).finditer(self.page):
            end = self.page.find(">", m.end())
            if end < 0:
                break
            if not m[1]:
                if self.page[end - 1] != "/":
                    open_.append(m.start())
            elif open_:
                ends[open_.pop()] = end + 1
        return ends


def blocks(page: str, known=None) -> list[tuple[str, frozenset, str, int]]:
    """``(own tag, ancestor features, text, characters inside links)`` of each leaf block.

    ``known`` restricts the ancestor features, which bounds them whatever the nesting.
    """
    out: list[tuple[str, frozenset, str, int]] = []
    #: of each open element: its tag, features of it and its ancestors, the nearest block-level tag, the depth of the nearest scope
    stack: list[tuple[str, frozenset, str, int]] = [("", frozenset(), "", 0)]
    opened: defaultdict[str, list[int]] = defaultdict(list)  # depths of the open elements of a tag
    parts: list[str] = []
    linked, at, n = 0, 0, len(page)
    scan = _Scanner(page)

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if opened["a"]:
                linked += len(raw.strip())

    def flush() -> None:
        nonlocal linked
        if parts:
            joined = _SPACE.sub(" ", "".join(parts)).strip()
            if joined:
                out.append((stack[-1][2], stack[-1][1], joined, linked))
            parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        for tag, *_ in stack[k:]:
            opened[tag].pop()
        del stack[k:]

    while at < n:
        start = scan.find("<", at)
        if start < 0:
            text(page[at:])
            break
        text(page[at:start])
        mark = page[start + 1 : start + 2]
        if mark in ("!", "?") and mark:
            note = page.startswith("<!--", start)
            end = scan.find("-->" if note else ">", start + 2)
            at = n if note and end < 0 else end + (3 if note else 1) if end >= 0 else start + 1
            if at == start + 1:
                text("<")
            continue
        m = _NAME.match(page, start + 1)
        end = scan.tag_end(m.end()) if m else -1
        if end < 0:
            text("<")
            at = start + 1
            continue
        at = end + 1
        tag = m[2].lower()
        formula = opened["math"][0] if opened["math"] else 0
        if m[1]:
            # an end tag belongs to a formula only if its element began inside
            inline = tag in INLINE or tag == "math" or formula > 0 and (not opened[tag] or opened[tag][-1] > formula) and tag not in BREAKS
            if not inline and tag not in SKIPPED:
                flush()
            if opened[tag]:
                pop_to(opened[tag][-1])
            continue
        if formula and tag in BREAKS:
            pop_to(formula)
            formula = 0
        inline = tag in INLINE or tag == "math" or formula > 0
        inside = page[m.end() : end]
        if tag in SKIPPED:
            if tag == "head":
                flush()
            if not inside.endswith("/"):
                behind = scan.element_end(tag, start, at)
                at = behind if behind >= 0 else n if tag in RAW else at
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            continue
        if not inline:
            flush()
            if opened["p"] and tag not in SCOPES.difference(("ul", "ol", "dl", "table")):
                pop_to(opened["p"][-1])
            nearest = max((opened[t][-1] for t in CLOSES.get(tag, ()) if opened[t]), default=0)
            if nearest > stack[-1][3]:
                pop_to(nearest)
        own = {f"in={tag}"}
        for a in _CLASS.finditer(inside) if "=" in inside else ():
            own.update(f"cls={w.lower()}" for w in _WORD.findall(a[1] or a[2] or a[3] or ""))
        if known is not None:
            own &= known
        _, above, block, scope = stack[-1]
        depth = len(stack)
        opened[tag].append(depth)
        stack.append((tag, above | own if not own <= above else above, block if inline else tag, depth if tag in SCOPES else scope))
    flush()
    return out


def block_features(own: str, above: frozenset, text: str, linked: int) -> list[str]:
    n = len(text)
    words = text.count(" ") + 1
    size = 0 if words < 3 else 1 if words < 6 else 2 if words < 15 else 3 if words < 40 else 4
    share = linked / max(n, 1)
    signs = sum(text.count(c) for c in ".,;:!?")
    return [
        *above,
        f"own={own}",
        f"words={size}",
        f"links={0 if share == 0 else 1 if share < 0.4 else 2}",
        f"signs={0 if signs == 0 else 1 if signs < 3 else 2}",
        f"stop={text[-1] in '.!?'}",
        f"mark={text[0] in '©®»›|·•'}",
        "any",
    ]


class ChainModel:
    """Weights of the two states per feature, and of state pairs (row 2: the start)."""

    def __init__(self, names: list[str], weights: np.ndarray, steps: np.ndarray):
        self.index = {f: k for k, f in enumerate(names)}
        self.weights, self.steps = weights, steps
        self.known = frozenset(f for f in names if f.startswith(("in=", "cls=")))
        self.scores = {f: tuple(weights[k]) for f, k in self.index.items()}

    @classmethod
    def fit(cls, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> ChainModel:
        names = sorted({f for rows, _ in pages for row in rows for f in row})
        model = cls(names, np.zeros((len(names), 2)), np.zeros((3, 2)))
        coded = [([np.array([model.index[f] for f in row]) for row in rows], labels) for rows, labels in pages if rows]
        rng = np.random.default_rng(seed)
        for epoch in range(epochs):
            for p in rng.permutation(len(coded)):
                rows, labels = coded[p]
                local = np.array([model.weights[ids].sum(axis=0) for ids in rows])
                node, pair = marginals(local, model.steps)
                step = rate / (1 + epoch)
                before = 2
                for t, ids in enumerate(rows):
                    wrong = -node[t]
                    wrong[labels[t]] += 1
                    model.weights[ids] += step * (wrong - 1e-4 * model.weights[ids])
                    model.steps[before, labels[t]] += step
                    model.steps -= step * pair[t]
                    before = labels[t]
        return cls(names, model.weights, model.steps)

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The best state of each block, by Viterbi; ties go to boilerplate."""
        s = self.steps.tolist()
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for t, row in enumerate(rows):
            x = y = 0.0
            for f in row:
                w = self.scores.get(f)
                if w:
                    x += w[0]
                    y += w[1]
            if t == 0:
                a, b = s[2][0] + x, s[2][1] + y
                continue
            to_a = (a + s[0][0], 0) if a + s[0][0] >= b + s[1][0] else (b + s[1][0], 1)
            to_b = (a + s[0][1], 0) if a + s[0][1] >= b + s[1][1] else (b + s[1][1], 1)
            back.append((to_a[1], to_b[1]))
            a, b = to_a[0] + x, to_b[0] + y
        if not rows:
            return []
        path = [1 if b > a else 0]
        for pointers in reversed(back):
            path.append(pointers[path[-1]])
        return path[::-1]


def marginals(local: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State and state-pair probabilities of a chain by forward-backward in logs."""
    n = len(local)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = steps[2] + local[0]
    for t in range(1, n):
        ahead[t] = np.logaddexp.reduce(ahead[t - 1][:, None] + steps[:2], axis=0) + local[t]
    for t in range(n - 2, -1, -1):
        behind[t] = np.logaddexp.reduce(steps[:2] + local[t + 1] + behind[t + 1], axis=1)
    total = np.logaddexp.reduce(ahead[-1])
    pair = np.zeros((n, 3, 2))
    pair[0, 2] = np.exp(ahead[0] + behind[0] - total)
    for t in range(1, n):
        pair[t, :2] = np.exp(ahead[t - 1][:, None] + steps[:2] + local[t] + behind[t] - total)
    return np.exp(ahead + behind - total), pair


# --- labelled pages --------------------------------------------------------------------

#: Class words of each part of a page in the labelled pages; fixed values.
CLASSES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs tabs pagination pager",
    "header": "header masthead topbar site-header branding logo",
    "notice": "notice cookie consent banner alert gdpr warning popup modal",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense",
    "sidebar": "sidebar related widget recommended popular trending more share social newsletter subscribe toc",
    "comments": "comments comment discussion replies reply respond disqus responses feedback kommentare commentaires comentarios",
    "footer": "footer copyright legal colophon credits bottom",
    "form": "search login signup contact-form subscribe-form",
    "article": "content article post entry story main text article-body post-content body",
}
_OPEN, _CLOSE = "\x02", "\x03"  # around article blocks, so that labels are read off the parsed blocks


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng
        #: How a page names its parts: "known" words, "random" ones, or "bare" elements without names.
        self.style = "known"

    def word(self) -> str:
        return "".join(self.rng.choice("abcdefghilmnoprstuvé") for _ in range(self.rng.randint(2, 9)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high))).capitalize()

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 14).replace(" ", ", ", self.rng.random() < 0.3) + self.rng.choice("..!?") for _ in range(self.rng.randint(low, high)))

    def odd(self) -> str:
        """Article text that is no sentence: words with signs behind or between them, or alone, few or many."""
        rng = self.rng
        sign = rng.choice((" |", "&amp;&amp;&amp;", "***", "", "", " -", ":", ";", ",", " 1 2", "@@@"))
        return " ".join(self.word() + (sign if rng.random() < 0.8 else "") for _ in range(rng.choice((1, 3, 8, 20, 60)))) + rng.choice(("", sign, "."))

    def box(self, part: str, tags: str, inner: str) -> str:
        tag = self.rng.choice(tags.split())
        how = self.rng.random()
        name = self.rng.choice(CLASSES[part].split()) if self.style == "known" else self.word()
        if self.style == "known" and part != "article" and self.rng.random() < 0.3:  # names made of several words
            name = self.rng.choice((f"{self.rng.choice('clmu')}-{name}__{self.word()}", f"{self.word()}{name.title()}", f"{name}-{self.word()}"))
        if self.style == "bare":
            return f"<div>{inner}</div>"
        plain = tag not in ("div", "ul", "section", "span", "p") and how < 0.5
        return f"<{tag}{'' if plain else f' {self.rng.choice(("class", "class", "id"))}="{name}"'}>{inner}</{tag}>"

    def links(self, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{self.word()}">{self.words(1, 3)}</a></{tag}>' for _ in range(self.rng.randint(2, 8)))

    def part(self, part: str) -> str:
        rng = self.rng
        line = rng.choice((self.sentences(1, 3), self.words(1, 6), f"<p>{self.sentences(1, 3)}</p>", f'<a href="#">{self.words(1, 5)}</a>'))
        if part == "menu":
            return self.box(part, "nav nav div ul", f"<ul>{self.links()}</ul>" if rng.random() < 0.7 else self.links("span"))
        if part == "header":
            return self.box(part, "header header div", f"<h1>{self.words(1, 3)}</h1><p>{self.sentences(1, 1)}</p>" if rng.random() < 0.5 else line)
        if part == "notice":
            return self.box(part, "div section aside p", line)
        if part == "advert":
            return self.box(part, "div div aside section p", line)
        if part == "sidebar":
            return self.box(part, "aside aside div section", f"<h3>{self.words(1, 3)}</h3>" + (f"<ul>{self.links()}</ul>" if rng.random() < 0.6 else f"<p>{self.sentences(1, 2)}</p>"))
        if part == "comments":
            each = "".join(f"<{t}><b>{self.words(1, 2)}</b><p>{self.sentences(1, 4)}</p></{t}>" for t in (rng.choice(("div", "li", "article")),) * rng.randint(1, 4))
            return self.box(part, "section div ol", f"<h3>{self.words(1, 2)}</h3>{each}")
        if part == "form":
            if rng.random() < 0.4:  # parts of forms without one
                return rng.choice((f"<button>{self.words(1, 4)}</button>", f"<select><option>{self.words(1, 2)}</option><option>{self.words(1, 2)}</option></select>", f"<fieldset><legend>{self.words(1, 3)}</legend>{self.sentences(1, 1)}</fieldset>"))
            return f"<form action='/'><label>{self.words(1, 3)}</label><p>{self.sentences(1, 1)}</p><button>{self.words(1, 2)}</button><select><option>{self.word()}</option></select></form>"
        return self.box("footer", "footer footer div", rng.choice(("&copy; ", "© ", "")) + f"{self.word()}.example &middot; {self.sentences(1, 2)}" if rng.random() < 0.6 else f"<p>{self.sentences(1, 2)}</p><ul>{self.links()}</ul>")

    def article(self) -> str:
        rng = self.rng
        mark = lambda tag, text: f"<{tag}>{_OPEN}{text}{_CLOSE}</{tag}>"
        out = [mark("h1", self.words(1, 12))] if rng.random() < 0.7 else []
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.75:
                text = self.sentences(1, rng.choice((1, 3, 12))) if rng.random() < 0.75 else self.odd()
                if rng.random() < 0.15:
                    text = f"<b>{text}" if rng.random() < 0.5 else f'<a href="/x">{self.word()}</a> {text}'
                out.append(mark("p", text))
            elif kind < 0.82:
                out.append(mark(rng.choice(("h2", "h3")), self.words(1, 6)))
            elif kind < 0.87:
                out.append(mark("blockquote", self.sentences(1, 3)))
            elif kind < 0.91:
                out.append(f"<ul>{''.join(mark('li', self.sentences(1, 2)) for _ in range(rng.randint(2, 4)))}</ul>")
            elif kind < 0.94:
                out.append(mark("pre", self.words(3, 20)))
            elif kind < 0.96:
                out.append(f"<table><tr>{mark('td', self.words(1, 4))}{mark('td', self.words(1, 4))}</tr></table>")
            elif self.style != "bare":
                out.append(self.part(rng.choice(("advert", "sidebar", "notice", "form", "form"))))
        inner = "".join(out)
        how = rng.random()
        if how < 0.5:
            inner = f"<article>{inner}</article>"
        elif how < 0.85:
            inner = self.box("article", "div div section main article", inner)
        return f"<main>{inner}</main>" if rng.random() < 0.25 else inner

    def plain(self) -> str:
        """A page of article text alone: without tags, or in nested elements without names."""
        text = [f"{_OPEN}{self.sentences(1, 6) if self.rng.random() < 0.8 else self.odd()}{_CLOSE}" for _ in range(self.rng.randint(1, 4))]
        how = self.rng.random()
        if how < 0.3:
            return text[0]
        inner = "".join(f"<{t}>{x}</{t}>" for x in text for t in (self.rng.choice(("div", "p")),))
        for _ in range(self.rng.randint(0, 3)):
            inner = f"<div>{inner}</div>" if how < 0.7 else f'<div id="{self.word()}">{inner}</div>'
        return inner if how < 0.5 else f"<html><body>{inner}</body></html>"

    def page(self) -> str:
        rng = self.rng
        how = rng.random()
        self.style = "known" if how < 0.7 else "random" if how < 0.82 else "bare"
        if how > 0.9:
            return self.plain()
        some = lambda p, *kinds: "".join(self.part(k) for k in kinds if rng.random() < p)
        if self.style == "bare":  # only what a reader tells apart by its text: lists of links
            top, tail = some(0.6, "menu"), some(0.5, "menu")
        else:
            top = some(0.5, "notice") + some(0.6, "header", "menu") + some(0.4, "advert", "sidebar", "form")
            tail = some(0.4, "sidebar", "comments", "form", "advert", "notice") + some(0.8, "footer")
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{top}{self.article()}{tail}</body></html>"


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[list[list[str]], list[int]]]:
    """Feature rows and labels of the blocks of invented pages."""
    writer, out = _Writer(random.Random(seed)), []
    for _ in range(n):
        rows, labels = [], []
        for own, above, text, linked in blocks(writer.page()):
            label = int(_OPEN in text)
            text = text.replace(_OPEN, "").replace(_CLOSE, "").strip() or "x"
            rows.append(block_features(own, above, text, linked))
            labels.append(label)
        out.append((rows, labels))
    return out


def train(n: int = PAGES, seed: int = SEED) -> ChainModel:
    return ChainModel.fit(labelled_pages(n, seed), seed=seed)


def main_text(page: str, model: ChainModel) -> tuple[str, int, int]:
    """Main text, number of blocks, number of article blocks."""
    found = blocks(page, model.known)
    states = model.decode([block_features(*b) for b in found])
    kept = [b[2] for b, s in zip(found, states, strict=True) if s]
    return "\n\n".join(kept), len(found), len(kept)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64()), ("n_article_blocks", pa.int64())])


def extract_text(pages: DataFrame, model: ChainModel | None = None) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_article_blocks`` of every page."""
    model = model or train()
    names = sorted(model.index, key=model.index.get)
    shared = pages.sparkSession.sparkContext.broadcast((names, model.weights, model.steps))

    def run(batches):
        own = ChainModel(*shared.value)
        for batch in slices(batches, "html"):
            found = [main_text(h or "", own) for h in batch.column("html").to_pylist()]
            texts, total, kept = zip(*found, strict=True)
            yield pa.record_batch(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(total, pa.int64()), pa.array(kept, pa.int64())],
                schema=_OUT,
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_article_blocks long")
