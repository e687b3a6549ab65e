"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page becomes a sequence of leaf blocks, texts between tags that break the flow. Each block has features of its ancestors
(tags, class and id words) and of its text (length, links, punctuation, place). A conditional random field with the
labels boilerplate and content, trained by gradient ascent on labelled pages, is decoded by Viterbi; the content blocks
in page order are the text.

Labelled pages come from the table itself: pages with an ``article`` or ``main`` element, whose blocks are labelled by it,
and the same blocks laid out anew in other page frames, in which the block's role is known by construction.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by how they take part in the flow of text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr "
             "audio canvas maction math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover "
             "iframe noscript object semantics svg video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style"}
PLAIN = {"title", "textarea"}
IN_HEAD = set("base basefont bgsound link meta noscript template".split()) | RAW | PLAIN
HIDDEN = set("head select datalist".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_NESTING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words in class and id names that tell what an element is for.
STEMS = ("comment repl respond disqus discuss feedback nav menu breadcrumb crumb pagination pager header masthead banner logo brand footer copyright legal colophon "
         "sidebar side aside widget rail ad ads advert sponsor promo teaser related recommend more popular trending share social follow tags meta byline author cookie consent notice "
         "alert message newsletter subscribe signup popup modal overlay form search login register contact article content post entry story main body text page blog news").split()

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, str], ...]
    linked: float


@dataclass
class _Open:
    parts: list[str] = field(default_factory=list)
    path: tuple = ()
    linked: int = 0
    total: int = 0


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of text in page order, each with its open elements as (tag, class and id words)."""
    blocks: list[Block] = []
    stack: list[tuple[str, str]] = []
    hidden = links = 0
    now = _Open()

    def end() -> None:
        nonlocal now
        if now.parts:
            text = SPACE.sub(" ", html.unescape("".join(now.parts))).strip()
            if text:
                blocks.append(Block(text, now.path, now.linked / max(1, now.total)))
            now = _Open()

    def add(text: str) -> None:
        if not now.parts:
            if not text.strip():
                return
            now.path = tuple(stack)
        now.parts.append(text)
        now.total += len(text)
        if links:
            now.linked += len(text)

    def pop(count: int) -> None:
        nonlocal hidden, links
        for tag, _ in stack[len(stack) - count:]:
            hidden -= tag in HIDDEN
            links -= tag == "a"
        del stack[len(stack) - count:]

    at = 0
    while True:
        m = TAG.search(page, at)
        between = page[at: m.start() if m else len(page)]
        if hidden and stack[-1][0] == "head" and between.strip():  # so does text
            pop(1)
        if not hidden:
            add(between)
        if m is None:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            if name == "br":
                if not hidden:
                    add(" ")
            else:
                end()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(len(stack) - k)
                    break
            continue
        attributes = m[3] or m[6] or ""
        if hidden:  # an element of the page's flow closes what cannot hold it
            for k in range(len(stack)):
                if stack[k][0] in HIDDEN and (name not in IN_HEAD and name != "head" if stack[k][0] == "head" else name in CLOSES_P and name != "hr"):
                    pop(len(stack) - k)
                    break
        if name in RAW or name in PLAIN:
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = close.end() if close else len(page) if name in RAW else at
            continue
        if name in VOID:
            continue
        stops = SELF_NESTING.get(name)
        if name in CLOSES_P or stops:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == (name if stops else "p") or (name in ("dt", "dd") and stack[k][0] in ("dt", "dd")) or (name in ("td", "th") and stack[k][0] in ("td", "th")):
                    pop(len(stack) - k)
                    break
                if stack[k][0] in (stops or ()) or (not stops and stack[k][0] not in INLINE):
                    break
        names = " ".join(" ".join(g for g in x if g) for x in NAMES.findall(attributes)).lower() if "=" in attributes else ""
        stack.append((name, names))
        hidden += name in HIDDEN
        links += name == "a"
    end()
    return blocks


@lru_cache(maxsize=20_000)
def path_features(path: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    out = set()
    for tag, names in path:
        if tag in ("html", "body"):
            continue
        if tag not in INLINE:
            out.add(f"t:{tag}")
        for word in WORDS.findall(names):
            for stem in STEMS:
                if word == stem or (len(stem) > 3 and word.startswith(stem)):
                    out.add(f"c:{stem}")
    inner = next((t for t, _ in reversed(path) if t not in INLINE), "")
    out.add(f"o:{inner}")
    about = {f"t:{x}" for x in ("article", "main")} | {f"c:{x}" for x in ("article", "content", "post", "entry", "story", "main", "body", "text")}
    chrome = {f"t:{x}" for x in ("nav", "footer", "aside", "form", "button", "label", "fieldset", "dialog")} | {f"c:{x}" for x in STEMS[:STEMS.index("article")]}
    out.add(f"in:{bool(out & about)}:{bool(out & chrome)}")
    if inner in ("h1", "h2", "h3", "h4", "h5", "h6"):
        out.add(f"head:{bool(out & about)}:{bool(out & chrome)}")
    return tuple(sorted(out))


def text_features(block: Block, place: int, count: int) -> tuple[str, ...]:
    text = block.text
    words = text.count(" ") + 1
    linked = "none" if not block.linked else "some" if block.linked < 0.3 else "half" if block.linked < 0.8 else "all"
    return (f"n:{min(8, words.bit_length())}", f"l:{linked}", f"e:{text[-1] in '.!?:;…”\"'}", f"s:{min(3, text.count('. '))}",
            f"m:{'©' in text or '·' in text or '|' in text}", f"p:{4 * place // count}", "b")


@dataclass
class FieldModel:
    """Weights of features (label 1 against label 0) and of transitions (2 x 2, with start scores)."""

    weights: dict[str, float]
    moves: np.ndarray
    start: np.ndarray

    def scores(self, blocks: list[Block]) -> list[float]:
        get, count = self.weights.get, len(blocks)
        return [sum(get(f, 0.0) for f in path_features(b.path)) + sum(get(f, 0.0) for f in text_features(b, k, count)) for k, b in enumerate(blocks)]

    def decode(self, blocks: list[Block]) -> list[int]:
        """The best label sequence; of equal ones, content."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        s0, s1, back = float(self.start[0]), float(self.start[1]), []
        for k, x in enumerate(self.scores(blocks)):
            if k:
                from0, from1 = (1 if s1 + m10 >= s0 + m00 else 0), (1 if s1 + m11 >= s0 + m01 else 0)
                back.append((from0, from1))
                s0, s1 = max(s0 + m00, s1 + m10), max(s0 + m01, s1 + m11)
            s1 += x
        if not blocks:
            return []
        labels = [1 if s1 >= s0 else 0]
        for from0, from1 in reversed(back):
            labels.append(from1 if labels[-1] else from0)
        return labels[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train_field(pages: list[tuple[list[Block], list[int]]], epochs: int = 8, rate: float = 0.3, penalty: float = 1e-3, seed: int = 5) -> FieldModel:
    """Gradient ascent (AdaGrad) on the log-likelihood of the label sequences, page by page."""
    index: dict[str, int] = {}
    rows = []
    for blocks, labels in pages:
        if blocks:
            feats = [np.array([index.setdefault(f, len(index)) for f in (*path_features(b.path), *text_features(b, k, len(blocks)))]) for k, b in enumerate(blocks)]
            rows.append((feats, np.array(labels)))
    w, moves, start = np.zeros(max(1, len(index))), np.zeros((2, 2)), np.zeros(2)
    gw, gm, gs = np.full_like(w, 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in random.permutation(len(rows)):
            feats, labels = rows[r]
            n = len(feats)
            node = np.zeros((n, 2))
            node[:, 1] = [w[f].sum() for f in feats]
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = start + node[0]
            for k in range(1, n):
                forward[k] = node[k] + _log_sum(forward[k - 1][:, None] + moves, 0)
            for k in range(n - 2, -1, -1):
                backward[k] = _log_sum(moves + (node[k + 1] + backward[k + 1])[None, :], 1)
            total = _log_sum(forward[-1], 0)
            at = np.exp(forward + backward - total)
            step = np.zeros((2, 2))
            for k in range(1, n):
                step -= np.exp(forward[k - 1][:, None] + moves + (node[k] + backward[k])[None, :] - total)
                step[labels[k - 1], labels[k]] += 1
            first = -at[0]
            first[labels[0]] += 1
            for k in range(n):
                g = labels[k] - at[k, 1] - penalty * w[feats[k]]
                gw[feats[k]] += g * g
                w[feats[k]] += rate * g / np.sqrt(gw[feats[k]])
            gm += step * step
            moves += rate * step / np.sqrt(gm)
            gs += first * first
            start += rate * first / np.sqrt(gs)
    return FieldModel({f: float(w[k]) for f, k in index.items()}, moves, start)


# Frames for laid-out training pages: (tag, class) of the places a role is found in.
FRAMES = {
    "content": [("article", ""), ("main", ""), ("div", "content"), ("div", "post-content"), ("div", "entry-content"), ("div", "article-body"), ("section", "story"),
                ("div", "main-content"), ("div", "post"), ("div", "text"), ("div", "article"), ("section", ""), ("div", "")],
    "menu": [("nav", ""), ("div", "menu"), ("ul", "navigation"), ("div", "navbar"), ("nav", "breadcrumbs"), ("div", "breadcrumb")],
    "header": [("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "top-banner")],
    "footer": [("footer", ""), ("div", "footer"), ("footer", "site-footer"), ("div", "copyright")],
    "sidebar": [("aside", ""), ("div", "sidebar"), ("aside", "sidebar"), ("div", "widget"), ("div", "related"), ("section", "related-posts"), ("div", "right-rail")],
    "notice": [("div", "notice"), ("div", "cookie-banner"), ("div", "cookie-consent"), ("div", "alert"), ("div", "newsletter"), ("section", "subscribe"), ("dialog", ""), ("div", "popup")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "sponsored"), ("aside", "ad"), ("div", "promo"), ("ins", "ad")],
    "form": [("form", ""), ("form", "search"), ("form", "login"), ("div", "contact-form")],
    "comments": [("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "comments"), ("section", "reader-comments"), ("div", "discussion"), ("ul", "replies")],
}


def laid_out(sentences: list[str], random: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page in one of the frames, its blocks and their labels, made from the sentences of a real page."""
    pick = lambda role: FRAMES[role][random.integers(len(FRAMES[role]))]
    some = lambda: sentences[random.integers(len(sentences))]
    short = lambda n: " ".join(some().split()[:n]) or "x"
    blocks: list[Block] = []
    labels: list[int] = []

    def put(path: tuple, text: str, label: int, linked: float = 0.0) -> None:
        blocks.append(Block(text, (("html", ""), ("body", ""), *path), linked))
        labels.append(label)

    def chrome(role: str, outer: tuple = ()) -> None:
        path = (*outer, pick(role))
        for _ in range(1 + int(random.integers(4))):
            if role == "menu":
                put((*path, ("ul", ""), ("li", "")), short(2), 0, 1.0)
            elif role == "comments":
                inner = (*path, ("li" if random.random() < 0.3 else "div", "comment" if random.random() < 0.6 else ""))
                if random.random() < 0.4:
                    put((*inner, ("cite" if random.random() < 0.3 else "div", "author" if random.random() < 0.5 else "")), short(2), 0)
                put((*inner, ("p", "")) if random.random() < 0.7 else inner, some(), 0)
            elif role == "form":
                put((*path, (("label", ""), ("button", ""), ("p", ""))[random.integers(3)]), short(3), 0)
            elif role == "sidebar":
                kind = random.random()
                put((*path, ("h3", "")) if kind < 0.3 else (*path, ("ul", ""), ("li", "")) if kind < 0.6 else (*path, ("p", "")), short(8) if kind < 0.6 else some(), 0, 1.0 if 0.3 <= kind < 0.6 else 0.0)
            elif role == "footer":
                put(path if random.random() < 0.5 else (*path, ("p", "")), "© " + short(5) if random.random() < 0.5 else some(), 0, 0.5 * float(random.random() < 0.3))
            else:
                put(path if random.random() < 0.5 else (*path, ("p" if role != "header" or random.random() < 0.5 else "h1", "")), some() if random.random() < 0.7 else short(5), 0, float(random.random() < 0.2))

    for role in ("header", "menu", "notice", "advert", "form"):
        if random.random() < (0.7 if role == "menu" else 0.4):
            chrome(role)
    if random.random() < 0.2:
        chrome("sidebar")
    outer = (("div", ("page", "wrapper", "container", "")[random.integers(4)]),) if random.random() < 0.4 else ()
    content = (*outer, pick("content"))
    if content[-1][0] not in ("article", "main") and random.random() < 0.2:
        content = (*outer, ("main", ""), content[-1])
    if random.random() < 0.8:
        put((*content, ("header", ""), ("h1", "")) if random.random() < 0.15 else (*content, ("h1", "")), short(8), 1)
    for _ in range(1 + int(random.integers(8))):
        kind = random.random()
        inner = (*content, ("p", "")) if kind < 0.75 else (*content, ("h2", "")) if kind < 0.82 else (*content, ("ul", ""), ("li", "")) if kind < 0.9 else (*content, ("blockquote", ""), ("p", "")) if kind < 0.95 else content
        put(inner, short(6) if kind < 0.9 and kind >= 0.75 else " ".join(some() for _ in range(1 + int(random.integers(3)))), 1, 0.2 * float(random.random() < 0.15))
        if random.random() < 0.12:
            chrome(("advert", "sidebar", "notice", "form")[random.integers(4)], content)
    if random.random() < 0.4:
        chrome("comments", content if random.random() < 0.4 else outer)
    for role in ("sidebar", "advert", "form", "notice", "footer"):
        if random.random() < (0.8 if role == "footer" else 0.3):
            chrome(role, outer if role != "footer" else ())
    return blocks, labels


def labelled_pages(pages: list[str], variants: int, seed: int = 3) -> list[tuple[list[Block], list[int]]]:
    """Each page that marks its article, labelled by that mark, and ``variants`` frames around its blocks."""
    random = np.random.default_rng(seed)
    out = []
    for page in pages:
        blocks = leaf_blocks(page)
        marked = [any(t in ("article", "main") for t, _ in b.path) and not any(f in ("in:True:True", "in:False:True") for f in path_features(b.path)) for b in blocks]
        if any(marked):
            out.append((blocks, [int(x) for x in marked]))
        sentences = [s for b in blocks for s in re.split(r"(?<=[.!?]) ", b.text[:20_000]) if s.strip()] or ["Some words of a page."]
        out.extend(laid_out(sentences, random) for _ in range(variants))
    return out


def fit_field(pages: DataFrame, sample: int = 150, variants: int = 6, html_col: str = "html") -> FieldModel:
    """Model from at most ``sample`` pages (those with the smallest hashes), fitted in one task. No page at all: neutral frames."""
    chosen = pages.where(F.length(html_col) > 0).orderBy(F.xxhash64(html_col)).limit(sample).select(F.col(html_col)).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in batches for t in b.column(0).to_pylist()]
        if not texts:
            return
        model = train_field(labelled_pages(texts, variants))
        names = [*model.weights, *(f"move:{a}{b}" for a in (0, 1) for b in (0, 1)), "start:0", "start:1"]
        values = [*model.weights.values(), *model.moves.ravel().tolist(), *model.start.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(values, pa.float64())], names=["name", "value"])

    got = {r["name"]: r["value"] for r in chosen.mapInArrow(run, "name string, value double").collect()}
    if not got:
        return train_field(labelled_pages([""], 100))
    moves = np.array([[got.pop(f"move:{a}{b}") for b in (0, 1)] for a in (0, 1)])
    return FieldModel(got, moves, np.array([got.pop("start:0"), got.pop("start:1")]))


def extract_text(pages: DataFrame, model: FieldModel, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without ``html_col``, with ``text_col`` (main text, empty if none) and ``n_blocks`` (content blocks).

    Null and empty html give an empty text. Repeated rows are extracted each; other columns pass through, and columns with
    the new names are replaced. An empty table gives an empty one.
    """
    drop = {html_col.lower(), text_col.lower(), "n_blocks"}
    names = [c for c in pages.columns if c.lower() not in drop]
    schema = pages.select(*names, F.lit("").alias(text_col), F.lit(0).alias("n_blocks")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for page in batch.column(batch.num_columns - 1):
                blocks = leaf_blocks(page.as_py() or "")
                kept = [b.text for b, label in zip(blocks, model.decode(blocks), strict=True) if label]
                texts.append(" ".join(kept))
                counts.append(len(kept))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[*names, text_col, "n_blocks"])

    return pages.select(*names, F.col(html_col).cast("string").alias("__page")).mapInArrow(run, schema)
