"""Main text of web pages from flat text blocks.

A page is cut into a flat list of text blocks.  Each block is described by its number of words and link
density, those of its neighbours, and where it stands; a decision tree trained on a small labelled table
says which blocks belong to the article.
"""
from __future__ import annotations

import heapq
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import key, map_batches

#: Elements by their part in a page.
SKIPPED = "script style noscript template svg iframe object title select button textarea canvas".split()
AREAS_OUT = "nav header footer aside form menu dialog".split()
AREAS_IN = "article main".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
INLINE = ("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
          "strong sub sup time tt u var").split()
#: Words of class, id and role that mark what is not the article.
FURNITURE = ("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
             "submenu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended recommendations cookie "
             "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
             "login share sharing social comment comments commentlist disqus reply replies respond pagination pager toolbar search "
             "searchbox copyright contentinfo complementary hidden").split()
#: After these parts a name tells what a page has or is about, not what the element is.
ABOUT = "has with no without category cat tag".split()
#: A marked element is the article when it holds so many times the text of all unmarked paragraphs (of these words at
#: least): with an article element in it, and without.
PARAGRAPH_WORDS = 20
HELD_WITH_ARTICLE, HELD_WITHOUT = 3, 10

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(SKIPPED)})(?=[\s/>])(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
#: An id names a place to link to; it tells of furniture on these elements only, never on headings, sections or text.
NAMED_BY_ID = frozenset(("div", "section", "aside", "ul", "ol", "table", "header", "footer", "nav", "form"))
#: Elements of running text: a name that mentions furniture between other words does not mark them.
OF_TEXT = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "section", "span", "td", "li", "dd", "dt"))
#: Names such as entry-header are those of an article's own heading.
OWN_HEADING = frozenset(("entry", "post", "article", "content", "section", "story"))
PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")

FEATURES = ["words", "density", "words_before", "density_before", "words_after", "density_after", "area", "furniture"]
#: The labelled table. area: 1 inside an article, -1 inside page furniture, 0 elsewhere.
LABELLED = [
    # in an article: headings, paragraphs of any length, sentences with links, a linked paragraph in text
    (10, 0.0, 6, 1.0, 120, 0.0, 1, 0, 1), (9, 0.0, 12, 0.0, 150, 0.0, 1, 0, 1), (4, 0.0, 0, 0.0, 30, 0.0, 1, 0, 1),
    (120, 0.0, 10, 0.0, 80, 0.0, 1, 0, 1), (300, 0.1, 40, 0.0, 2, 0.0, 1, 0, 1), (35, 0.3, 60, 0.0, 20, 0.0, 1, 0, 1),
    (1, 0.0, 200, 0.0, 8, 0.0, 1, 0, 1), (2, 0.0, 1, 0.0, 5, 0.0, 1, 0, 1), (1, 0.0, 1, 0.0, 1, 1.0, 1, 0, 1),
    (15, 0.6, 60, 0.0, 80, 0.0, 1, 0, 1), (5, 1.0, 80, 0.0, 90, 0.0, 1, 0, 1), (50, 0.0, 3, 1.0, 0, 0.0, 1, 0, 1),
    (22, 0.2, 8, 0.0, 12, 0.0, 1, 0, 1), (3, 0.0, 15, 0.0, 2, 1.0, 1, 0, 1), (12, 0.9, 70, 0.0, 40, 0.1, 1, 0, 1),
    # lists of links in an article
    (4, 1.0, 5, 1.0, 3, 1.0, 1, 0, 1), (6, 1.0, 4, 1.0, 60, 0.0, 1, 0, 1), (3, 1.0, 7, 1.0, 2, 1.0, 1, 0, 1),
    (8, 1.0, 5, 0.9, 6, 1.0, 1, 0, 1), (2, 1.0, 3, 1.0, 90, 0.0, 1, 0, 1),
    # page furniture, by its element
    (1, 1.0, 1, 1.0, 1, 1.0, -1, 0, 0), (8, 0.0, 100, 0.0, 0, 0.0, -1, 0, 0), (40, 0.0, 60, 0.0, 8, 0.0, -1, 0, 0),
    (200, 0.0, 50, 0.0, 60, 0.0, -1, 0, 0), (25, 0.4, 3, 1.0, 120, 0.0, -1, 0, 0), (3, 0.0, 0, 0.0, 1, 1.0, -1, 0, 0),
    (6, 1.0, 2, 1.0, 90, 0.0, -1, 0, 0), (90, 0.1, 90, 0.0, 90, 0.0, -1, 0, 0), (12, 0.0, 12, 0.0, 40, 0.0, -1, 0, 0),
    # page furniture, by its marks, wherever it stands
    (12, 0.0, 1, 1.0, 10, 0.0, 0, 1, 0), (80, 0.0, 120, 0.0, 60, 0.0, 1, 1, 0), (3, 0.0, 40, 0.0, 50, 0.0, 1, 1, 0),
    (150, 0.0, 90, 0.0, 0, 0.0, 0, 1, 0), (30, 0.5, 30, 0.0, 30, 0.0, 0, 1, 0), (6, 1.0, 6, 1.0, 6, 1.0, 0, 1, 0),
    (20, 0.0, 70, 0.0, 25, 0.0, -1, 1, 0), (45, 0.0, 8, 0.0, 45, 0.0, 1, 1, 0), (1, 0.0, 3, 0.0, 2, 0.0, 1, 1, 0),
    (1, 0.0, 40, 0.0, 40, 0.0, 0, 1, 0), (60, 0.0, 60, 0.0, 120, 0.0, 0, 1, 0), (12, 0.2, 2, 1.0, 90, 0.0, 0, 1, 0),
    (3, 1.0, 30, 0.0, 30, 0.0, 1, 1, 0), (6, 1.0, 3, 1.0, 3, 1.0, 1, 1, 0), (25, 0.0, 3, 0.0, 60, 0.0, 0, 1, 0),
    # pages without an article element: long text, short text beside long text, headings
    (60, 0.0, 5, 1.0, 40, 0.0, 0, 0, 1), (25, 0.1, 30, 0.0, 45, 0.0, 0, 0, 1), (12, 0.0, 80, 0.0, 90, 0.0, 0, 0, 1),
    (8, 0.0, 3, 1.0, 120, 0.0, 0, 0, 1), (3, 0.0, 100, 0.0, 120, 0.0, 0, 0, 1), (40, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    (150, 0.2, 20, 0.0, 4, 1.0, 0, 0, 1), (18, 0.0, 60, 0.0, 30, 0.0, 0, 0, 1), (2, 0.0, 50, 0.0, 35, 0.0, 0, 0, 1),
    (30, 0.0, 4, 1.0, 2, 1.0, 0, 0, 1), (16, 0.0, 0, 0.0, 25, 0.0, 0, 0, 1), (6, 0.0, 0, 0.0, 28, 0.0, 0, 0, 1),
    # the same pages: links, labels between links, a last line
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (6, 0.5, 2, 1.0, 3, 1.0, 0, 0, 0), (4, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0),
    (10, 0.8, 60, 0.0, 5, 1.0, 0, 0, 0), (7, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0), (3, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0),
    (25, 0.9, 4, 1.0, 6, 1.0, 0, 0, 0), (2, 0.0, 5, 0.0, 3, 0.0, 0, 0, 0), (5, 1.0, 40, 0.0, 60, 0.0, 0, 0, 0),
    (3, 1.0, 4, 1.0, 120, 0.0, 0, 0, 0), (60, 0.8, 3, 1.0, 2, 1.0, 0, 0, 0), (4, 0.0, 8, 1.0, 3, 0.0, 0, 0, 0),
]
MAX_DEPTH = 8


def train_tree(table: list[tuple], max_depth: int = MAX_DEPTH) -> list[tuple]:
    """Classification tree by Gini impurity: nodes (feature, threshold, left, right, label), leaves with feature -1."""
    data = np.array(table, dtype=float)
    nodes: list[tuple] = []

    def impurity(y):
        p = y.mean() if len(y) else 0.0
        return len(y) * 2 * p * (1 - p)

    def grow(x, y, depth):
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0, int(2 * y.sum() >= len(y))))
        if depth == max_depth or y.min() == y.max():
            return at
        best = None
        for feature in [6, 7, 1, 0, 3, 5, 2, 4]:  # among equal splits, what a block is goes before what is near it
            values = np.unique(x[:, feature])
            for low, high in zip(values, values[1:]):
                left = x[:, feature] <= (low + high) / 2
                cost = impurity(y[left]) + impurity(y[~left])
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, feature, (low + high) / 2, left)
        if best is None:
            return at
        _, feature, threshold, left = best
        a = grow(x[left], y[left], depth + 1)
        b = grow(x[~left], y[~left], depth + 1)
        nodes[at] = (feature, threshold, a, b, nodes[at][4])
        return at

    grow(data[:, :-1], data[:, -1], 0)
    return nodes


def predict(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), dtype=np.int64)
    feature, threshold, left, right, label = (np.array(c) for c in zip(*nodes))
    while (open_ := feature[at] >= 0).any():
        rows = np.flatnonzero(open_)
        node = at[rows]
        at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
    return label[at].astype(bool)


NAMED, HIDDEN = 1, 2


def marked(tag: str, attributes: str) -> int:
    """Whether class, id or role name furniture (``NAMED``), or the element is ``HIDDEN``."""
    if not attributes or tag in ("html", "body", "main"):
        return 0
    values = {}
    for name, *given in ATTRIBUTE.findall(attributes):
        values.setdefault(name.lower(), "".join(given))
    if "hidden" in values or values.get("aria-hidden", "").strip().lower() == "true" or UNSEEN.search(values.get("style", "")):
        return HIDDEN
    own_id = values.get("id", "")
    if tag not in NAMED_BY_ID or tag == "section" and len(PARTS.findall(own_id)) > 1:  # an id such as search-algorithms is a subject
        own_id = ""
    names = f"{values.get('class', '')} {values.get('role', '')} {own_id}"
    for name in names.split():
        parts = [p.lower() for p in PARTS.findall(name)]
        for at, part in enumerate(parts):
            if part in _ABOUT:
                break
            if part not in _FURNITURE or part == "header" and at and parts[at - 1] in OWN_HEADING:
                continue
            if tag not in OF_TEXT or at in (0, len(parts) - 1):
                return NAMED
    return 0


def furniture_of(found: list[tuple], marks: list[tuple[int, int]]) -> list[int]:
    """0 or 1 for each mark: whether what stands in it is furniture.

    ``marks`` has (parent, kind) of each marked element, and of each article element with kind 0; mark 0 is the page.  An
    element that is named like furniture but holds the article, such as a layout named by its sidebar, is none.
    """
    if not any(kind for _, kind in marks):
        return [0] * len(marks)
    own, paragraphs, article = ([0] * len(marks) for _ in range(3))
    for _, words, linked, area, mark in found:
        if area >= 0:
            own[mark] += words - linked
            if words - linked >= PARAGRAPH_WORDS:
                paragraphs[mark] += words - linked
    held = own.copy()
    for m in range(len(marks) - 1, 0, -1):
        parent, kind = marks[m]
        if kind == HIDDEN:
            continue
        held[parent] += held[m]
        if kind == 0:
            article[m] = held[m]
        article[parent] += article[m]
        if kind == 0:  # belongs to the element around it
            paragraphs[parent] += paragraphs[m]
    # the nearest marked element around each mark
    around, inside = [0] * len(marks), {}
    for m in range(1, len(marks)):
        parent = marks[m][0]
        around[m] = parent if marks[parent][1] else around[parent]
        if marks[m][1]:
            inside.setdefault(around[m], []).append(m)
    in_article = [0] * len(marks)  # words of articles outside the marks in them
    below = own.copy()
    for m in range(len(marks) - 1, 0, -1):
        if marks[m][1] == 0:
            below[marks[m][0]] += below[m]
            if marks[marks[m][0]][1] or marks[m][0] == 0:
                in_article[around[m]] += below[m]
    lifted, free, free_article = {0}, paragraphs[0], in_article[0]
    waiting = [(-held[m], m) for m in inside.get(0, ()) if marks[m][1] == NAMED]
    heapq.heapify(waiting)
    while waiting:
        words, m = heapq.heappop(waiting)
        with_article = article[m] and not free_article
        if with_article:
            if -words <= HELD_WITH_ARTICLE * free:
                continue
        elif -words < PARAGRAPH_WORDS or -words <= HELD_WITHOUT * max(free, free_article):
            continue
        lifted.add(m)
        free += paragraphs[m]
        free_article += in_article[m]
        for n in inside.get(m, ()):
            if marks[n][1] == NAMED:
                heapq.heappush(waiting, (-held[n], n))
    out = [0]
    for m in range(1, len(marks)):
        out.append(int(out[marks[m][0]] or (marks[m][1] and m not in lifted)))
    return out


_ABOUT = frozenset(ABOUT)
_FURNITURE, _VOID, _INLINE = frozenset(FURNITURE), frozenset(VOID), frozenset(INLINE)
_OUT, _IN = frozenset(AREAS_OUT), frozenset(AREAS_IN)
#: Elements that end when the next of their kind begins.
_SELF_ENDING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                "th": ("td", "th"), "option": ("option",)}


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """Flat blocks in page order: (text, words, words in links, area, furniture)."""
    out, text = [], []
    stack: list[tuple[str, int, int]] = []  # tag, area, mark
    marks = [(0, 0)]
    area = mark = in_link = 0
    at = 0
    link_words = 0

    def flush():
        nonlocal link_words
        words = html.unescape("".join(text)).split() if text else []
        if words:
            out.append((" ".join(words), len(words), min(link_words, len(words)), area, mark))
        text.clear()
        link_words = 0

    def add(piece):
        nonlocal link_words
        if piece:
            text.append(piece)
            if in_link:
                link_words += len(html.unescape(piece).split())

    for m in TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag == "a":
            in_link = 0 if closing else int("href" in attributes.lower())
        if tag in _VOID:
            if tag in ("br", "hr"):
                text.append("\n")
            continue
        if closing:
            if tag not in _INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in _INLINE:
                        flush()
                    del stack[i:]
                    break
                if tag in _INLINE and stack[i][0] not in _INLINE:
                    break
        else:
            own = marked(tag, attributes)
            if tag in _INLINE and not own:
                continue
            flush()
            if ends := _SELF_ENDING.get(tag):
                while stack and (stack[-1][0] in ends or stack[-1][0] in _INLINE):
                    stack.pop()
            area, mark = stack[-1][1:] if stack else (0, 0)
            if tag in _OUT and not (tag == "header" and area == 1):
                area = -1
            elif tag in _IN:
                area = 1
            if own or tag in _IN:
                marks.append((mark, own))
                mark = len(marks) - 1
            stack.append((tag, area, mark))
        area, mark = stack[-1][1:] if stack else (0, 0)
    add(page[at:])
    flush()
    furniture = furniture_of(out, marks)
    return [(*b[:4], furniture[b[4]]) for b in out]


def features(found: list[tuple]) -> np.ndarray:
    words = np.array([b[1] for b in found], dtype=float)
    density = np.array([b[2] / b[1] for b in found])
    zero = np.zeros(1)
    return np.column_stack([words, density, np.r_[zero, words[:-1]], np.r_[zero, density[:-1]], np.r_[words[1:], zero],
                            np.r_[density[1:], zero], [b[3] for b in found], [b[4] for b in found]])


def main_text(page: str, nodes: list[tuple]) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = predict(nodes, features(found))
    return " ".join(b[0] for b, k in zip(found, keep) if k)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            labelled: list[tuple] | None = None) -> DataFrame:
    """One row per input row: ``id_col, url, text string, n_chars long``.

    Character references are decoded, white space inside a block becomes one space, and the blocks of the
    article are joined by one space in page order.  A null or empty page, and one without an article,
    gives the empty text.  Pages of any length are read whole, and broken markup is read as far as it goes.
    Repeated rows give repeated rows; an empty table gives none; other columns are not read.
    """
    nodes = train_tree(labelled or LABELLED)
    source = df.select(key(id_col, "id"), key(url_col, "url").cast("string").alias("url"), F.coalesce(key(html_col), F.lit("")).alias("html"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py(), nodes) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [id_col, url_col, "text", "n_chars"])

    return map_batches(source, run, f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars long")
