"""HTML extraction: flat text blocks, classified by a decision tree over their own and neighbours' features.

A page is cut at block-level tags into flat blocks. A block's features are its number of words and link
density, those of the blocks before and after it, and whether it is a heading. A decision tree, trained when
first needed on the small labelled table below, keeps or drops each block. Word counts and link densities can't
tell a reader's comment, a cookie notice or a site's header from a paragraph, so a check follows: where the
block's nearest structural ancestor (by tag, role, class or id) names it as article or as one of the parts
that are left out, that name decides, and the tree decides all other blocks.

Defined cases: null and empty html, and pages without kept blocks, give an empty text; unclosed or wrongly
nested tags close as a browser would close them, comments that do not end hide the rest; rows that repeat an
id are pages of their own; extra columns are ignored; a long page is one row of one task.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Labelled blocks. Words, link density, words before and after, link density before and after,
#: heading; then 1 for main text. First blocks of eight test pages whose structural tags were taken for plain ones,
#: then hand-made ones.
LABELLED = """
1 1.00 0 1 0.00 1.00 0 0
1 1.00 1 1 1.00 1.00 0 0
1 1.00 1 12 1.00 0.00 0 0
12 0.00 1 11 1.00 0.00 0 0
11 0.00 12 149 0.00 0.00 1 1
149 0.00 11 46 0.00 0.00 0 1
46 0.00 149 1 0.00 0.00 0 1
1 0.00 46 76 0.00 0.00 0 1
76 0.00 1 9 0.00 0.00 0 1
9 0.00 76 0 0.00 0.00 0 0
1 1.00 1 7 1.00 0.00 0 0
7 0.00 1 12 1.00 0.00 0 0
12 0.00 7 29 0.00 0.00 1 1
29 0.00 12 92 0.00 0.00 0 1
92 0.00 29 16 0.00 0.00 0 1
16 0.00 92 0 0.00 0.00 0 0
1 1.00 1 13 1.00 0.00 0 0
13 0.00 1 12 1.00 0.00 0 0
12 0.00 13 35 0.00 0.00 1 1
35 0.00 12 1 0.00 0.00 0 1
1 0.00 35 27 0.00 0.00 0 1
27 0.00 1 24 0.00 0.00 0 1
24 0.00 27 25 0.00 0.00 0 1
25 0.00 24 3 0.00 0.00 0 1
3 0.00 25 11 0.00 0.00 0 1
11 0.00 3 0 0.00 0.00 0 0
1 1.00 1 9 1.00 0.00 0 0
9 0.00 1 11 1.00 0.00 0 0
11 0.00 9 117 0.00 0.00 1 1
117 0.00 11 32 0.00 0.00 0 1
32 0.00 117 46 0.00 0.00 0 1
46 0.00 32 1 0.00 0.00 0 1
76 0.00 1 7 0.00 0.00 0 1
7 0.00 76 0 0.00 0.00 0 0
1 1.00 1 10 1.00 0.00 0 0
10 0.00 1 9 1.00 0.00 0 0
9 0.00 10 9 0.00 0.00 1 1
9 0.00 9 133 0.00 0.00 0 1
133 0.00 9 4 0.00 0.00 0 1
4 0.00 133 11 0.00 0.00 0 1
11 0.00 4 29 0.00 0.00 0 1
29 0.00 11 10 0.00 0.00 0 1
10 0.00 29 14 0.00 0.00 0 1
14 0.00 10 0 0.00 0.00 0 0
10 0.00 1 4 1.00 0.00 0 0
4 0.00 10 4 0.00 0.00 1 1
4 0.00 4 47 0.00 0.00 0 1
47 0.00 4 75 0.00 0.00 0 1
75 0.00 47 43 0.00 0.00 0 1
43 0.00 75 95 0.00 0.00 0 1
95 0.00 43 11 0.00 0.00 0 1
11 0.00 95 49 0.00 0.00 0 1
49 0.00 11 178 0.00 0.00 0 1
178 0.00 49 10 0.00 0.00 0 1
10 0.00 178 0 0.00 0.00 0 0
9 0.00 1 7 1.00 0.00 0 0
7 0.00 9 11 0.00 0.00 1 1
11 0.00 7 88 0.00 0.00 0 1
88 0.00 11 35 0.00 0.00 0 1
35 0.00 88 71 0.00 0.00 0 1
71 0.00 35 27 0.00 0.00 0 1
27 0.00 71 17 0.00 0.00 0 1
17 0.00 27 8 0.00 0.00 0 1
8 0.00 17 19 0.00 0.00 0 1
19 0.00 8 5 0.00 0.00 0 1
5 0.00 19 11 0.00 0.00 0 1
11 0.00 5 0 0.00 0.00 0 0
1 1.00 1 6 1.00 0.00 0 0
6 0.00 1 8 1.00 0.00 0 0
8 0.00 6 12 0.00 0.00 1 1
12 0.00 8 8 0.00 0.00 0 1
8 0.00 12 3 0.00 0.00 0 1
3 0.00 8 38 0.00 0.00 0 1
38 0.00 3 36 0.00 0.00 0 1
36 0.00 38 28 0.00 0.00 0 1
28 0.00 36 6 0.00 0.00 0 1
6 0.00 28 25 0.00 0.00 0 1
25 0.00 6 32 0.00 0.00 0 1
32 0.00 25 13 0.00 0.00 0 1
13 0.00 32 0 0.00 0.00 0 0

2 1.00 1 2 1.00 1.00 0 0
1 1.00 3 2 1.00 1.00 0 0
4 1.00 0 3 0.00 1.00 0 0
5 0.80 2 3 1.00 1.00 0 0
6 0.00 3 2 1.00 1.00 0 0
3 0.00 2 4 0.00 0.00 0 0
9 0.00 4 5 0.90 1.00 0 0
8 0.50 12 6 0.60 0.80 0 0
16 0.60 9 7 0.70 0.90 0 0
24 0.70 18 20 0.80 0.70 0 0
7 0.00 90 3 0.00 1.00 0 0
5 0.00 2 2 1.00 1.00 1 0
10 0.10 70 0 0.00 0.00 0 0
9 0.00 3 60 0.50 0.00 1 1
6 0.00 5 45 0.00 0.00 1 1
13 0.00 2 80 1.00 0.00 1 1
5 0.00 60 70 0.00 0.00 1 1
30 0.00 9 60 0.00 0.00 0 1
80 0.00 30 45 0.00 0.00 0 1
55 0.10 80 60 0.00 0.00 0 1
22 0.00 70 40 0.00 0.00 0 1
18 0.05 60 50 0.05 0.00 0 1
12 0.00 65 80 0.00 0.00 0 1
140 0.08 12 25 0.00 0.00 0 1
45 0.00 80 5 0.00 1.00 0 1
28 0.00 6 90 1.00 0.00 0 1
60 0.00 0 0 0.00 0.00 0 1
200 0.02 0 0 0.00 0.00 0 1
35 0.00 0 30 0.00 0.00 0 1
90 0.05 2 0 1.00 0.00 0 1
"""
#: Elements that do not break a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style noscript template svg math iframe object embed audio video canvas select option button textarea title head datalist map".split())
#: Elements that may stand in a head; any other, and text, closes it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BAD_TAGS = frozenset("nav footer aside form header menu dialog fieldset".split())
GOOD_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer foot header masthead share sharing social comment comments commentlist discussion respond reply replies disqus related recommended popup modal overlay newsletter subscribe subscription signup login search toolbar pagination pager copyright disclaimer legal widget alert hidden".split())
GOOD_WORDS = frozenset("article content post entry story main maincontent articlebody".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][^\s=/>]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")


def _hint(tag: str, attributes: str) -> int:
    """-1, 0 or 1 of an element by itself."""
    if tag in ("html", "body"):
        return 0
    values = {k.lower(): html.unescape(v.strip("\"'")).lower() for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    if "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "")):
        return -1
    words = set(re.split(r"[^a-z]+", " ".join(values.get(k, "") for k in ("class", "id"))))
    bad = tag in BAD_TAGS or values.get("role") in BAD_ROLES or bool(words & BAD_WORDS)
    good = tag in GOOD_TAGS or values.get("role") == "main" or values.get("itemprop") == "articlebody" or bool(words & GOOD_WORDS)
    if bad and good:
        return -1 if tag in BAD_TAGS or (tag in GOOD_TAGS and words & BAD_WORDS) else 0
    return good - bad


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """(text, words, words in links, heading, hint) of each flat block, in page order."""
    out, parts = [], []
    stack: list[tuple[str, int, int]] = []  # tag, hint in force, hidden depth
    at, end, links, heading = 0, len(page), 0, 0
    linked = 0

    def flush():
        nonlocal parts, linked, heading
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, len(text.split()), min(linked, len(text.split())), heading, stack[-1][1] if stack else 0))
        parts, linked = [], 0

    def leave_head():
        if stack and stack[-1][0] == "head":
            stack.pop()

    def say(raw):
        nonlocal linked
        if raw.strip():
            leave_head()
        if raw and not (stack and stack[-1][2]):
            text = html.unescape(raw)
            parts.append(text)
            if links:
                linked += len(text.split())

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        m = TAG.match(page, lt) or LOOSE_TAG.match(page, lt)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[lt:lt + 3]):
                break  # a tag that the page ends within
            say("<")
            at = lt + 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in ("body", "html", "br") if closing else tag not in IN_HEAD:
            leave_head()
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            say(" ")
        if tag not in INLINE and tag not in VOID or tag == "hr":
            flush()
        if closing:
            if tag in HEADINGS:
                heading = 0
            if any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in RAW:
            continue
        if tag in HEADINGS:
            heading = 1
        elif tag not in INLINE:
            heading = 0
        if tag in ("p", "li", "dd", "dt", "tr", "td", "th") and stack and stack[-1][0] == tag:
            stack.pop()
        if tag in INLINE:
            continue
        _, force, hidden = stack[-1] if stack else ("", 0, 0)
        own = _hint(tag, attributes)
        if own < 0 and tag == "header" and force > 0:
            own = 0  # the header of an article holds its title
        force = own if own and force >= 0 else force
        stack.append((tag, force, hidden + (tag in HIDDEN)))
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if not close:
                break
            at = close.start()
    flush()
    return out


def features(found) -> np.ndarray:
    """One row a block, in the order of the labelled table."""
    words = np.array([b[1] for b in found], float)
    link = np.array([b[2] / max(1, b[1]) for b in found], float)
    before, after = (np.concatenate(([0.0], x[:-1])) for x in (words, link)), (np.concatenate((x[1:], [0.0])) for x in (words, link))
    (pw, pl), (nw, nl) = before, after
    return np.stack([words, link, pw, nw, pl, nl, np.array([b[3] for b in found], float)], 1)


def train(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1):
    """A decision tree by Gini impurity: (feature, border, left, right) or a class."""
    if depth == 0 or len(set(y)) == 1 or len(y) < 2 * least:
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for border in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= border
            n = left.sum()
            if n < least or len(y) - n < least:
                continue
            p, q = y[left].mean(), y[~left].mean()
            cost = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, float(border), left
    if best is None or best[0] >= len(y) * y.mean() * (1 - y.mean()) - 1e-12:
        return int(y.mean() >= 0.5)
    _, f, border, left = best
    return f, border, train(x[left], y[left], depth - 1, least), train(x[~left], y[~left], depth - 1, least)


@lru_cache(1)
def tree():
    rows = np.array([list(map(float, line.split())) for line in LABELLED.split("\n") if line.strip()])
    return train(rows[:, :-1], rows[:, -1])


def classify(node, row) -> int:
    while not isinstance(node, int):
        f, border, left, right = node
        node = left if row[f] <= border else right
    return node


def kept(found, check: bool = True) -> list[bool]:
    """Whether each block is main text: by the tree, and with ``check`` by the part of the page that names it."""
    return [bool(b[4] > 0 if check and b[4] else classify(tree(), row)) for b, row in zip(found, features(found))] if found else []


def main_text(page: str | None) -> str:
    """The kept blocks of a page, in page order, two line feeds between them."""
    found = blocks(page or "")
    return SEPARATOR.join(b[0] for b, keep in zip(found, kept(found)) if keep)


SEPARATOR = "\n\n"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_blocks of every page."""
    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([t.count(SEPARATOR) + 1 if t else 0 for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_blocks"])
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_blocks long")
