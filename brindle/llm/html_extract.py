"""HTML extraction: flat text blocks, told apart by a decision tree.

A page is cut into flat blocks at block-level tags. Each block has its number of words and its link
density (the share of words inside links), those of the block before and of the block after it, and
three marks: it is a heading; it is loose (stands in no paragraph, list item, cell or the like); it
stands in an element that HTML sets beside the text (nav, aside, footer, form, menu, dialog, a
header outside of the article) or in one whose class, id or role says reader comments, side bar,
or notice. A decision tree (Gini, grown on the small labelled table below) says which blocks
are main text. It may not ask whether a page has an article element.

Scripts, styles, forms' controls, comments and markup never make blocks. Character references are
decoded, white space inside a block (line breaks included) is one space.

Edge cases: null and empty html give empty text; unclosed and stray tags, cut-off pages and
unknown references are taken as they stand; very long and deeply nested pages are used whole, in
time linear in their length; repeated rows give the same text; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brindle.functions.shipping import ship
from brindle.llm.common import sliced, table

# Fixed values of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style title textarea xmp iframe noembed noframes".split())
SKIP_TAGS = frozenset("head noscript template svg math select button datalist object audio video canvas".split())
BESIDE_TAGS = frozenset("nav header footer aside form menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is set as text: what stands in none of them is loose.
TEXT_TAGS = HEADINGS | frozenset("p li td th dd dt blockquote pre figcaption caption legend address summary".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names (in class, id or role) of what HTML has no element for.
BESIDE_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|replies|respond|side-?bar|cookies?|consent|notices?|newsletter|share|related)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_MARK = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW_TAGS}


class Block(NamedTuple):
    text: str
    words: int
    density: float
    heading: int
    loose: int
    beside: int


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order."""
    out: list[Block] = []
    #: open containers (tag, beside the text, in content, skipped), and how many there are of each tag
    stack: list[tuple[str, int, int, int]] = []
    open_: dict[str, int] = {}
    chunks: list[tuple[str, bool]] = []
    links = heading = text_tag = 0
    pos, end = 0, len(page)

    def flush() -> None:
        if chunks:
            text = _SPACE.sub(" ", "".join(c for c, _ in chunks)).strip()
            if text:
                words = text.count(" ") + 1
                linked = sum(len(c.split()) for c, in_link in chunks if in_link)
                out.append(Block(text, words, min(1.0, linked / words), heading, 1 - text_tag, stack[-1][1] if stack else 0))
            chunks.clear()

    def add(raw: str) -> None:
        if raw and not (stack and stack[-1][3]):
            chunks.append((references.unescape(raw), links > 0))

    while pos < end:
        at = page.find("<", pos)
        if at < 0:
            add(page[pos:])
            break
        m = _TOKEN.match(page, at)
        if at > pos:
            add(page[pos:at])
        if m is None:
            add("<")
            pos = at + 1
            continue
        pos = m.end()
        if m[2] is None:
            continue
        closing, tag = m[1] == "/", m[2].lower()
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            add(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
            heading = int(tag in HEADINGS and not closing)
            text_tag = int(tag in TEXT_TAGS and not closing)
            if tag in ("p", "li", "div", "section", "article"):
                links = 0
        if tag in RAW_TAGS and not closing:
            stop = _RAW_END[tag].search(page, pos)
            pos = stop.start() if stop else end
            continue
        if tag in VOID_TAGS or tag in ("p", "html", "body") or not (block or tag in SKIP_TAGS):
            continue
        if closing:
            # every container that is passed over is closed, so all closing tags together are linear
            while open_.get(tag):
                last = stack.pop()[0]
                open_[last] -= 1
                if last == tag:
                    break
            continue
        _, beside, content, skipped = stack[-1] if stack else ("", 0, 0, 0)
        named = bool(m[3]) and any(BESIDE_NAMES.search(_CAMEL.sub("-", x[1] or x[2] or x[3])) for x in _MARK.findall(m[3]))
        if tag in CONTENT_TAGS and not named:
            content = 1
        elif named or tag in BESIDE_TAGS and not (tag == "header" and content):
            beside = 1
        stack.append((tag, beside, content, int(skipped or tag in SKIP_TAGS)))
        open_[tag] = open_.get(tag, 0) + 1
    flush()
    return out


COLUMNS = ("words", "density", "words before", "density before", "words after", "density after", "heading", "loose", "beside")


def feature_table(found: list[Block]) -> np.ndarray:
    """One row of COLUMNS per block; before the first and after the last block stands nothing."""
    own = np.array([(b.words, b.density) for b in found], dtype=float).reshape(len(found), 2)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    marks = np.array([(b.heading, b.loose, b.beside) for b in found], dtype=float).reshape(len(found), 3)
    return np.concatenate([own, before, after, marks], axis=1)


#: The labelled table: COLUMNS, then 1 for main text; blocks read off real pages and judged by hand.
#: Most stand in pages without telling elements, so that words and links must decide.
LABELLED = np.array(
    [
        # headings: after an advert, after a menu, between paragraphs
        (9, 0, 8, 0, 18, 0, 1, 0, 0, 1), (5, 0, 4, 0, 5, 0, 1, 0, 0, 1), (1, 0, 13, 0, 104, 0, 1, 0, 0, 1), (6, 0, 1, 1, 40, 0, 1, 0, 0, 1), (12, 0, 2, 1, 9, 0, 1, 0, 0, 1),
        (3, 0, 80, 0, 60, 0, 1, 0, 0, 1), (2, 0, 22, 0, 4, 0, 1, 0, 0, 1), (24, 0, 3, 0, 282, 0, 1, 0, 0, 1), (1, 0, 5, 0.9, 6, 0, 1, 0, 0, 1), (7, 0, 0, 0, 35, 0, 1, 0, 0, 1),
        # paragraphs of all lengths beside others
        (26, 0, 22, 0, 22, 0, 0, 0, 0, 1), (97, 0, 93, 0, 92, 0, 0, 0, 0, 1), (3, 0, 3, 0, 3, 0, 0, 0, 0, 1), (1, 0, 1, 0, 1, 0, 0, 0, 0, 1), (1, 0, 26, 0, 40, 0, 0, 0, 0, 1),
        (208, 0, 9, 0, 1, 0, 0, 0, 0, 1), (2, 0, 14, 0, 75, 0, 0, 0, 0, 1), (48, 0, 79, 0, 12, 0, 0, 0, 0, 1), (9, 0, 48, 0, 11, 0, 0, 0, 0, 1), (1, 0, 2, 0, 16, 0, 0, 0, 0, 1),
        (45, 0.2, 80, 0, 70, 0.1, 0, 0, 0, 1), (30, 0.35, 12, 0, 44, 0.2, 0, 0, 0, 1), (12, 0.4, 33, 0, 8, 0, 0, 0, 0, 1), (6, 0, 3, 0, 20, 0.3, 0, 0, 0, 1), (150, 0.05, 4, 0, 60, 0, 0, 0, 0, 1),
        # the first after a menu, the last before links or at the page's end, a page's only one
        (60, 0, 1, 1, 45, 0, 0, 0, 0, 1), (24, 0, 4, 1, 30, 0, 0, 0, 0, 1), (35, 0, 2, 1, 7, 0, 0, 1, 0, 1), (110, 0.1, 1, 1, 80, 0, 0, 1, 0, 1), (40, 0, 50, 0, 3, 1, 0, 0, 0, 1),
        (9, 0, 60, 0, 2, 1, 0, 0, 0, 1), (5, 0, 26, 0, 0, 0, 0, 0, 0, 1), (26, 0, 30, 0, 0, 0, 0, 0, 0, 1), (70, 0, 41, 0, 0, 0, 0, 1, 0, 1), (15, 0, 0, 0, 0, 0, 0, 0, 0, 1), (22, 0, 0, 0, 0, 0, 0, 1, 0, 1),
        # paragraphs of pages that are all divisions
        (60, 0, 45, 0, 70, 0, 0, 1, 0, 1), (25, 0, 60, 0, 40, 0, 0, 1, 0, 1), (33, 0, 7, 0, 28, 0, 0, 1, 0, 1), (11, 0, 50, 0, 44, 0, 0, 1, 0, 1), (18, 0.1, 29, 0, 90, 0, 0, 1, 0, 1),
        (90, 0, 12, 0, 5, 1, 0, 1, 0, 1), (9, 0, 33, 0, 61, 0, 0, 1, 0, 1), (8, 0, 12, 0, 26, 0, 0, 1, 0, 1), (14, 0, 70, 0, 21, 0, 0, 1, 0, 1), (10, 0, 0, 0, 55, 0, 0, 1, 0, 1),
        # menus and lists of links
        (1, 1, 1, 1, 1, 1, 0, 0, 0, 0), (1, 1, 0, 0, 1, 1, 0, 0, 1, 0), (1, 1, 1, 1, 8, 0, 0, 0, 0, 0), (3, 1, 2, 1, 4, 1, 0, 0, 0, 0), (2, 1, 5, 1, 1, 1, 0, 1, 0, 0),
        (5, 0.8, 4, 1, 60, 0, 0, 1, 0, 0), (6, 1, 7, 1, 50, 0, 0, 0, 1, 0), (4, 0.9, 60, 0, 5, 1, 0, 0, 0, 0), (20, 0.9, 15, 0.9, 18, 0.95, 0, 0, 0, 0), (2, 1, 90, 0, 3, 1, 0, 0, 0, 0),
        (8, 1, 70, 0, 0, 0, 0, 0, 0, 0), (1, 1, 13, 0, 1, 1, 0, 1, 1, 0), (12, 0.7, 3, 1, 2, 1, 0, 0, 0, 0), (1, 1, 1, 1, 13, 0, 0, 0, 1, 0), (10, 0.6, 1, 1, 9, 0.8, 0, 1, 0, 0),
        # adverts and lines between links and text
        (8, 0, 1, 1, 9, 0, 0, 1, 0, 0), (12, 0, 1, 1, 12, 0, 0, 1, 0, 0), (4, 0, 1, 1, 6, 0, 0, 1, 0, 0), (13, 0, 1, 1, 5, 0, 0, 1, 0, 0), (6, 0, 1, 1, 24, 0, 0, 0, 0, 0),
        (3, 0, 2, 1, 40, 0, 0, 0, 0, 0), (10, 0, 3, 0.9, 1, 0, 0, 0, 0, 0), (2, 0, 4, 1, 90, 0, 0, 1, 0, 0), (3, 0, 2, 1, 2, 1, 0, 1, 0, 0), (6, 0.4, 3, 1, 2, 0.9, 0, 0, 0, 0),
        (2, 0, 1, 1, 3, 1, 1, 0, 0, 0), (1, 0, 4, 1, 2, 1, 1, 0, 0, 0), (4, 0, 5, 0.9, 6, 1, 1, 0, 0, 0),
        # adverts inside of the text, what a page ends with
        (1, 0, 6, 0, 1, 0, 0, 1, 0, 0), (3, 0, 40, 0, 50, 0, 0, 1, 0, 0), (2, 0, 90, 0, 26, 0, 0, 1, 0, 0), (4, 0, 22, 0, 9, 0, 0, 1, 0, 0), (5, 0, 3, 0, 60, 0, 0, 1, 0, 0),
        (11, 0, 48, 0, 0, 0, 0, 1, 0, 0), (9, 0, 2, 0, 0, 0, 0, 1, 0, 0), (15, 0, 80, 0, 0, 0, 0, 1, 1, 0), (7, 0, 96, 0, 0, 0, 0, 1, 0, 0), (16, 0, 13, 0, 0, 0, 0, 1, 0, 0), (13, 0.2, 1, 1, 0, 0, 0, 1, 1, 0),
        # side bars, notices, forms and readers' comments, long ones too
        (60, 0, 90, 0, 40, 0.2, 0, 0, 1, 0), (28, 0, 14, 0, 22, 0, 0, 0, 1, 0), (2, 0, 50, 0, 4, 1, 1, 0, 1, 0), (25, 0, 0, 0, 6, 1, 0, 1, 1, 0), (10, 0, 2, 0, 1, 0, 0, 0, 1, 0),
        (1, 0, 30, 0, 1, 0, 0, 1, 1, 0), (150, 0, 70, 0, 30, 0, 0, 0, 1, 0), (5, 0, 26, 0, 18, 0, 1, 0, 1, 0), (40, 0, 12, 0, 55, 0, 0, 0, 1, 0), (9, 0, 60, 0, 11, 0, 0, 0, 1, 0),
    ],
    dtype=float,
)


def grow(rows: np.ndarray, depth: int = 12) -> tuple:
    """A tree (column, threshold, low branch, high branch) with leaves (verdict,), by Gini impurity."""
    label = rows[:, -1]
    share = float(label.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (int(share >= 0.5),)
    best = None
    for c in range(rows.shape[1] - 1):  # among equal splits the first column's: words and links before marks
        values = np.unique(rows[:, c])
        for t in (values[1:] + values[:-1]) / 2:
            low = rows[:, c] <= t
            cost = sum(label[s].mean() * (1 - label[s].mean()) * s.sum() for s in (low, ~low))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, c, float(t), low)
    if best is None:
        return (int(share >= 0.5),)
    _, c, t, low = best
    return (c, t, grow(rows[low], depth - 1), grow(rows[~low], depth - 1))


def judge(tree: tuple, rows: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(rows), tree[0] == 1)
    c, t, low, high = tree
    out, side = np.zeros(len(rows), dtype=bool), rows[:, c] <= t
    out[side], out[~side] = judge(low, rows[side]), judge(high, rows[~side])
    return out


def extract(page: str | None, tree: tuple) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = judge(tree, feature_table(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)
    tree = grow(LABELLED)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            text = [extract(x, tree) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select("page_id", "url", "html")
    kinds = dict(slim.dtypes)
    return slim.mapInArrow(each, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
