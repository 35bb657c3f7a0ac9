"""Main text of web pages by line-block distribution.

The markup is stripped to lines, one for each block of text; parts that are no content (menus,
forms, scripts, notices, ...) leave lines of length zero. The lengths are summed over sliding
windows of lines. Where the sums rise from zero the text surges, where they fall to zero again it
dives; the stretch between them with the most text is the main text. If that stretch lies in an
article or main element, it is widened to the whole element, so that short blocks at its ends stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3  # lines of a sliding window

#: Fixed lists of HTML element names and of words in class, id and role attributes.
RAW = frozenset("script style noscript template textarea title iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset(
    "nav footer aside form button select option datalist dialog menu svg math object canvas audio video head map".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "alert popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus reply "
    "replies respond share sharing social related recommended newsletter subscribe subscription signup login search widget "
    "pagination pager toolbar contentinfo complementary dialog".split()
)
CONTENT = ("article", "main")

# A quote that is never closed ends at the tag's end; values longer than 4000 may hold no < or >.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]{0,4000}+\"|'[^']{0,4000}+')*+|[^<>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _hinted(attributes: str) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        if HINTS.intersection(w.lower() for w in _WORD.findall(m[1] or m[2] or m[3] or "")):
            return True
    return False


def _tokens(page: str) -> tuple[list[tuple[int, int, str, bool, str]], dict[int, int]]:
    """Tags (start, end, name, closing, attributes) and, for each that is closed, its end tag.

    A comment has no name. A raw element is one token up to its end tag, named ``#`` and its name.
    """
    tokens: list[tuple[int, int, str, bool, str]] = []
    open_: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    at = 0
    while m := _TOKEN.search(page, at):
        at, tag = m.end(), (m[2] or "").lower()
        if tag in RAW and not m[1] and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            tokens.append((m.start(), at, f"#{tag}", False, ""))
            continue
        if m[1] and open_.get(tag):
            ends[open_[tag].pop()] = len(tokens)
        elif tag and not m[1] and tag not in VOID:
            open_.setdefault(tag, []).append(len(tokens))
        tokens.append((m.start(), at, tag, bool(m[1]), m[3] or ""))
    return tokens, ends


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """Lines of text and the number of the content element each is in (0: none).

    A part that is no content gives an empty line; of one that is never closed, only its start tag
    is left out.
    """
    lines, where, text = [], [], []
    inside, elements, open_tags = 0, 0, []

    def close() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                lines.append(line)
                where.append(inside)

    def gap() -> None:
        close()
        lines.append("")
        where.append(inside)

    tokens, ends = _tokens(page)
    at = k = 0
    while k < len(tokens):
        start, end, tag, closing, attributes = tokens[k]
        if start > at:
            text.append(page[at:start])
        at, k = end, k + 1
        if not tag:
            continue
        if tag[0] == "#":
            gap() if tag != "#title" else close()
        elif tag in VOID:
            if tag == "hr":
                close()
            else:
                text.append(" ")
        elif closing:
            if tag in BLOCKS:
                close()
            if tag in CONTENT and tag in (t for t, _ in open_tags):
                while open_tags:
                    t, inside = open_tags.pop()
                    if t == tag:
                        break
        elif tag in BOILERPLATE or (tag == "header" and not inside) or (tag not in ("html", "body", "main") and _hinted(attributes)):
            gap()
            if (last := ends.get(k - 1)) is not None:
                at, k = tokens[last][1], last + 1
        else:
            if tag in BLOCKS:
                close()
            if tag in CONTENT:
                open_tags.append((tag, inside))
                if not inside:
                    elements += 1
                    inside = elements
    text.append(page[at:])
    close()
    return lines, where


def main_text(page: str | None, window: int = WINDOW) -> str:
    lines, where = lines_of(page or "")
    lengths = np.array([len(x) for x in lines], np.int64)
    if not lengths.any():
        return ""
    total = np.concatenate([[0], np.cumsum(lengths)])
    sums = total[np.minimum(np.arange(len(lengths)) + window, len(lengths))] - total[:-1]
    # Surge and dive points: a stretch ends where a whole window holds no text.
    dense = np.concatenate([[False], sums > 0, [False]])
    surges, dives = np.flatnonzero(dense[1:] & ~dense[:-1]), np.flatnonzero(~dense[1:] & dense[:-1])
    held = np.array(where)
    content = np.flatnonzero(held > 0)
    # Text in an article or main element outweighs text outside of any.
    weight = np.concatenate([[0], np.cumsum(lengths * (1 + (held > 0) * lengths.sum()))])
    best = int(np.argmax(weight[dives] - weight[surges]))
    low, high = int(surges[best]), int(dives[best])
    chosen = {w for w, n in zip(where[low:high], lengths[low:high], strict=True) if w and n}
    if len(content) and chosen:
        keep = [x for x, w in zip(lines, where, strict=True) if w in chosen and x]
    else:
        keep = [x for x in lines[low:high] if x]
    return "\n".join(keep)


def extract_text(pages: DataFrame, html_col: str = "html", window: int = WINDOW) -> DataFrame:
    """``pages`` with ``html_col`` replaced by ``text`` and ``n_chars`` (its code points).

    White space inside a block, line breaks included, becomes one space; blocks are joined by one
    newline in page order; character references are decoded. Null and empty pages give an empty
    text, rows stay as they are and as often as they are; ``text`` and ``n_chars`` columns of the
    input are replaced.
    """
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    given = pages.select(*keep, F.col(html_col).cast("string").alias("text"))
    schema = pa.schema([("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), window) for x in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array(texts, schema.field(0).type), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{kinds}, text string, n_chars long" if kinds else "text string, n_chars long")
