"""Main text of web pages by two-pass block rules.

A page is cut into blocks of text.  The first pass decides each block by where it stands (menus, headers, footers, sidebars,
notices, adverts, forms and comments are out), by its link density, its length and its stop-word density; blocks that are
too short for that, or poor in stop words inside the article, stay open.  In the second pass open blocks inherit the label
of their nearest decided neighbours, first of those in the same article, then of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# Elements of HTML by what they do to text, and words that name boilerplate in a class or an id.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("button canvas datalist head iframe noembed noframes noscript object script select style svg template textarea title xmp".split())
OUTSIDE = frozenset("aside dialog footer form header menu nav search".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
NAMES = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted recommended related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget".split()
)
#: Names that also rule out an article or a main element; others there describe the page.
INNER = frozenset("ad ads advert advertisement comment comments promo promoted related replies reply sponsored teaser".split())
ARTICLE = frozenset(["article", "main"])
#: Elements that end an open element of their own kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ol ul dl table select".split())
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not are this from at have or an had they you which one were all we "
    "de la le et les des en un une du que qui est dans pour par sur au aux avec ne se ce il elle sont pas plus "
    "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "el los las del y por con para una su al lo como más pero sus o este sí porque entre".split()
)

MAX_LINK, SHORT, LOW_STOP = 0.5, 70, 0.08
GOOD, BAD, OPEN = 1, 0, -1

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)")
_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    """A run of text between block boundaries: decoded text, code points inside links, article it stands in, element, and whether its place rules it out."""

    text: str
    link: int
    article: int
    element: str
    outside: bool


def _attributes(html: str, at: int, last_quotes: dict[str, int]) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on and the place after the tag's ``>``, or -1 if the page ends before."""
    found: dict[str, str] = {}
    n = len(html)
    while True:
        m = _ATTRIBUTE.match(html, at)
        if not m:
            end = html.find(">", at)
            return found, end + 1 if end >= 0 else -1
        at = m.end()
        k = at
        while k < n and html[k].isspace():
            k += 1
        value = ""
        if k < n and html[k] == "=":
            k += 1
            while k < n and html[k].isspace():
                k += 1
            quote = html[k] if k < n else ""
            if quote in ("'", '"') and k < last_quotes[quote]:
                end = html.index(quote, k + 1)
                value, at = html[k + 1 : end], end + 1
            else:
                end = k
                while end < n and html[end] != ">" and not html[end].isspace():
                    end += 1
                value, at = html[k:end], end
        found.setdefault(m.group(1).lower(), value)


def _rules_out(tag: str, attributes: dict[str, str]) -> bool:
    if tag in OUTSIDE or attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if tag in ("html", "body"):
        return False
    if not attributes:
        return False
    names = set(_NAME.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))
    return not names.isdisjoint(INNER if tag in ARTICLE else NAMES)


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order.  Linear in the page: each character is read a bounded number of times."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, int, bool, bool]] = []  # element, outside, article, silent, link
    articles, last_quotes, n, at = 0, {q: html.rfind(q) for q in "'\""}, len(html), 0

    def here() -> tuple[str, bool, int, bool, bool]:
        return stack[-1] if stack else ("", False, 0, False, False)

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                _, outside, article, _, _ = here()
                element = next((e for e, *_ in reversed(stack) if e in BLOCKS), "")
                out.append(Block(text, len(_SPACE.sub(" ", unescape("".join(linked))).strip()), article, element, outside))
            parts.clear()
            linked.clear()

    def pop_to(k: int) -> None:
        before = stack[k - 1][1] if k else False
        if any(e in BLOCKS or outside != before for e, outside, *_ in stack[k:]):
            flush()
        del stack[k:]

    def say(text: str) -> None:
        *_, silent, link = here()
        if not silent:
            parts.append(text)
            if link:
                linked.append(text)

    while at < n:
        nxt = html.find("<", at)
        if nxt < 0:
            nxt = n
        if nxt > at:
            say(html[at:nxt])
        at = nxt
        if at >= n:
            break
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, at)
        if not m:
            say("<")
            at += 1
            continue
        closing, tag = bool(m.group(1)), m.group(2).lower()
        attributes: dict[str, str] = {}
        at = m.end()
        if html.startswith(">", at):
            at += 1
        else:
            attributes, at = _attributes(html, at, last_quotes)
            if at < 0:
                break
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag not in BLOCKS and stack[k][0] in BLOCKS:
                    break  # an inline end tag does not reach out of its block
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCKS:
            flush()
            ends = CLOSES.get(tag, {"p"})
            for k in range(len(stack) - 1, -1, -1):
                e = stack[k][0]
                if e in ends or e == "p":
                    pop_to(k)
                    if e != "p":
                        break
                elif e in SCOPES or (e in BLOCKS and tag not in CLOSES):
                    break
        elif tag == "a":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "a":
                    pop_to(k)
                if k < len(stack) and stack[k][0] in BLOCKS:
                    break
        if tag in VOID:
            continue
        _, outside, article, silent, link = here()
        if tag in ARTICLE and not _rules_out(tag, attributes):
            # neither a menu nor a header can hold an article: one that does was never closed
            if outside and next((e for e, o, *_ in stack if o), "") in ("nav", "header"):
                outside = False
            if not article or tag == "article":
                articles += 1
                article = articles
        else:
            outside = outside or _rules_out(tag, attributes)
        if outside and not here()[1]:
            flush()  # an inline advert does not belong to the text around it
        silent = silent or tag in SILENT
        stack.append((tag, outside, article, silent, link or tag == "a"))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
            say(html[at : end.start() if end else n])
            at = end.start() if end else n
    flush()
    return out


def stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(b: Block) -> int:
    """By place, link density, length and stop-word density: good, bad, or open."""
    if b.outside:
        return BAD
    if b.link > MAX_LINK * len(b.text):
        return OPEN if b.article and b.element == "p" else BAD
    if len(b.text) < SHORT:
        return OPEN
    if stop_density(b.text) >= LOW_STOP:
        return GOOD
    return OPEN if b.article else BAD


def second_pass(page: list[Block], labels: list[int]) -> list[int]:
    """Open blocks take the label of the nearest decided block in their article; of two as near, good wins.

    An article without a decided block is the article itself, so its open blocks are good; on a page that marks no article,
    open blocks look across the whole page, and are good if nothing is decided there.
    """
    labels = list(labels)
    inside: dict[int, list[int]] = {}
    for i, b in enumerate(page):
        if not b.outside:
            inside.setdefault(b.article, []).append(i)
    marked = any(a for a in inside)
    for article, members in inside.items():
        before: list[tuple[int, int]] = []
        last = (len(page) + 1, GOOD if article or not marked else BAD)
        for i in members:  # distance to and label of the nearest decided block before
            last = (0, labels[i]) if labels[i] != OPEN else (last[0] + 1, last[1])
            before.append(last)
        nxt = (len(page) + 1, GOOD if article or not marked else BAD)
        for k in range(len(members) - 1, -1, -1):
            i = members[k]
            if labels[i] != OPEN:
                nxt = (0, labels[i])
                continue
            nxt = (nxt[0] + 1, nxt[1])
            b = before[k]
            labels[i] = max(b[1], nxt[1]) if b[0] == nxt[0] else min(b, nxt)[1]
    return labels


def main_text(html: str) -> str:
    page = blocks(html)
    labels = second_pass(page, [first_pass(b) for b in page])
    return " ".join(b.text for b, label in zip(page, labels, strict=True) if label == GOOD)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, then ``text`` (main text) and ``n_chars`` (its code points).  One narrow pass, no shuffle.

    Defined cases: null and empty html have the empty text; ids and urls, null or repeated, pass through, one row out for one
    in; broken markup (unclosed elements, tags cut off at the end, stray end tags) is read as browsers do; a very long page is
    read in linear time; other columns of ``pages`` are not read; an empty table gives no rows.
    """
    base = pages.select(*keep, text_or_empty(html_col).alias("__html"))
    types = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in keep)
    return base.mapInArrow(_extract_batches, f"{types}, text string, n_chars long")
