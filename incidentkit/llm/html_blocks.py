"""Main text of web pages by two passes of block rules.

The markup is cut into blocks, each with its text, link characters and the
kind of element around it. The first pass decides blocks by element, length,
link density and share of stop words; short and middling blocks stay open.
In the second pass an open block takes the label of its nearest decided
neighbours: the common one, else the nearer one's, and bad on a tie.

Cases: null or empty markup gives an empty text. Unclosed tags, comments and
scripts run to where a browser would end them, at worst to the end. Rows with
null ids or urls and repeated rows come back one for one.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Thresholds of the published block rules.
SHORT, LONG = 70, 200
FEW_STOPWORDS, MANY_STOPWORDS = 0.30, 0.32
MOST_LINKS = 0.2
#: Share of link characters that makes a block inside an article a list of links.
MOST_LINKS_INSIDE = 0.5

# Very common words of four languages.
STOPWORDS = frozenset(
    """
    the of and to in a is that it for as was with be by on not he his but are this at from or have an they which you we her she will one all
    has been there if who when more no would so what up out had were their its
    der die das und in zu den ist von mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer
    um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis
    le la les de des du et en un une à est que qui dans pour il elle pas au sur ne se ce plus par avec son sa ses ils aux mais ou nous vous
    cette être sont était comme
    el los las del y que en un una por con para es se no al lo como más su sus le ha me si sin sobre este ya entre cuando todo esta ser son
    dos también fue había muy
    """.split()
)
SKIPPED = frozenset("head title script style noscript template iframe object svg math canvas audio video textarea select option button".split())
BAD = frozenset("nav footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adverts?|sponsor\w*|promo\w*|banner|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side|footer|masthead|cookies?|consent|"
    r"notices?|notification|alert|popup|modal|overlay|comments?|disqus|replies|respond|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|"
    r"toolbar|widget|copyright|disclaimer|skip|pagination|pager)(?:$|[\s_-])",
    re.IGNORECASE,
)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|topbar|top)(?:$|[\s_-])", re.IGNORECASE)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story)(?:[\s_-]?(?:body|content|text))?(?:$|\s)|(?:^|\s)(?:main|main[_-]?content|content|content[_-]?main)(?:$|\s)", re.IGNORECASE)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MARKUP = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe)\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    where: str  # skip, bad, main or open
    heading: bool


def _kind(tag: str, attrs: str, inside: str) -> str:
    """Where the content of an element stands, from what it stands in."""
    if inside in ("skip", "bad") or tag in SKIPPED:
        return "skip" if tag in SKIPPED or inside == "skip" else "bad"
    if tag in BAD or tag == "header" and inside != "main":
        return "bad"
    if attrs:
        held = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attrs)}
        names = f"{held.get('class', '')} {held.get('id', '')}".strip()
        hidden = "hidden" in held or held.get("aria-hidden", "").lower() == "true" or "display:none" in held.get("style", "").replace(" ", "").lower()
        if tag not in ("html", "body"):
            if hidden or BAD_NAMES.search(names) or held.get("role", "").lower() in BAD_ROLES or HEADER_NAMES.search(names) and inside != "main" and tag not in MAIN:
                return "bad"
            if held.get("role", "").lower() == "main" or MAIN_NAMES.search(names) and tag in ("div", "section"):
                return "main"
    return "main" if tag in MAIN else inside


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements, and where their content stands
    opened: Counter = Counter()
    links = 0
    heading = False

    def close_block():
        nonlocal links, heading
        text = " ".join("".join(parts).split())
        where = stack[-1][1] if stack else "open"
        if text and where != "skip":
            out.append(Block(text, min(links, len(text)), where, heading))
        parts.clear()
        links, heading = 0, False

    def pop():
        tag, _ = stack.pop()
        opened[tag] -= 1

    def add(text: str):
        nonlocal links, heading
        if text:
            text = html.unescape(text)
            parts.append(text)
            if opened["a"]:
                links += len(text.strip())
            heading = heading or bool(stack) and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6")

    at = 0
    for m in MARKUP.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m["raw"]:
                parts.append(" ")
            continue
        inline = tag in INLINE
        if m["end"] or m["end2"]:
            if opened[tag] <= 0:
                continue
            if not inline:
                close_block()
            while stack:
                if inline and stack[-1][0] not in INLINE:
                    break
                if stack[-1][1] == "bad" and (len(stack) < 2 or stack[-2][1] != "bad"):
                    close_block()
                last = stack[-1][0]
                pop()
                if last == tag:
                    break
            continue
        inside = stack[-1][1] if stack else "open"
        if tag in VOID:
            if tag in ("br", "hr"):
                close_block() if tag == "hr" else parts.append(" ")
            continue
        kind = _kind(tag, m["attrs"] or "", inside)
        if not inline:
            close_block()
            while stack and stack[-1][0] in INLINE:
                pop()
            # These end an open element of their own kind.
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                pop()
                kind = _kind(tag, m["attrs"] or "", stack[-1][1] if stack else "open")
            elif stack and stack[-1][0] == "p":
                pop()
                kind = _kind(tag, m["attrs"] or "", stack[-1][1] if stack else "open")
        elif kind != inside:
            close_block()
        stack.append((tag, kind))
        opened[tag] += 1
    rest = page[at:]
    add(rest)
    close_block()
    return out


def first_pass(found: list[Block]) -> list[str]:
    """good, bad, or open (short, or near to good) per block."""
    framed = any(b.where == "main" for b in found)
    labels = []
    for b in found:
        size, density = len(b.text), b.links / len(b.text)
        if b.where == "bad" or framed and b.where != "main":
            labels.append("bad")
        elif b.where == "main":
            labels.append("bad" if density > MOST_LINKS_INSIDE else "good" if size > SHORT or not b.links else "open")
        elif density > MOST_LINKS or "©" in b.text:
            labels.append("bad")
        elif size < SHORT:
            labels.append("open")
        else:
            words = b.text.lower().split()
            stop = sum(w.strip(".,;:!?()\"'*%$#&") in STOPWORDS for w in words) / len(words)
            if stop >= MANY_STOPWORDS:
                labels.append("good" if size > LONG else "near")
            else:
                labels.append("near" if stop >= FEW_STOPWORDS else "bad" if size > LONG else "open")
    return labels


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Open blocks take the label of their nearest decided neighbours; a heading looks ahead."""
    n = len(labels)
    left, right = [(-1, "bad")] * n, [(n, "bad")] * n
    last = (-1, "bad")
    for i in range(n):
        left[i] = last
        last = (i, labels[i]) if labels[i] in ("good", "bad") else last
    last = (n, "bad")
    for i in reversed(range(n)):
        right[i] = last
        last = (i, labels[i]) if labels[i] in ("good", "bad") else last
    keep = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            keep.append(label == "good")
            continue
        (a, before), (b, after) = left[i], right[i]
        if before == after:
            keep.append(before == "good")
        elif found[i].heading:
            keep.append(after == "good")
        elif label == "near":
            keep.append(True)
        else:
            keep.append((before if i - a < b - i else after if b - i < i - a else "bad") == "good")
    return keep


def main_text(page: str) -> str:
    found = blocks(page)
    keep = second_pass(found, first_pass(found))
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row, in one pass without a shuffle."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            found = [main_text(h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
