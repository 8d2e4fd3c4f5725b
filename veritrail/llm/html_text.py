"""Main text of HTML pages by two-pass block rules (operator 2).

Markup is cut into blocks; containers that never hold article text (scripts,
menus, forms, notices, adverts, comments) are left out. Pass one decides each
block by its length, link density and stop-word density, or leaves it open.
Pass two gives an open block the label of its nearest decided neighbour.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import python_ready

# fixed values: frequent function words of four languages
STOP_WORDS = frozenset(
    """the of and to in a is that it for was on are as with his they at be this from have or by one had not but what all were when
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
    le la les de des et un une du en que qui dans pour pas sur au par plus ne se ce est il elle sont avec
    el los las y del se por con una su para es al lo como más o pero sus este ha si porque esta son entre""".split()
)
# fixed values: elements of HTML by their part in a page
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "math", "textarea", "title")
DROPPED = frozenset("head nav footer aside form button select option datalist label input dialog menu map audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3
    h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# fixed values: words in class, id and role that name what is not the article
BOILERPLATE = frozenset(
    """ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert
    discussion replies newsletter subscribe subscription popup modal overlay sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs share
    sharing social related recommended comment comments respond reply disqus footer masthead toolbar pagination pager login signup
    search topbar sitemap copyright complementary contentinfo skip outbrain taboola""".split()
)
# fixed values: words that with one of those name a part of the same thing, as ``comment-list`` or ``post-comments``
COMPANIONS = frozenset(
    """area article articles author bar block body box button buttons card container content entry feed form group header heading holder
    icon icons inner item items link links list meta panel post posts reader row section site slot stories story text thread title unit
    user wrap wrapper""".split()
)
MAIN_WORDS = frozenset("main articlebody".split())

SHORT, LONG = 70, 200
MANY_LINKS = 0.33
STOP_LOW, STOP_HIGH = 0.15, 0.30

# a page with fewer stop words than this in its long blocks is in another language than the four
KNOWN_STOPS = 0.20
# scripts without blanks: a character says as much as two of an alphabet
DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
SENTENCE = re.compile(r"[.!?…։۔؟।]['\"”’»)\]]*(?:\s|$)|[。！？｡]")

_TOKEN = re.compile(
    r"<!--(?:(?!-->)[\s\S])*+(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>[^'\">]++|\"[^\"]*+\"|'[^']*+'|['\"])*+)(?:>|\Z)|<|[^<]++"
)
_ATTR = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"']+)")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
_WORD = re.compile(r"[^\W_]+")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    links: float
    main: bool
    named: bool = False  # inside a container whose class or id names boilerplate
    label: str = ""


def _names_boilerplate(value: str) -> bool:
    """Whether a whole class token is a boilerplate word, or made of such words and ``COMPANIONS`` only, as ``comment-list``."""
    named = ({w.lower() for w in _SPLIT.split(token) if w} for token in value.split())
    return any(words & BOILERPLATE and words <= BOILERPLATE | COMPANIONS for words in named)


def _kind(tag: str, attrs: str) -> tuple[bool, bool, bool]:
    """Whether an element is boilerplate by itself, whether by its names, and whether it is the main part."""
    boiler, named, main = tag in DROPPED, False, tag in ("article", "main")
    if attrs.strip():
        for m in _ATTR.finditer(attrs):
            name, value = (m[1] or m[5]).lower(), html.unescape(m[2] or m[3] or m[4] or "")
            if name in ("class", "id", "role", "itemprop"):
                named |= tag not in ("html", "body") and _names_boilerplate(value)
                main |= bool({w.lower() for w in value.split()} & MAIN_WORDS)
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                boiler = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                boiler = True
    return boiler, named, main and not boiler


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page outside boilerplate containers, white space folded, with their share of link characters.

    A container that only its names make boilerplate is left out inside the main
    part; elsewhere its blocks are ``named``, as it may hold the main part.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, inside boilerplate, inside the main part, inside a named container
    opened: Counter[str] = Counter()  # elements of each name on the stack
    pieces: list[str] = []
    linked = links = 0
    at = 0

    def flush() -> None:
        nonlocal pieces, linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, min(1.0, linked / len(text)), bool(stack) and stack[-1][2], bool(stack) and stack[-1][3]))
        pieces, linked = [], 0

    def pop_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            if stack[-1][0] in BLOCK:
                flush()
            links -= stack[-1][0] == "a"
            opened[stack.pop()[0]] -= 1

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m["tag"]
        dropped = bool(stack) and stack[-1][1]
        if tag is None:
            if not m[0].startswith("<!") and not m[0].startswith("<?") and not dropped:
                text = html.unescape(m[0])
                pieces.append(text)
                linked += len(" ".join(text.split())) if links else 0
            continue
        if not page.endswith(">", 0, at):
            break  # a tag cut off at the end of the page
        tag = tag.lower()
        if m["end"]:
            if tag in BLOCK:
                flush()
            if opened[tag]:
                pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in RAW:
            end = None if m["attrs"].rstrip().endswith("/") and tag in ("svg", "math") else _RAW_END[tag].search(page, at)
            at = end.end() if end else (at if m["attrs"].rstrip().endswith("/") else len(page))
            pieces.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if stack and stack[-1][0] == "p":
                pop_to(len(stack) - 1)
        elif tag == "br":
            pieces.append(" ")
        for other in CLOSES.get(tag, ()):
            if stack and stack[-1][0] == other:
                pop_to(len(stack) - 1)
        if tag in VOID:
            continue
        boiler, named, main = _kind(tag, m["attrs"])
        inside = bool(stack) and stack[-1][2]
        boiler |= tag == "header" and not inside
        # <main> is the main part whatever its names; an article within it may be a comment
        boiler |= named and inside and tag != "main"
        named &= not inside and tag != "main"
        stack.append((tag, dropped or boiler, (inside or main), bool(stack) and stack[-1][3] or named))
        opened[tag] += 1
        links += tag == "a"
    flush()
    return out


def size_of(text: str) -> int:
    return len(text) + len(DENSE.findall(text))


def first_pass(block: Block, known: bool = True) -> str:
    """``good``, ``bad``, or open: ``leaning`` where words or sentences speak for it, ``short`` where nothing does.

    ``known`` is false on pages in other languages than those of the stop words:
    there sentence marks stand for stop words.
    """
    words = _WORD.findall(block.text.lower())
    if not words:
        return "short"
    if block.links > MANY_LINKS:
        return "bad"
    if "©" in block.text and len(block.text) < LONG and not block.main:
        return "bad"
    size = size_of(block.text)
    if size < SHORT:
        return "bad" if block.links > 0 and not block.main else "short"
    stops = sum(w in STOP_WORDS for w in words) / len(words)
    if stops >= STOP_HIGH:
        return "good" if size >= LONG else "leaning"
    if not known and SENTENCE.search(block.text):
        return "good" if size >= LONG else "leaning"
    if stops >= STOP_LOW or (not known and size >= LONG and not block.links):
        return "leaning"
    # code, tables and lists of names have few stop words: they go with their neighbours
    return "short" if block.main or not block.links else "bad"


def known_language(blocks: list[Block]) -> bool:
    """Whether the long blocks with few links hold as many stop words as the four languages do."""
    words = [w for b in blocks if size_of(b.text) >= SHORT and b.links <= MANY_LINKS for w in _WORD.findall(b.text.lower())]
    return not words or sum(w in STOP_WORDS for w in words) >= KNOWN_STOPS * len(words)


def classify(blocks: list[Block]) -> list[Block]:
    """Label every block. Where the page marks a main part, blocks outside it are not the article.

    Named containers count only where less than ``LONG`` characters outside them
    are the article: then they hold the page.
    """
    outside, named = [b for b in blocks if not b.named], [b for b in blocks if b.named]
    for b in named:
        b.label = "bad"
    _label(outside)
    if named and not any(b.main for b in outside) and sum(len(b.text) for b in outside if b.label == "good") < LONG:
        _label(blocks)
    return blocks


def _label(blocks: list[Block]) -> None:
    marked = any(b.main for b in blocks)
    own = [b for b in blocks if b.main == marked]
    known = known_language(own)
    for b in blocks:
        b.label = "bad" if marked and not b.main else first_pass(b, known)
    decided = [k for k, b in enumerate(own) if b.label in ("good", "bad")]
    before: list[int | None] = []
    last = None
    for k, b in enumerate(own):
        last = k if b.label in ("good", "bad") else last
        before.append(last)
    following = None
    final = [b.label for b in own]
    for k in range(len(own) - 1, -1, -1):
        if own[k].label in ("good", "bad"):
            following = k
            continue
        near = [(abs(k - j), own[j].label != "good") for j in (before[k], following) if j is not None]
        if near:
            final[k] = "bad" if min(near)[1] else "good"
        else:
            final[k] = "good" if marked or own[k].label == "leaning" else "bad"
    if not decided and not marked and "good" in final:
        final = ["good"] * len(final)  # a page of short blocks among which some lean to text
    for b, label in zip(own, final, strict=True):
        b.label = label


def main_text(page: str | None) -> str:
    """Main text of one page: its good blocks in order, one to a line; empty for null."""
    return "\n".join(b.text for b in classify(blocks_of(page)) if b.label == "good") if page else ""


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, one Arrow pass without a shuffle.

    A null, empty or textless page gives an empty text. Null ids and addresses
    and repeated rows stay; other columns, whatever their names, are not read.
    Time goes with the length of a page, end tags that close nothing included.
    """
    python_ready(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(batch: pd.Series) -> pd.Series:
        return pd.Series([main_text(None if p is None or p is pd.NA else p) for p in batch], dtype=object)

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text_of(F.col(page)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("bigint"))


def labelled(pages: DataFrame, page: str = "html") -> DataFrame:
    """``text, label, links`` of every block, for looking at what the rules decide."""
    python_ready(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [b for p in batch["page"] if p for b in classify(blocks_of(p))]
            yield pd.DataFrame({"text": [b.text for b in found], "label": [b.label for b in found], "links": [b.links for b in found]})

    return pages.select(F.col(page).alias("page")).mapInPandas(run, "text string, label string, links double")
