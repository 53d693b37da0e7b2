"""Main text of web pages by two-pass block rules.

A page is read into blocks of text between block-level tags.  The first pass
judges each block alone by the share of its characters inside links, by its
length and by the density of stop words: long blocks with many stop words are
good, link lists are bad, short blocks and those between the limits stay
undecided.  The second pass gives each of these the label of its nearest
decided neighbours, first among the blocks of the same container, then in the
same article, else on the page.

What elements say of themselves comes in as evidence for both passes.  Menus,
forms, footers, sidebars and reader comments that are marked as such are bad.
Names of adverts and notices are bad where a page marks no article or inside
it; outside it short ones are left to the second pass.  A page's article is a
feature: an undecided block inside is good if nothing near it is decided, and a
block outside is good by itself only if it is very long.

Defined results: null or empty html, or a page without main text, gives the
empty text; html cut off anywhere is read as far as it goes, an unfinished tag
at its end is dropped; repeated rows are read each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Frequent function words of each language.
STOP_WORDS = {
    "en": "a about all also an and any are as at be been but by can could do for from had has have he her his i if in into is it its more no not of on one or other out so some that the their them then there these they this to up was we were what when which who will with would you your",
    "fr": "a au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ont ou par pas plus pour qu que qui sa se ses son sont sur un une vous y",
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war was wie wird zu zum zur",
    "es": "a al como con de del donde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no o para pero por que se ser si sin sobre su sus también un una uno y ya",
}
STOPS = [frozenset(x.split()) for x in STOP_WORDS.values()]

#: Lengths: below SHORT nothing is decided, over LONG stop words decide; outside a marked article only over VERY_LONG.
SHORT, LONG, VERY_LONG = 70, 200, 400
STOPS_LOW, STOPS_HIGH = 0.10, 0.15
LINKS_MOST = 0.5

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't text of the page.
RAW_TAGS = frozenset("script style noscript template textarea iframe svg math object canvas audio video select title".split())
OUT_TAGS = frozenset("nav aside footer form dialog button menu head search".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menus?|breadcrumbs?|sidebar\w*|widgets?|footer\w*|comments?|commentlist|disqus\w*|replies|respond|share|sharing|social|related|recommend\w*|toolbar|pagination|pager|login|signup)(?:$|[\s_-])"
)
#: Adverts and notices.
SOFT_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscribe|subscription)(?:$|[\s_-])")
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|masthead|site-title|topbar)(?:$|[\s_-])")

#: Quotes hold a tag's end back only around a whole value, after "="; what was read isn't read again, so the time is linear.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>|([^<]+)|(<)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Blocks of these are told apart by the element around them.
LEAVES = HEADINGS | frozenset("p pre li dt dd blockquote figcaption caption summary address".split())
PUNCTUATION = re.compile(r"^[^\w]+|[^\w]+$")

GOOD, BAD, NEAR, UNDECIDED = "good", "bad", "near", "undecided"


class Block:
    __slots__ = ("box", "heading", "links", "out", "region", "soft", "text")

    def __init__(self, text: str, links: int, out: bool, soft: bool, region: int, box: int, heading: bool):
        #: soft: in an element named like an advert or a notice; region: number of the article that the block is in, 0 outside; box: of its container
        self.text, self.links, self.out, self.soft, self.region, self.box, self.heading = text, links, out, soft, region, box, heading


def _evidence(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """(is the element none of the main text, is it named like an advert or a notice)."""
    if tag in OUT_TAGS or (tag == "header" and not inside):
        return True, False
    soft = False
    for name, *values in ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        value = "".join(values).lower()
        if name.lower() == "role":
            if value in OUT_ROLES:
                return True, False
        elif tag not in ("html", "body", "article", "main"):
            if OUT_NAMES.search(value) or (not inside and HEADER_NAMES.search(value)):
                return True, False
            soft = soft or bool(SOFT_NAMES.search(value))
    return False, soft


def read_blocks(html: str) -> list[Block]:
    """Blocks of a page in page order."""
    blocks: list[Block] = []
    stack: list[tuple[str, bool, bool, int, int]] = []  # tag, whether its content is out or soft, region, number of its container
    opened: Counter[str] = Counter()
    parts: list[str] = []
    links, link_depth, regions, numbers = 0, 0, 0, 0
    out, soft, region = False, False, 0
    pos, n = 0, len(html)

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(text, links, out, soft, region, stack[-1][4] if stack else 0, bool(stack) and stack[-1][0] in HEADINGS))
            parts.clear()
        links = 0

    def settle() -> None:
        nonlocal out, soft, region
        _, out, soft, region, _ = stack[-1] if stack else ("", False, False, 0, 0)

    while pos < n:
        m = TOKEN.match(html, pos)
        pos = m.end()
        text = m[4] or m[5]
        if text:
            if m[5] and re.match(r"[a-zA-Z/!?]", html[pos : pos + 1] or ""):
                break  # a tag that the end of the page cuts off
            if "&" in text:
                text = unescape(text)
            parts.append(text)
            if link_depth:
                links += len(text.strip())
            continue
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW_TAGS:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, pos)
                pos = end.end() if end else n
            continue
        if tag == "a":
            link_depth = max(0, link_depth - 1) if closing else 1
            continue
        if tag == "br":
            parts.append("\n")
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
            link_depth = 0
        if tag in VOID_TAGS:
            continue
        if closing:
            if opened[tag]:
                flush()
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == tag:
                        break
                settle()
            continue
        if block:
            if stack and stack[-1][0] == "p":
                opened[stack.pop()[0]] -= 1
                settle()
            if tag in ("li", "td", "tr", "dd", "dt", "option") and stack and stack[-1][0] == tag:
                opened[stack.pop()[0]] -= 1
                settle()
        hidden, named = _evidence(tag, m[3], bool(region))
        hidden, named = out or hidden, soft or named
        marks = tag in ("article", "main") or re.search(r"""\brole\s*=\s*["']?main\b""", m[3], re.I)
        changes = hidden != out or named != soft or marks
        if block or changes:
            if changes:
                flush()
            if marks and not region:
                regions += 1
                region = regions
            numbers += 1
            opened[tag] += 1
            stack.append((tag, hidden, named, region, numbers if tag not in LEAVES else stack[-1][4] if stack else 0))
            out, soft = hidden, named
    flush()
    return blocks


def stop_density(text: str) -> float:
    """Share of stop words, by the language that has most of them."""
    words = [PUNCTUATION.sub("", w) for w in text.lower().split()]
    return max(sum(map(s.__contains__, words)) for s in STOPS) / len(words) if words else 0.0


def first_pass(b: Block, marked: bool) -> str:
    """The label of a block by itself; marked: whether the page marks its article."""
    n = len(b.text)
    if b.out or b.links > LINKS_MOST * n:
        return BAD
    if b.soft and (b.region or not marked or n >= SHORT):
        return BAD
    if n < SHORT:
        return NEAR if b.heading and not b.links else UNDECIDED  # a heading goes with a good block beside it
    density = stop_density(b.text)
    if density >= STOPS_HIGH:
        return GOOD if n > (VERY_LONG if marked and not b.region else LONG) else NEAR
    if density >= STOPS_LOW:
        return NEAR
    return UNDECIDED if b.region else BAD


def second_pass(blocks: list[Block], labels: list[str], marked: bool) -> list[str]:
    """Near and undecided blocks take the label of the nearest decided neighbour, a near one that of the better of the two
    beside it.  What is out is no neighbour but on the page outside articles."""
    decided: dict[tuple[str, int], list[int]] = {}
    for i, (b, label) in enumerate(zip(blocks, labels, strict=True)):
        if label in (GOOD, BAD):
            for scope in (("page", 0),) if b.out else (("box", b.box), ("region", b.region) if b.region else ("page", 0)):
                decided.setdefault(scope, []).append(i)
    out = list(labels)
    for i, (b, label) in enumerate(zip(blocks, labels, strict=True)):
        if label in (GOOD, BAD):
            continue
        scopes = (("box", b.box), ("region", b.region) if b.region else ("page", 0))
        at = next((decided[s] for s in scopes if s in decided), [])
        k = bisect(at, i)
        before, after = (at[k - 1] if k else None), (at[k] if k < len(at) else None)
        beside = [labels[x] for x in (before, after) if x is not None]
        if not beside:
            out[i] = GOOD if b.region or (label == NEAR and not marked) else BAD
        elif label == NEAR or len(set(beside)) == 1:
            out[i] = GOOD if GOOD in beside else BAD
        elif i - before == after - i:
            out[i] = GOOD if b.region else BAD
        else:
            out[i] = beside[0] if i - before < after - i else beside[1]
    return out


def main_text(html: str | None) -> str:
    """The good blocks of a page, one a line."""
    blocks = read_blocks(html or "")
    marked = any(b.region and not b.out for b in blocks)
    labels = second_pass(blocks, [first_pass(b, marked) for b in blocks], marked)
    return "\n".join(b.text for b, label in zip(blocks, labels, strict=True) if label == GOOD)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op5_html_blocks(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
