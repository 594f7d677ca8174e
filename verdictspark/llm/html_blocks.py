"""Main text of HTML pages by two passes of block rules.

Regions only set blocks aside: menus, footers, adverts and the like, and all that lies
outside an article where the page has one. Pass one labels the other blocks by length,
link density and stop-word density. Pass two gives those that it leaves undecided (short
ones, long ones without stop words, links within an article) the label of their nearest
decided neighbours; blocks that are set aside have no say. Where nothing is decided,
blocks that are not links are content.

Null and empty html give an empty text. A head may be left open: only its title, scripts and
styles go. A tag's name ends at a blank, `/` or `>`, so <head-line> and the like are elements
of no meaning whose text stays. Unclosed and truncated tags are tolerated; a tag that the end
of the page or another tag cuts off is dropped, and one whose quotes don't close ends at its first `>`. Very long pages are read whole. Repeated rows
give repeated results, an empty table none. A column named main_text gives way to the result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictspark.llm.tables import read
from verdictspark.llm.words import pieces

#: A quoted value that runs over markup counts only where something fit to follow a value follows it.
_VALUE = r"""=\s*(?:"[^"<>]*"|'[^'<>]*'|"[^"]{0,2000}"(?=[\s/>])|'[^']{0,2000}'(?=[\s/>])|(?!["']))"""
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea|iframe)(?=[\s>/])[^>]*>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s<>/]*)((?:[^>\"'=<]|{_VALUE})*)>|<(/?)([a-zA-Z][^\s<>/]*)([^<>]*)(?:>|(?=<)|\Z)|<[!?][^>]*(?:>|\Z)|</(?:[^<>a-zA-Z][^<>]*)?(?:>|\Z)",
    re.S | re.I,
)
#: Elements whose content isn't text of the page; left open, they end with the element around them.
_MUTE = frozenset("noscript template svg select object canvas".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NESTED = frozenset("address article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
_ASIDE = frozenset("aside footer form menu nav dialog fieldset button".split())
_PARTS = (
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|cookies?|consent|gdpr|notices?|"
    r"alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*|widget|comments?|respond|replies|disqus|pagination|pager|toolbar|copyright)"
)
#: Around an article any part of a class name tells; within it a class must be such a word, or one and a word for a container.
_NAMES = re.compile(rf"(?i)(?:^|[\s_-]){_PARTS}(?:$|[\s_-])")
_WHOLE = re.compile(rf"(?i)(?:^|\s){_PARTS}(?:[_-](?:box|container|wrapper|wrap|block|slot|unit|bar|links?|list|inner|area|section|panel))?(?:$|\s)")
_ATTR = re.compile(r"(?i)\b(class|id|role|aria-label|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

#: Frequent function words of the four languages.
STOP_WORDS = frozenset(
    (
        "the of and to a in is it that was for on are with as be this by from at or an not but have has he she they we you his her their which when than "
        "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch "
        "le la les de des du et un une en dans que qui est pour par sur au aux avec ce cette il elle ne pas plus se sont ou mais son sa ses "
        "el los las del y que en un una por con para se no es al lo como su sus más o pero este esta"
    ).split()
)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    inside: bool
    aside: bool
    label: str = ""
    by: str = ""


@dataclass
class _Open:
    tag: str
    inside: bool
    aside: bool


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    tag: str = ""

    def close(self, at: _Open, next_tag: str) -> None:
        text = " ".join(entities.unescape("".join(self.parts)).split())
        if text:
            self.blocks.append(Block(text, self.linked, self.tag, at.inside, at.aside))
        self.parts, self.linked, self.tag = [], 0, next_tag


def _set_aside(tag: str, attrs: str, inside: bool) -> bool:
    if tag in _ASIDE or tag == "header" and not inside:
        return True
    if attrs and tag not in ("body", "html", "article", "main"):
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "role" and value.lower() in _ROLES or name != "role" and value and (_WHOLE if inside else _NAMES).search(value):
                return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of visible text in order, with their regions."""
    reader, stack, at, anchors, mute = _Reader(), [_Open("", False, False)], 0, 0, 0
    for m in _TAG.finditer(page):
        if m.start() > at and not mute:
            piece = page[at : m.start()]
            reader.parts.append(piece)
            if anchors:
                reader.linked += len(piece)
        at = m.end()
        tag, ends, attrs = (m[3] or m[6] or "").lower(), m[2] or m[5], m[4] or m[7] or ""
        if not tag:
            continue
        if tag in _MUTE or mute:
            # mute: the place on the stack of the outermost such element.
            if ends:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
            elif tag in _MUTE or tag in _NESTED:
                if not attrs.rstrip().endswith("/"):
                    mute = mute or len(stack)
                    stack.append(_Open(tag, stack[-1].inside, stack[-1].aside))
            still = mute if mute < len(stack) else 0
            if mute and not still and tag not in _MUTE:
                reader.close(stack[-1], "")
            mute = still
        elif tag == "a":
            anchors = 0 if ends else 1
        elif tag == "br":
            reader.parts.append(" ")
        elif tag in _BLOCK:
            top = stack[-1]
            reader.close(top, "" if ends else tag)
            if tag in _NESTED or not ends and _set_aside(tag, attrs, top.inside):
                if ends:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == tag:
                            del stack[k:]
                            break
                elif not attrs.rstrip().endswith("/"):
                    main = tag in ("article", "main")
                    inside = top.inside or main
                    stack.append(_Open(tag, inside, (top.aside and not (main and not top.inside)) or _set_aside(tag, attrs, top.inside)))
            elif len(stack) > 1 and stack[-1].tag == tag and tag not in _NESTED:
                stack.pop()
    if at < len(page) and not mute:
        reader.parts.append(page[at:])
    reader.close(stack[-1], "")
    return reader.blocks


def stop_density(text: str) -> float:
    """The share of stop words among a text's words."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def classify(blocks: list[Block], short: int = 70, links: float = 0.5, stops: float = 0.1) -> None:
    """Labels the blocks in place, in two passes; `by` says what decided."""
    region = any(b.inside and not b.aside for b in blocks)
    rest = []
    for b in blocks:
        if b.aside or region and not b.inside:
            b.label, b.by = "bad", "region"
            continue
        rest.append(b)
        if b.linked > links * len(b.text):
            b.label = "undecided" if b.inside and b.tag != "li" else "bad"
        else:
            b.label = "good" if len(b.text) >= short and stop_density(b.text) >= stops else "undecided"
        b.by = "rules"
    known = [(i, b.label) for i, b in enumerate(rest) if b.label != "undecided"]
    k = 0
    for i, b in enumerate(rest):
        if b.label != "undecided":
            continue
        while k < len(known) and known[k][0] < i:
            k += 1
        near = [known[j] for j in (k - 1, k) if 0 <= j < len(known)]
        if not any(label == "good" for _, label in known):
            near = []
        if near:
            b.label, b.by = min(near, key=lambda n: (abs(n[0] - i), n[1] == "bad"))[1], "neighbours"
        else:
            b.label, b.by = "good" if b.inside or b.linked <= links * len(b.text) else "bad", "default"


def main_text(page: str) -> str:
    """The page's content blocks joined by newlines."""
    blocks = blocks_of(page)
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """The rows with `main_text` in place of `html` (and of a column of that name)."""
    keep = [c for c in pages.columns if c not in (html, "main_text")]
    schema = pages.select(*keep, F.lit("").alias("main_text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, html):
            texts = pa.array([main_text(h or "") for h in batch.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], names=[*keep, "main_text"])

    return pages.mapInArrow(run, schema)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text and its length in code points."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extracted(pages)
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
