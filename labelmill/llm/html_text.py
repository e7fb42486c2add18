"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks from what they are themselves: the region
they stand in, the share of characters in links, their length and the share of stop words. Blocks too short or too
odd to tell stay open; the second pass gives them the label of the nearest decided blocks.

Stop words are of four languages. Where a page has no block that they decide, long blocks with few links are the text. Class
names are hints: where nothing would be left of a page, a container that holds most of its text is kept in spite of them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and are as at be because but by can could do for from had has have he her his i if in into is it its
    more no not of on one or other our she so some such than that the their them then there these they this to up was we were
    what when which who will with would you your
    aber alle als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in
    ist ja kann kein man mich mir mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu
    zum zur
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes mon ne nous on ou où par
    pas pour qu que qui sa sans se ses son sont sur ta te tu un une vous y
    al como con cuando del desde donde el ella ellos era es esta este esto está ha han hasta hay la las lo los más mi muy no nos o para
    pero por porque que se ser si sin sobre su sus también tiene todo un una uno unos y ya""".split()
)
# Elements whose text is never article text, and raw-text elements.
DROPPED = frozenset("nav header footer aside form button select option textarea dialog menu template noscript iframe object svg canvas".split())
RAW = ("script", "style", "textarea", "title", "template", "noscript", "iframe", "svg", "xmp", "noembed", "noframes", "math", "select")
# Elements that do not end a block.
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong
    sub sup time tt u var wbr""".split()
)
# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id and role that mark a region as not the article.
HINTS = frozenset(
    """ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright
    disqus dropdown footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination pager
    popup promo promotion promoted related reply replies respond search share sharing shares sidebar signup social sponsor
    sponsored subscribe tags toolbar widget contentinfo complementary alert""".split()
)
MAIN = frozenset(("article", "main"))
# Words by which a class name tells what a container has, not what it is ("with-sidebar", "no-comments").
HAVING = frozenset("with without has have had no not is hide show".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
PART = re.compile(r"[a-z]+")
LETTERS = re.compile(r"[^\W\d_]+")

# Rules of the first pass: characters of a long block, share of link characters and of stop words.
LONG, LINKS, STOPS = 80, 0.33, 0.12


# What an element's attributes say of it.
NOTHING, HINTED, HIDDEN = 0, 1, 2


def told(attributes: str) -> int:
    says = NOTHING
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "style":
            if "display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", ""):
                return HIDDEN
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return HIDDEN
        elif name in ("class", "id", "role"):
            for token in value.split():
                words = PART.findall(token)
                if not HINTS.isdisjoint(words) and HAVING.isdisjoint(words):
                    says = HINTED
    return says


class Block:
    """``dropped``: it stands in an element that is never text, or hidden; ``hints``: the hinted containers it stands in."""

    __slots__ = ("dropped", "hints", "linked", "main", "text")

    def __init__(self, text: str, linked: int, dropped: bool, main: int, hints: tuple[int, ...] = ()):
        self.text, self.linked, self.dropped, self.main, self.hints = text, linked, dropped, main, hints


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order, with their link characters, the article and the hinted containers they stand in."""
    out: list[Block] = []
    open_: list[tuple[str, bool, int, bool]] = []  # element, drops its content, number of the hinted container, is the article
    pieces: list[str] = []
    linked = links = drops = mains = regions = containers = 0

    def close_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, linked, drops > 0, regions if mains else 0, tuple(hint for _, _, hint, _ in open_ if hint)))
            pieces.clear()
        linked = 0

    at = 0
    for found in TOKEN.finditer(page):
        if found.start() > at:
            text = page[at : found.start()]
            pieces.append(text)
            linked += len(text) * (links > 0)
        at = found.end()
        tag = found["tag"]
        if tag is None:
            if found["raw"]:
                close_block()
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if found["end"] else 1
        if tag in INLINE:
            if tag in ("img", "wbr"):
                continue
            says = NOTHING if found["end"] or tag != "span" else told(found["attributes"])
            if says:
                close_block()
                containers += says == HINTED
                open_.append((tag, says == HIDDEN, containers if says == HINTED else 0, False))
                drops += says == HIDDEN
            elif found["end"] and open_ and open_[-1][0] == tag:
                close_block()
                drops -= open_.pop()[1]
            continue
        close_block()
        links = 0
        if tag in VOID:
            continue
        if found["end"]:
            if any(name == tag for name, *_ in open_):
                while True:
                    name, drop, _, main = open_.pop()
                    drops, mains = drops - drop, mains - main
                    if name == tag:
                        break
            continue
        says = told(found["attributes"])
        if tag in ("body", "html") or tag == "p" and not says:
            continue
        if tag == "main" and says == HINTED:
            says = NOTHING
        main = tag in MAIN and not says
        if main and not mains:
            open_.clear()  # an article ends whatever was left open before it
            drops = 0
            regions += 1
        drop = tag in DROPPED or says == HIDDEN
        containers += says == HINTED
        open_.append((tag, drop, containers if says == HINTED else 0, main))
        drops, mains = drops + drop, mains + main
    if at < len(page):
        pieces.append(page[at:].partition("<")[0] if page[at:].lstrip().startswith("<") else page[at:])
    close_block()
    return out


def first_pass(block: Block) -> bool | None:
    """True for article text, False for anything else, None for not decided."""
    size = len(block.text)
    if block.dropped or block.linked > LINKS * size:
        return False
    words = LETTERS.findall(block.text.lower())
    stops = sum(word in STOP_WORDS for word in words) / len(words) if words else 0.0
    return True if size >= LONG and stops >= STOPS else None


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided block of their region; dropped ones do not count.

    Two that are as near and differ, or none, leave it to the region: article or not.
    """
    decided = [i for i, (block, label) in enumerate(zip(blocks, labels, strict=True)) if label is not None and not block.dropped]
    final, place = [], 0
    for i, (block, label) in enumerate(zip(blocks, labels, strict=True)):
        while place < len(decided) and decided[place] < i:
            place += 1
        if label is None:
            near = [j for j in (decided[place - 1] if place else None, decided[place] if place < len(decided) else None) if j is not None]
            near = [j for j in near if blocks[j].main == block.main]
            closest = min((abs(j - i) for j in near), default=0)
            votes = {labels[j] for j in near if abs(j - i) == closest}
            label = votes.pop() if len(votes) == 1 else bool(block.main)
        final.append(label)
    return final


def chosen(blocks: list[Block]) -> list[str]:
    if any(block.main and not block.dropped for block in blocks):
        blocks = [block for block in blocks if block.main]
    labels = [first_pass(block) for block in blocks]
    if True not in labels:
        # a language without known stop words: length decides, link density has
        labels = [True if label is None and len(block.text) >= LONG else label for block, label in zip(blocks, labels, strict=True)]
    return [block.text for block, label in zip(blocks, second_pass(blocks, labels), strict=True) if label]


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    sizes: dict[int, int] = {}
    for block in blocks:
        for hint in block.hints:
            sizes[hint] = sizes.get(hint, 0) + len(block.text) * (not block.dropped)
    total = sum(len(block.text) for block in blocks if not block.dropped)

    def without(hints: set[int]) -> list[Block]:
        return [Block(b.text, b.linked, b.dropped or not hints.isdisjoint(b.hints), b.main) for b in blocks]

    found = chosen(without(set(sizes)))
    if not found and sizes:
        found = chosen(without({hint for hint, size in sizes.items() if 2 * size < total}))
    return " ".join(found)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page, from its whole html.

    A null or empty page has the empty text; so has one without article text. Unclosed elements end with the page or with
    the next article. An undecided block between two that are as near and differ belongs to its region. Very long pages are
    taken whole. Repeated rows give repeated rows; other columns stay behind; an empty table gives none. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "") for page in batch.column("html")]
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url"),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array(map(len, texts), pa.int64()),
                }
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
