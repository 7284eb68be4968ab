"""Main text of web pages by two-pass block rules.

Pass one classifies each block by stop-word density, length and link density; the page's own structure decides first where
it speaks (menus, adverts, forms and comments out; the article in). A name or a form only hints: it doesn't put out what
holds the page's article or most of its prose, and a name makes an article only of what holds most of the prose. Pass two
gives blocks that stay ambiguous the label of their nearest decided neighbours.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent words of four languages.
STOP_WORDS = frozenset((
    "the of and to in a is that it for on was with as be by this are from at or an not have which "
    "le la les de des du et en un une est que qui dans pour pas sur au avec par il elle ce "
    "der die das und ist in den von zu mit sich auf für nicht ein eine als auch es an dem "
    "el los las y una por con para se del al lo como más su pero").split())
SKIPPED_TAGS = frozenset((
    "nav footer aside form button select textarea menu dialog iframe object embed canvas audio video map fieldset").split())
SKIPPED_NAMES = frozenset((
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation "
    "breadcrumb breadcrumbs cookie cookies consent gdpr notice notification alert popup modal overlay subscribe newsletter signup login "
    "share sharing social related recommended comment comments reply replies respond disqus footer header masthead topbar toolbar "
    "widget pagination pager tags copyright legal disclaimer skip").split())
HINT_TAGS = frozenset("form fieldset".split())
ARTICLE_NAMES = frozenset("article post content entry story main body".split())
BLOCK_TAGS = frozenset((
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section article main blockquote pre header hr "
    "address body html details summary figure figcaption center").split()) | SKIPPED_TAGS
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd".split())

# a head is a tag like others: its title, scripts and styles are taken here, so a left-out </head> swallows no text
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    r"|<(script|style|noscript|template|svg|math|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true)", re.I)
_WRAPPER = re.compile(r"(?:^|[-_])(?:has|with|no|without)[-_]")
_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@dataclass(frozen=True)
class BlockRules:
    """Limits of pass one: lengths in characters, shares of words (stop words) and of characters (links)."""

    short: int = 70
    long: int = 200
    low_stops: float = 0.15
    high_stops: float = 0.25
    links: float = 0.4


def blocks_of(page: str, rules: BlockRules = BlockRules()) -> list[tuple[str, float, str]]:
    """``(text, share of link characters, place)`` in page order; place is ``out``, ``article`` or empty."""
    out: list[tuple[str, float, tuple[int, ...]]] = []
    kinds: list[str] = []                        # place of each tracked element, by number
    inside: list[int] = []
    stack: list[tuple[str, str]] = []            # open elements that change the place
    text: list[str] = []
    linked, breaks = 0, 0
    in_link, deeper = False, 0                   # inside a link, and how many blocks were opened in it
    places: list[str] = []

    def flush() -> None:
        nonlocal linked, breaks
        whole = " ".join(entities.unescape("".join(text)).split())
        if whole:
            out.append((whole, min(1.0, linked / len(whole)), tuple(inside)))
        text.clear()
        linked = breaks = 0

    def write(part: str) -> None:
        nonlocal linked, breaks
        if part:
            text.append(part)
            if not part.isspace():
                breaks = 0
            if in_link:
                linked += len(" ".join(entities.unescape(part).split()))

    at = 0
    for found in _MARKUP.finditer(page):
        write(page[at:found.start()])
        at = found.end()
        name = found[3]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            in_link, deeper = not found[2] and bool(_HREF.search(found[4])), 0      # an anchor without a target is no link
            continue
        if name == "br":
            breaks += 1
            text.append(" ")
            if breaks > 1:
                flush()
            continue
        if name in BLOCK_TAGS:
            in_link = in_link and (deeper > 0 or not linked)     # a block after the link's own words: its end tag was left out
            flush()
            deeper += 0 if name in VOID_TAGS else -1 if found[2] else 1
            in_link = in_link and deeper >= 0        # a link that isn't closed ends with the block that it began in
            while not found[2] and stack and stack[-1][0] in CLOSED_BY_BLOCK:
                stack.pop(), places.pop(), inside.pop()
        if found[2]:
            if any(s[0] == name for s in stack):
                while stack:
                    was = stack.pop()[0]
                    places.pop(), inside.pop()
                    if was == name:
                        break
            continue
        if name in VOID_TAGS or found[4].endswith("/"):
            continue
        place = _place(name, found[4], "article" in places or "article?" in places)
        # an element inside a placed one of the same name is tracked too, so that its end tag isn't taken for the outer one's
        if place or any(s[0] == name for s in stack):
            if name in BLOCK_TAGS or place:
                if place:
                    flush()
                stack.append((name, place)), places.append(place)
                kinds.append(place), inside.append(len(kinds) - 1)
    write(page[at:])
    flush()
    _settle(out, kinds, rules)
    found_places = []
    for whole, links, elements in out:
        of = {kinds[e] for e in elements}
        found_places.append((whole, links, "out" if "out" in of else "article" if "article" in of else ""))
    return found_places


def _settle(blocks: list[tuple[str, float, tuple[int, ...]]], kinds: list[str], rules: BlockRules) -> None:
    """Decide the hints in ``kinds`` (``out?`` and ``article?``) by the characters of prose in each element: blocks rich in
    stop words and not short, or all text without many links on a page that has none of it."""
    if not any(k.endswith("?") for k in kinds):
        return
    may_speak = [not any(kinds[e] == "out" for e in elements) and links <= rules.links for _, links, elements in blocks]
    prose = [len(b[0]) if may and len(b[0]) >= rules.short and stop_share(b[0]) >= rules.low_stops else 0 for b, may in zip(blocks, may_speak)]
    if not any(prose):
        prose = [len(b[0]) if may else 0 for b, may in zip(blocks, may_speak)]
    total = sum(prose)
    free = said = 0                              # prose and all text in articles that no hint puts out
    for n, may, (text, _, elements) in zip(prose, may_speak, blocks):
        of = {kinds[e] for e in elements}
        if may and "article" in of and "out?" not in of:
            free, said = free + n, said + len(text)
    held, holds, within = [0] * len(kinds), [False] * len(kinds), [False] * len(kinds)
    for n, (_, _, elements) in zip(prose, blocks):
        if n:
            for e in elements:
                held[e] += n
                holds[e] |= any(kinds[x] == "article" for x in elements if x > e)   # inner elements have higher numbers
                within[e] |= any(kinds[x] == "article" for x in elements if x < e)
    for e, kind in enumerate(kinds):
        if kind == "out?":
            elsewhere = free or said >= rules.short if within[e] else said
            kinds[e] = "" if not elsewhere and (holds[e] or 2 * held[e] > total) else "out"
        elif kind == "article?":
            kinds[e] = "article" if held[e] and 2 * held[e] >= total else ""


def _place(name: str, attributes: str, in_article: bool) -> str:
    """``out`` and ``article`` are sure, ``out?`` and ``article?`` are hints."""
    if name in HINT_TAGS:
        return "out" if _HIDDEN.search(attributes) else "out?"
    if name in SKIPPED_TAGS or name == "header" and not in_article:
        return "out"
    words: set[str] = set()
    skipped: set[str] = set()
    if "=" in attributes:
        for one in _NAMES.finditer(attributes):
            for whole in (one[1] or one[2] or one[3] or "").lower().split():
                parts = set(re.split(r"[^a-z]+", whole))
                words |= parts
                skipped |= set() if _WRAPPER.search(whole) else parts
        if _HIDDEN.search(attributes):
            return "out"
    if name not in ("body", "html", "article", "main") and skipped & SKIPPED_NAMES:
        return "out?"
    if name in ("article", "main"):
        return "article"
    return "article?" if words & ARTICLE_NAMES and name != "body" else ""


def stop_share(text: str) -> float:
    words = [w.strip(".,;:!?\"'()[]*#$%&").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def first_label(text: str, links: float, place: str, rules: BlockRules) -> str:
    """``good``, ``bad``, ``links`` (a block of links in an article), or ``near`` (long enough, doubtful) or ``short`` for the second pass."""
    if place == "out" or links > rules.links:
        return "links" if place == "article" else "bad"
    if place == "article":
        return "good"
    if "©" in text:
        return "bad"
    if len(text) < rules.short:
        return "bad" if links else "short"
    stops = stop_share(text)
    if stops >= rules.high_stops:
        return "good" if len(text) > rules.long else "near"
    return "near" if stops >= rules.low_stops else "bad"


def labels(blocks: list[tuple[str, float, str]], rules: BlockRules) -> list[bool]:
    """Which blocks are main text. In an article links decide only over short blocks in a run of link blocks and over a short block that is a link. Ambiguous ones follow the nearest good or bad block on either side: two equal labels
    decide; if they differ, a doubtful long block is kept and a short one goes with the nearer, the earlier if both are as near.
    Without a decided block, doubtful long blocks are kept and short ones not."""
    first = [first_label(*b, rules) for b in blocks]
    # in an article only a list of links goes: neighbours that are links too, or nothing but a short link
    run = [i for i, label in enumerate(first) if label == "links"]
    for i in run:
        listed = i - 1 in run or i + 1 in run
        alone = len(blocks[i][0]) < rules.short and blocks[i][1] > 0.9
        first[i] = "links" if listed and len(blocks[i][0]) < rules.long else "bad" if alone else "good"
    first = ["bad" if label == "links" else label for label in first]
    before, after = [], [None] * len(first)
    last = None
    for i, label in enumerate(first):
        before.append(last)
        last = (i, label) if label in ("good", "bad") else last
    last = None
    for i in range(len(first) - 1, -1, -1):
        after[i] = last
        last = (i, first[i]) if first[i] in ("good", "bad") else last
    out = []
    for i, label in enumerate(first):
        if label in ("good", "bad"):
            out.append(label == "good")
            continue
        sides = [s for s in (before[i], after[i]) if s]
        if len({s[1] for s in sides}) == 1:
            out.append(sides[0][1] == "good")
        elif label == "near" or not sides:
            out.append(label == "near")
        else:
            out.append(min(sides, key=lambda s: (abs(s[0] - i), s[0]))[1] == "good")
    return out


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    blocks = blocks_of(page or "", rules)
    return "\n\n".join(b[0] for b, keep in zip(blocks, labels(blocks, rules)) if keep)


def extract(pages: DataFrame, rules: BlockRules = BlockRules(), id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: ``page_id``, ``url``, ``text`` (empty if there is none) and ``n_chars``, its code points.

    A null page counts as empty. Broken or cut markup is read as far as it goes. Pages are independent of each other:
    one scan, no shuffle, a page at a time in memory.
    """
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), rules) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
