"""Main-text extraction from HTML by two-pass block rules.

A tokenizer cuts the page into blocks and notes where each stands.  The first pass decides
blocks by structure (menus, forms, adverts, comments, ...), link density, length and
stop-word density; the second gives ambiguous blocks the label of their nearest decided
neighbours within the same part of the page."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, lean

# Frequent function words of the languages handled.
STOP_WORDS = frozenset(
    """the of and to in a is that for it was on are as with be by this from at or an not have which he his but they you we
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er
    le la les de des et un une en du que est dans qui par pour au sur pas plus se ne ce il
    el los las y que en un una del por con para su al lo como más o pero sus""".split()
)
# Elements whose content is never main text.
SKIPPED = frozenset("nav footer aside form button select option textarea iframe object svg canvas menu dialog noscript template head audio video datalist map".split())
# Elements whose content is not markup.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends open elements of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "a": ("a",)}
#: Elements that an implied end does not reach beyond.
SCOPES = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html main nav ol section table td th ul".split())
# Parts of class and id names, and roles, of boilerplate and of main content.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
CONTENT = frozenset("article content story post entry articlebody".split())
# What may stand beside those parts in such a name.
NEUTRAL = frozenset(
    "a bar block body bottom box btn bottoms button buttons col column container content el fixed float footer form global group head header holder home icon icons inner item items js left link links list main mobile module outer page panel primary right row secondary section side site slot small sticky text title top unit wrap wrapper wide".split()
)
#: Elements whose names may mark boilerplate: containers, not headings, paragraphs or text.
CONTAINERS = frozenset("article aside blockquote center details dialog div dl fieldset figure footer form header iframe li main nav ol section table tbody td tr ul".split())

# quoted values longer than 10,000 characters end at the next >, so that no tag is read again and again
_TAG = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]{0,10000}\"[^>\"']*|'[^']{0,10000}'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|<[!?/][^>]*(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: First-pass limits: characters of a short and of a long block, link and stop-word densities.
SHORT, LONG, LINKS, LINKS_IN_ARTICLE, STOPS = 70, 200, 0.33, 0.67, 0.2


class _Block:
    __slots__ = ("text", "linked", "part", "skipped", "heading", "label")

    def __init__(self, text: str, linked: int, part: int, skipped: bool, heading: bool):
        self.text, self.linked, self.part, self.skipped, self.heading, self.label = text, linked, part, skipped, heading, None


def _boilerplate(name: str) -> bool:
    """Whether a class or id is made of a boilerplate part and nothing that says otherwise:
    site-footer and comment-list are, related-work is not."""
    parts = {p.lower() for p in _PARTS.findall(name) if not p.isdigit()}
    return bool(parts & BOILERPLATE) and parts <= BOILERPLATE | NEUTRAL


def _kind(tag: str, attributes: str) -> str:
    """skip, header (only headings count), main, or nothing special."""
    if tag in SKIPPED:
        return "skip"
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attributes)} if "=" in attributes else {}
    words = attributes.lower().split()
    if "hidden" in words or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")) or found.get("role", "").lower() in ROLES:
        return "skip"
    if tag in ("html", "body"):
        return ""
    names = {p.lower() for key in ("class", "id") for p in _PARTS.findall(found.get(key, ""))}
    if tag in CONTAINERS and any(_boilerplate(x) for key in ("class", "id") for x in found.get(key, "").split()):
        return "skip"
    if tag == "header" or (tag in CONTAINERS and any({"header"} <= (x := {p.lower() for p in _PARTS.findall(n)}) <= NEUTRAL for n in (*found.get("class", "").split(), found.get("id", "")))):
        return "header"
    if tag in ("article", "main") or found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() == "articlebody":
        return "main"
    return "content" if tag in ("div", "section") and names & CONTENT else ""


def blocks(page: str) -> list[_Block]:
    """The blocks of a page in order.  part: 0 outside any content element, else its number
    (odd-one-out containers named like content count as negative numbers)."""
    out: list[_Block] = []
    stack: list[tuple[str, str, int]] = []  # tag, kind, part outside it
    text: list[str] = []
    linked = parts = part = skip = headers = links = breaks = 0
    heading = False
    opened: dict[str, int] = {}  # open elements of each name

    def flush() -> None:
        nonlocal linked, heading, breaks
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            out.append(_Block(whole, linked, part, skip > 0 or (headers > 0 and not (heading and part)), heading))
        text.clear()
        linked, heading, breaks = 0, False, 0

    def pop(to: int) -> None:
        nonlocal skip, headers, links, part
        while len(stack) > to:
            tag, kind, outside = stack.pop()
            opened[tag] -= 1
            skip -= kind == "skip"
            headers -= kind == "header"
            links -= tag == "a"
            part = outside if kind in ("main", "content") else part

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            piece, at = page[at:], size
        else:
            piece, at = page[at : m.start()], m.end()
        if piece:
            text.append(piece)
            if not piece.isspace():
                breaks = 0
                if links:
                    linked += len(piece.strip())
        if m is None:
            break
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if closing:
            if tag in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1) if opened.get(tag) else ():
                if stack[i][0] == tag:
                    pop(i)
                    break
                if tag not in BLOCKS and stack[i][0] in SCOPES:
                    break
            if tag == "p":
                flush()
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                flush()
            text.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        for i in range(len(stack) - 1, -1, -1) if tag in ENDS else ():
            if stack[i][0] in ENDS[tag]:
                pop(i)
                break
            if stack[i][0] in SCOPES:
                break
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCKS and tag not in RAW):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        kind = _kind(tag, attributes)
        stack.append((tag, kind, part))
        opened[tag] = opened.get(tag, 0) + 1
        skip += kind == "skip"
        headers += kind == "header"
        links += tag == "a"
        heading = heading or tag in HEADINGS
        if kind in ("main", "content"):
            parts += 1
            part = parts if kind == "main" else -parts
    flush()
    return out


def _first_pass(b: _Block) -> None:
    """Structure and link density decide what is bad, stop words and length what is good; what
    has few stop words, as in a language that has none listed, stays undecided."""
    if b.skipped:
        b.label = "bad"
        return
    size = len(b.text)
    links = min(1.0, b.linked / size)
    if links > (LINKS_IN_ARTICLE if b.part else LINKS):
        b.label = "bad"
        return
    if size < SHORT or b.heading:
        return
    words = _WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= STOPS and (size >= LONG or b.part):
        b.label = "good"


def _second_pass(found: list[_Block]) -> None:
    """Undecided blocks take the label of the nearest decided block of their part, a heading
    that of the next; on a tie good wins.  Where a part has no good block, length and link
    density have to do: undecided blocks that are not short are good, or all if none is."""
    by_part: dict[int, list[_Block]] = {}
    for b in found:
        if not b.skipped:
            by_part.setdefault(b.part, []).append(b)
    marked = any(part for part in by_part)
    for part, group in by_part.items():
        undecided = [b for b in group if not b.label]
        if not any(b.label == "good" for b in group) and (part or not marked):
            for b in [b for b in undecided if len(b.text) >= SHORT and not b.heading] or undecided:
                b.label = "good"
        labels = [b.label for b in group]
        n = len(group)
        before, after = [-n] * n, [2 * n] * n
        for i in range(n):
            before[i] = i if labels[i] else before[i - 1] if i else -n
        for i in range(n - 1, -1, -1):
            after[i] = i if labels[i] else after[i + 1] if i < n - 1 else 2 * n
        for i, b in enumerate(group):
            if b.label:
                continue
            left = labels[before[i]] if before[i] >= 0 else None
            right = labels[after[i]] if after[i] < n else None
            if not left and not right:
                b.label = "bad"
            elif b.heading and right:
                b.label = right
            elif i - before[i] == after[i] - i:
                b.label = "good" if "good" in (left, right) else "bad"
            else:
                b.label = left if i - before[i] < after[i] - i else right


def main_text(page: str | None) -> str:
    """The main text: good blocks in page order, one a line.  Where a page marks its article
    (or main) element, blocks outside it are left out; else those outside an element named
    like content, if such an element has good blocks."""
    found = blocks(page or "")
    for b in found:
        _first_pass(b)
    _second_pass(found)
    good = [b for b in found if b.label == "good"]
    for inside in ([b for b in good if b.part > 0], [b for b in good if b.part < 0]):
        if inside:
            good = inside if inside[0].part < 0 else [b for b in good if b.part]
            break
    return "\n".join(b.text for b in good)


def extract(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns named in keep, text and n_chars (its code points) of every row of pages.

    A null or empty page gives an empty text; unclosed and stray tags and quotes are borne, in
    time in proportion to the page; a page of any length is read whole, in one task; repeated
    rows stay, and of equally near neighbours a good one decides."""
    bounded_batches(pages.sparkSession)
    source = pages.select(F.col(page).cast("string").alias("_html"), *[F.col(c) for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    head = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(lean(run), f"{head}, text string, n_chars long")
