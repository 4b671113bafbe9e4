"""HTML extraction: the main text of a page by two passes of block rules.

First pass: every block is judged alone by the structure it stands in, its length, link density and
stop-word density; blocks inside menus, notices, adverts, forms or comments never count as text.
Second pass: blocks too short or too middling to judge inherit the label of the nearest decided
blocks around them. Standing inside an article is one feature more: such blocks inherit from blocks
inside articles alone and count as text where none of these is decided; it decides no block of length.

Null and empty pages give the empty text. Broken markup (unclosed tags, references without a
semicolon, stray brackets) is read as browsers would roughly do. Pages of any length are read whole.
One row out per row in: rows that repeat an id, and rows whose id or url is null, keep theirs and are
read like any other; an empty table gives no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their role in HTML.
_RAW = frozenset("script style noscript template textarea title iframe svg select option canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_OUTSIDE = frozenset("nav footer aside form menu dialog button fieldset head".split())
_MAIN = frozenset("article main".split())
_CLOSES_P = _BLOCK - {"html", "body", "head"}
# Words of class and id attributes that mark what is not main text, wherever in a name they stand,
_MARKS = frozenset(
    "advert adverts advertisement advertising adbox sponsored cookie cookies gdpr newsletter sidebar nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead topbar toolbar comments commentlist disqus pagination".split()
)
# words that mark it alone or with the words below them ("form", "search-form", but not "form-factor"),
_WEAK_MARKS = frozenset(
    "ad ads adv banner sponsor sponsors promo promotion promotions consent notice notices alert alerts subscribe subscription signup widget widgets menu menus comment "
    "respond reply replies share sharing social related recommended recommendations popup modal overlay login search pager skip hidden disclaimer form forms".split()
)
# and words of layout.
_LAYOUT_WORDS = frozenset(
    "box bar block list item items container wrapper wrap area section panel slot unit zone row group holder module inner outer body text title message icons icon links link "
    "button buttons btn input field label top bottom left right main site page global primary secondary header content post posts article articles story stories recent "
    "entries archive archives categories category tags tag meta thread to".split()
)
_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form".split())
_CONTENT = frozenset("article post entry story content main".split())
# Common function words of English, German, French and Spanish.
_STOP = [
    frozenset(words.split())
    for words in (
        "the of and a to in is was that for it as with on be by at this are from or an have not had but they his her which you we were been has their one all there can if will would what so",
        "der die das und in zu den mit von ist des im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde",
        "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou mais comme on son elle nous vous leur été aux ses cette être ont fait si sans tout",
        "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde",
    )
]
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
#: The low bound inside an article, for what doesn't end as sentences do: lists of wares and keywords have next to no function words.
STOP_INSIDE = 0.05
_SENTENCE_ENDS = ".!?…:;\"'”’»)。！？"
MAX_LINKS = 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<([/]?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>", re.S)
_LOOSE = re.compile(r"<([/]?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_KEPT_ATTRIBUTES = frozenset(("class", "id", "role", "style", "aria-hidden", "hidden"))
_WORDS = re.compile(r"[^\W\d_]+")
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _attributes(inside: str) -> dict[str, str]:
    """The attributes of a tag that tell what it holds; names and values are read one after the other, so no value counts as a name."""
    found = {}
    for name, *values in _ATTR.findall(inside):
        if name.lower() in _KEPT_ATTRIBUTES:
            found.setdefault(name.lower(), next(filter(None, values), ""))
    return found


def _marked(names: str, in_main: bool) -> bool:
    """Whether one of the blank-separated class names or ids marks what is not main text."""
    for name in names.split():
        words = {w.lower() for w in _PIECES.findall(name) if len(w) > 1}
        if words & _MARKS or "header" in words and not in_main and words <= _LAYOUT_WORDS:
            return True
        if words & _WEAK_MARKS and words <= _WEAK_MARKS | _LAYOUT_WORDS:
            return True
    return False


def _apart(name: str, attributes: dict[str, str], in_main: bool) -> bool:
    """Whether an element holds no main text, by its name and attributes."""
    if name in _OUTSIDE or name == "header" and not in_main:
        return True
    if not attributes or name in ("html", "body") or name in _MAIN:
        return False
    return (
        _marked(f"{attributes.get('class', '')} {attributes.get('id', '')}", in_main)
        or attributes.get("role", "").lower() in _ROLES
        or "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I) is not None
    )


class _Block:
    __slots__ = ("text", "links", "apart", "inside", "hinted", "heading")

    def __init__(self, text: str, links: int, apart: bool, inside: bool, hinted: bool, heading: bool) -> None:
        self.text, self.links, self.apart, self.inside, self.hinted, self.heading = text, links, apart, inside, hinted, heading


def blocks(page: str) -> Iterator[_Block]:
    """The blocks of a page in order, with white space collapsed and references decoded."""
    stack: list[tuple[str, bool, bool, bool]] = []  # name, apart, inside main, hinted
    parts: list[str] = []
    links = in_link = 0
    pos, n, last = 0, len(page), page.rfind(">")
    unended: set[str] = set()  # raw elements that no end tag follows any more
    opened: Counter[str] = Counter()

    def flush() -> Iterator[_Block]:
        nonlocal links
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            top = stack[-1] if stack else ("", False, False, False)
            yield _Block(text, links, top[1], top[2], top[3], any(s[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for s in stack[-3:]))
        links = 0

    while pos < n:
        # A bracket that begins no tag is text; behind the last closing bracket all is.
        m, at = None, page.find("<", pos)
        while 0 <= at < last and not (m := _TOKEN.match(page, at) or _LOOSE.match(page, at)):
            at = page.find("<", at + 1)
        if not m and (at := page.find("<!--", max(pos, last))) >= 0:
            m = _TOKEN.match(page, at)
        text = page[pos : m.start() if m else n]
        if text:
            parts.append(text)
            if in_link:
                links += len(" ".join(text.split()))
        if not m:
            break
        pos = m.end()
        if m.group(2) is None:
            continue
        name, closing = m.group(2).lower(), m.group(1)
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name in _RAW and not closing:
            if not m.group(3).endswith("/") and name not in unended:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, pos)
                if not end:
                    unended.add(name)
                pos = end.end() if end else (n if name in ("script", "style") else pos)
            continue
        if name in _BLOCK:
            yield from flush()
            in_link = 0
        if name in _VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    opened.subtract(x[0] for x in stack[k:])
                    del stack[k:]
                    break
                if name not in _BLOCK and stack[k][0] in _BLOCK:
                    break
            continue
        if name in _CLOSES_P and stack:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ("p", name if name in ("li", "dt", "dd", "tr", "td", "th", "option") else "p"):
                    opened.subtract(x[0] for x in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] in _BLOCK:
                    break
        top = stack[-1] if stack else ("", False, False, False)
        opened[name] += 1
        if name in _BLOCK or m.group(3):
            attributes = _attributes(m.group(3)) if m.group(3) else {}
            named = f"{attributes.get('class', '')} {attributes.get('id', '')}" if name in ("div", "section", "td") else ""
            hinted = top[3] or not _CONTENT.isdisjoint(w.lower() for w in _PIECES.findall(named))
            stack.append((name, top[1] or _apart(name, attributes, top[2]), top[2] or name in _MAIN, hinted))
        else:
            stack.append((name, top[1], top[2], top[3]))
    yield from flush()


def _density(b: _Block) -> float:
    words = _WORDS.findall(b.text.lower())
    return max(sum(w in stop for w in words) for stop in _STOP) / max(1, len(words))


def _alone(b: _Block, density: float, known: bool) -> str:
    """First pass: good, bad, near (middling) or short. Where no block reads as a known language, density tells nothing."""
    n = len(b.text)
    if b.apart:
        return "bad"
    if "©" in b.text and n < LONG and density < (STOP_LOW if b.inside else STOP_HIGH):
        return "bad"  # a notice reads unlike a sentence that mentions one
    if b.inside and n < SHORT and not b.heading and b.links:
        return "short"  # a cell or an item of an article may be a link as a whole
    if b.links > MAX_LINKS * n:
        return "bad"
    if b.heading:
        return "short"
    if n < SHORT:
        return "bad" if b.links and not b.inside else "short"
    if density >= STOP_HIGH:
        return "good" if n > LONG else "near"
    if density >= STOP_LOW or b.hinted or b.inside and (not known or density >= STOP_INSIDE or b.text[-1] in _SENTENCE_ENDS):
        return "near"
    return "bad"


def _nearest(labels: list[str | None]) -> list[str | None]:
    """The last decided label up to each place."""
    out, last = [], None
    for x in labels:
        last = x or last
        out.append(last)
    return out


def _around(labels: list[str | None]) -> list[tuple[str | None, str | None]]:
    return list(zip(_nearest(labels), _nearest(labels[::-1])[::-1]))


def extract_text(page: str | None) -> str:
    """The main text: its blocks joined by newlines."""
    found = list(blocks(page or ""))
    has_main = any(b.inside and not b.apart for b in found)
    densities = [_density(b) for b in found]
    known = any(d >= STOP_LOW and len(b.text) >= SHORT and not b.apart for b, d in zip(found, densities))
    labels = [_alone(b, d, known) for b, d in zip(found, densities)]
    if not has_main and not any(x in ("good", "bad") for x in labels):
        return "\n".join(b.text for b in found)
    decided = [x if x in ("good", "bad") else None for x in labels]
    everywhere = _around(decided)
    # What stands inside an article is judged by what else does, not by the menus around it.
    within = _around([x if b.inside and not b.apart else None for b, x in zip(found, decided)])
    keep = []
    for b, label, sides, inner in zip(found, labels, everywhere, within):
        prev, nxt = inner if b.inside else sides
        if label == "near":
            label = "bad" if prev == nxt == "bad" and not b.hinted else "good"
        elif label == "short" and b.inside:
            label = "bad" if "bad" in (prev, nxt) and "good" not in (prev, nxt) else "good"
        elif label == "short":
            label = "good" if prev == nxt == "good" or b.heading and nxt == "good" or b.hinted and "good" in (prev, nxt) else "bad"
        if label == "good":
            keep.append(b.text)
    return "\n".join(keep)


def extract_pages(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [extract_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "id long, url string, text string").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op5_block_rules_extraction(pages: DataFrame) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract_pages(pages, "page_id", "url", "html").withColumn("n_chars", F.length("text").cast("long"))
