"""Main text of web pages by tag-path ratios.

A page is read as a sequence of tags and text. Text between block tags is a block; its path is the list of open block
elements, with their classes. For each path the text length, punctuation and link text of its blocks are summed. The length and
the punctuation of a block on average, and the share of text that isn't a link, are fused to a ratio, for the path itself and
for each of its ancestors with all that they hold; from the root down, a path's ratio is smoothed with that of what encloses
it. One more signal is fused in: what elements say that they are, by tag, role, or a word of class or id. An article or main part
counts ``sign`` times, a menu, header, footer, sidebar, notice, advert, form or comments section 1 / ``sign`` squared, but less
the more of the page's text the element holds, as an element around all of it is no aside. Blocks stay whose path has
``share`` of the page's best score.

Then short blocks between blocks that stay (items, cells), and a heading before one, stay too if nothing speaks against them. Scripts,
styles, form controls and hidden elements aren't text. The scanner is linear in the page's length, whatever the markup.

Defined results: null html counts as empty; a page without content gives an empty text; tags that never end (the rest of
the page belongs to them) and unknown character references are handled as browsers do, but for a quote that never ends, which ends with its tag;
repeated rows give a row each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ExtractParams:
    """share: of the page's best score that a path needs; sign: how much a marked article counts; link: what link text
    counts against other text."""

    share: float = 0.25
    sign: float = 400.0
    link: float = 0.002


_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTR = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(\"|'|[^\s>\"'][^\s>]*+|(?=>)))?)")
_SPLIT = re.compile(r"[^a-z0-9]+")
_HEADING = re.compile(r"h[1-6]")
_PUNCT = re.compile(r"[.,;:!?…。，、！？؟]")

# Fixed by the HTML standard: elements without content, elements of raw text, phrasing elements, and what ends an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ALIKE = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd dt", ("dl",)), "dd": ("dd dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

#: Elements that aren't text, and those that say that they are no part of the article; words of class, id and role that say the same.
SKIP = RAW | frozenset("head button select noscript template svg canvas object audio video".split())
ASIDE = frozenset("nav footer aside menu dialog".split())
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer "
    "comment comments commentlist disqus reply replies respond share sharing social related recommended widget popup modal overlay newsletter subscribe signup login search pagination pager toolbar masthead skip contentinfo complementary".split()
)


PLAIN, ARTICLE, LISTED, APART = range(4)  # what an element says: nothing, the article, apart by a word, apart by its tag


class Path:
    """A path of open elements: sums over its own blocks, and (whole) over all below."""

    def __init__(self, up: Path | None, tag: str, mark: int):
        self.up, self.tag, self.mark, self.below = up, tag, mark, {}
        self.inside = mark == ARTICLE or up is not None and up.inside
        self.own, self.whole = [0, 0, 0, 0], [0, 0, 0, 0]  # blocks, characters, punctuation marks, characters of links
        self.smooth = self.says = self.score = 0.0


def _attributes(html: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int]:
    """The attributes from ``at`` on and the place after the tag, or the end of the page."""
    found: dict[str, str] = {}
    while m := _ATTR.match(html, at):
        at = m.end()
        if m[1]:
            return found, at
        value = m[3] or ""
        if value in ("'", '"'):
            if at > last[value]:  # a quote that never ends
                stop = html.find(">", at)
                return found, stop + 1 if stop >= 0 else len(html)
            stop = html.index(value, at)
            value, at = html[at:stop], stop + 1
        found.setdefault(m[2].lower(), value)
    return found, len(html)


def _hidden(at: dict[str, str]) -> bool:
    return "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "")


def _mark(tag: str, at: dict[str, str], inside: bool) -> int:
    if tag in ASIDE or tag == "header" and not inside:
        return APART
    if not inside and (tag in ("article", "main") or at.get("role") == "main"):
        return ARTICLE
    if tag == "form":
        return LISTED
    if not at or tag in ("body", "html", "article", "main"):
        return PLAIN
    words = set(_SPLIT.split(f"{at.get('class', '')} {at.get('id', '')} {at.get('role', '')}".lower()))
    return LISTED if words & APART_WORDS or "header" in words and not inside else PLAIN


def blocks(html: str) -> tuple[list[Path], list[tuple[Path, str, int]]]:
    """All paths, outer ones first, and (path, text, characters of links) of every block in page order."""
    paths = [Path(None, "", PLAIN)]
    out: list[tuple[Path, str, int]] = []
    stack: list[tuple[str, Path, bool, list | None]] = []  # tag, path, skipped, the text around a marked phrase
    count: Counter[str] = Counter()  # open elements by tag
    text: list[tuple[str, bool]] = []
    last = {q: html.rfind(q) for q in ("'", '"')}

    def top():
        return stack[-1][1] if stack else paths[0]

    def say(piece: str):
        if piece and not (stack and stack[-1][2]):
            text.append((unescape(piece) if "&" in piece else piece, count["a"] > 0))

    def flush():
        if text:
            words = " ".join("".join(t for t, _ in text).split())
            if words:
                linked = sum(len(" ".join(t.split())) for t, of_link in text if of_link)
                out.append((top(), words, min(linked, len(words))))
            text.clear()

    def close(k: int):
        nonlocal text
        while len(stack) > k:
            if stack[-1][0] not in INLINE or stack[-1][3] is not None:
                flush()
            tag, _, _, around = stack.pop()
            count[tag] -= 1
            if around is not None:
                text = around

    def close_last(tags: tuple[str, ...], within) -> None:
        if any(count[t] for t in tags):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in tags:
                    return close(k)
                if within(stack[k][0]):
                    return None

    at = 0
    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            say(html[at:])
            break
        mark = html[start + 1 : start + 2]
        if mark in ("!", "?"):
            say(html[at:start])
            end, size = (html.find("-->", start + 2), 3) if html.startswith("<!--", start) else (html.find(">", start), 1)
            at = end + size if end >= 0 else len(html)
            continue
        m = _NAME.match(html, start + 1 + (mark == "/"))
        if not m:
            say(html[at : start + 1])
            at = start + 1
            continue
        say(html[at:start])
        tag = m[0].lower()
        attrs, at = _attributes(html, m.end(), last)
        if at == len(html) and html[-1] != ">":
            break
        if mark == "/":
            if count[tag]:
                close_last((tag,), lambda _: False)
            elif tag not in INLINE:
                flush()
            continue
        if tag == "a":
            close_last(("a",), lambda t: t not in INLINE)
            if "href" not in attrs and not _hidden(attrs):
                continue  # the name of a place, often never closed
        if tag in VOID:
            if tag not in INLINE:
                flush()
            elif tag == "br":
                say(" ")
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            stop = html.find(">", end.start()) if end else -1
            at = stop + 1 if stop >= 0 else len(html)
            continue
        if tag in CLOSES_P:
            close_last(("p",), lambda t: t not in INLINE)
        if tag in ALIKE:
            same, within = ALIKE[tag]
            close_last(tuple(same.split()), within.__contains__)
        up = top()
        skip = bool(stack and stack[-1][2]) or tag in SKIP or _hidden(attrs)
        says = PLAIN if skip else _mark(tag, attrs, up.inside)
        path, around = up, None
        if tag not in INLINE:
            flush()
        elif says in (LISTED, APART):  # a phrase apart is a block of its own
            around, text = text, []
            around.append((" ", False))
        if not skip and (tag not in INLINE or around is not None):
            key = (tag, says, " ".join(sorted(attrs.get("class", "").lower().split())))
            if (path := up.below.get(key)) is None:
                path = up.below[key] = Path(up, tag, says)
                paths.append(path)
        stack.append((tag, path, skip, around))
        count[tag] += 1
    close(0)
    flush()
    return paths, out


def _ratio(sums: list[int], p: ExtractParams) -> float:
    """Fused ratio: length times one plus punctuation of a block, at their root, times the share of what isn't a link."""
    n, chars, marks, links = sums
    return (chars / n * (1 + marks / n)) ** 0.5 * (1 - (1 - p.link) * links / chars) if n else 0.0


def score(paths: list[Path], found: list[tuple[Path, str, int]], p: ExtractParams) -> None:
    """Sums, smoothed ratios and scores of all paths that hold text."""
    for path, text, links in found:
        for k, x in enumerate((1, len(text), len(_PUNCT.findall(text)), links)):
            path.own[k] += x
            path.whole[k] += x
    spoken = 0  # characters that are neither of links nor in elements apart by their tag
    for path in reversed(paths):
        if path.up is None:
            spoken = path.whole[1] - path.whole[3]
        elif path.mark != APART:
            for k in range(4):
                path.up.whole[k] += path.whole[k]
    for path in paths:
        if not path.whole[0]:
            continue
        ratio = _ratio(path.whole, p)
        path.smooth = (path.up.smooth * ratio) ** 0.5 if path.up and path.up.smooth else ratio
        path.says = path.up.says if path.up else 0.0  # as a power of sign
        if path.mark == ARTICLE:
            path.says += 1 if path.says > -2 else 0
        elif path.mark == LISTED:
            path.says -= 2 * (1 - min(1.0, (path.whole[1] - path.whole[3]) / max(1, spoken)) ** 4)
        elif path.mark == APART:
            path.says -= 2
        if path.own[0]:
            around = path.up.smooth if path.up and path.up.smooth else ratio
            path.score = (around * _ratio(path.own, p)) ** 0.5


def main_text(html: str | None, p: ExtractParams = ExtractParams()) -> str:
    paths, found = blocks(html or "")
    if not found:
        return ""
    score(paths, found, p)
    least = p.share * max(path.score * p.sign ** (path.says / 2) for path, _, _ in found)
    keep = [path.score * p.sign**path.says >= least for path, _, _ in found]
    says = max(path.says for (path, _, _), k in zip(found, keep, strict=True) if k) if any(keep) else 0.0
    could = [k or path.says >= min(says, 0.0) and 2 * links < len(text) for (path, text, links), k in zip(found, keep, strict=True)]
    stays = list(keep)
    for k in range(len(found) - 2, -1, -1):  # a heading goes with what follows it
        stays[k] = stays[k] or could[k] and stays[k + 1] and _HEADING.fullmatch(found[k][0].tag) is not None
    if any(keep):  # what lies between two blocks of one mind stays, unless something speaks against it
        first, final = keep.index(True), len(keep) - 1 - keep[::-1].index(True)
        for k in range(first, final):
            stays[k] = stays[k] or could[k] and found[k][0].says >= min(found[first][0].says, found[final][0].says)
    return "\n".join(text for (_, text, _), k in zip(found, stays, strict=True) if k)


def extract(pages: DataFrame, p: ExtractParams = ExtractParams()) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [main_text(h.as_py(), p) for h in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extract(spark, sf_dir: str) -> DataFrame:
    from setforge.llm.common import table

    return extract(table(spark, sf_dir, "pages"))
