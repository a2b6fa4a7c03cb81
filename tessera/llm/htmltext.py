"""Main text of HTML pages by line-block distribution.

Markup is stripped into one line per block; elements that are never article text (menus, footers,
forms, scripts, adverts, comments ...) weigh nothing. Text weights are summed over sliding windows of
``WINDOW`` lines; a line where the sum rises over the threshold is a surge, one where it falls below a
dive, and all text between them is kept. Where the page marks its article, only lines in it weigh.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import texts

WINDOW, SURGE = 3, 80

#: Quotes hold a value only behind an equals sign; stray ones are characters like others.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|math|iframe|object|select)\b[^>]*(?:/>|>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^<>])*))(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_MAIN = frozenset(("article", "main"))
_NEVER = frozenset("nav footer aside form button dialog menu fieldset head audio video canvas datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads adv advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies respond responses discussion widget widgets "
    "toolbar pagination pager paging copyright legal disclaimer banner masthead search form tags".split()
)


def _role(name: str, attributes: str, in_main: bool) -> str:
    """What an opening element is: ``main``, ``skip`` or plain."""
    if name in _NEVER or name == "header" and not in_main:
        return "skip"
    marked = name in _MAIN
    if attributes.strip(" /"):
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key == "role" and value.lower() in ("main", "article") or key == "itemprop" and value.lower() == "articlebody":
                marked = True
            elif name in ("html", "body") or marked:
                continue
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                return "skip"
            elif key == "role" and value.lower() in _ROLES:
                return "skip"
            elif key in ("class", "id"):
                words = {w.lower() for w in _WORD.findall(value)}
                if words & _NAMES or not in_main and words & {"header", "topbar"}:
                    return "skip"
    return "main" if marked else ""


def blocks(html: str) -> list[tuple[str, int, bool]]:
    """(text, characters in links, inside the marked article) for each block that isn't skipped."""
    out, text, linked, at = [], [], 0, 0
    stack: list[tuple[str, str]] = []
    skip = main = links = 0

    def flush():
        nonlocal text, linked
        if text:
            line = " ".join("".join(text).split())
            if line:
                out.append((line, min(linked, len(line)), main > 0))
            text, linked = [], 0

    def take(piece):
        nonlocal linked
        if piece and not skip:
            piece = unescape(piece)
            text.append(piece)
            if links:
                linked += len(piece.strip())

    for m in _TOKEN.finditer(html):
        take(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name not in _INLINE:
            flush()
        if m[2]:
            if any(n == name for n, _ in reversed(stack)):
                while stack:
                    n, role = stack.pop()
                    if role == "main" or n != name and n not in _INLINE:
                        flush()
                    skip -= role == "skip"
                    main -= role == "main"
                    links -= n == "a"
                    if n == name:
                        break
        elif name not in _VOID and not m[4].endswith("/"):
            if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == name and not stack[-1][1]:
                stack.pop()
            role = _role(name, m[4], main > 0)
            if role:
                flush()
            stack.append((name, role))
            skip += role == "skip"
            main += role == "main"
            links += name == "a"
    take(html[at:])
    flush()
    return out


def spans(weight: list[int], bridge: list[bool]) -> list[tuple[int, int]]:
    """[surge, dive) line spans: window sums rise to the level at a surge and fall below it at a dive.

    Spans begin and end at lines with a weight of their own. Two that have only ``bridge`` lines
    between them are one, so short lines between long ones stay.
    """
    half, n = WINDOW // 2, len(weight)
    sums = [sum(weight[max(0, i - half) : i + half + 1]) for i in range(n)]
    level = min(SURGE, max(sums, default=0) / 2)
    out: list[tuple[int, int]] = []
    at = 0
    while at < n:
        if not weight[at] or sums[at] < level:
            at += 1
            continue
        end = at
        while end < n and sums[end] >= level:
            end += 1
        dive = end
        while not weight[dive - 1]:
            dive -= 1
        if out and all(bridge[out[-1][1] : at]):
            at = out.pop()[0]
        out.append((at, dive))
        at = end
    return out


def main_text(html: str | None) -> str:
    """The lines from surge to dive points, joined by one space; '' for null, empty and textless pages.

    A line weighs its text less twice its links. Where the page marks its article, lines in it weigh
    their text and ``SURGE`` more, others nothing.
    """
    lines = blocks(html) if html else []
    if any(inside for _, _, inside in lines):
        weight = [len(t) + SURGE if inside else 0 for t, _, inside in lines]
        bridge = [inside for _, _, inside in lines]
    else:
        weight = [max(0, len(t) - 2 * linked) for t, linked, _ in lines]
        bridge = [2 * linked <= len(t) for t, linked, _ in lines]
        # a link alone between two texts belongs to them; several in a row are a list of links
        bridge = [b or bridge[max(0, i - 1)] and bridge[min(len(bridge) - 1, i + 1)] for i, b in enumerate(bridge)]
    return " ".join(lines[i][0] for a, b in spans(weight, bridge) for i in range(a, b) if bridge[i] or weight[i])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Append ``text`` and ``n_chars`` (its code points) to every row; one narrow Arrow pass.

    Null, empty and textless pages give '' and 0; nothing is capped, and repeated rows get equal
    results. Existing columns of the two names are replaced (``html_col`` may not be one of them).
    """
    rest = pages.drop("text", "n_chars")

    def run(batches):
        for batch in batches:
            found = [main_text(x) for x in texts(batch.column(html_col))]
            made = [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "text", "n_chars"])

    schema = type(rest.schema)(rest.schema.fields[:]).add("text", "string").add("n_chars", "long")
    return rest.mapInArrow(run, schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.col("n_chars"))
