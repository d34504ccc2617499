"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element, in page order; what cannot be main text by its element (scripts,
styles, forms, navigation, headers and footers of the page, ...) or by the name of its class or id (adverts, comments,
sidebars, cookie notices, ...) is left out while stripping, and so is text that mostly consists of links.  Over the lines,
the lengths of each window of ``WINDOW`` lines are summed (line blocks).  A surge point is where a block's sum rises above
``SURGE`` and the next ones don't fall to nothing, a dive point where it falls back to nothing; the text between a surge and
its dive is main text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import tune

WINDOW = 3
#: Characters in a window from which text may begin.
SURGE = 60

#: Elements without main text, elements that break lines, void elements, and elements whose start ends a p.
SKIPPED = {
    "script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "button", "select", "textarea", "input", "label", "fieldset",
    "iframe", "object", "embed", "svg", "canvas", "audio", "video", "map", "dialog", "menu", "math", "datalist", "option", "legend",
}
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | SKIPPED
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of a class, id or role that mark what isn't main text.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|navbar|menu\w*|breadcrumbs?|side-?bar\w*|footer\w*|cookies?\w*|consent|gdpr|notice\w*|popup|modal|newsletter|subscri\w*|"
    r"comments?|comment-?\w*|disqus\w*|replies|respond|related|recommend\w*|share|sharing|social\w*|toolbar|pagination|pager|widget\w*|login|signup|search\w*|masthead|skip-?\w*|tags?|complementary|contentinfo|navigation)(?=$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(?P<close>/)?(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPACE = re.compile(r"\s+")
#: A slash that ends a tag, not an attribute's unquoted value.
_ALONE = re.compile(r"(?:^|[\s\"'])/\s*$")
#: Elements that hold text of the article itself: inside of it, names don't count against them, but those of adverts.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dt", "dd", "figcaption", "table", "td", "th", "tr"}
ADVERT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*)(?=$|[\s_-])", re.I)
_CLOSERS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def lines(page: str) -> list[tuple[str, bool, bool]]:
    """(text, is in a link mostly, is in an article or main element) of each block of ``page`` that may be main text."""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    linked = 0
    depth = {"a": 0, "core": 0}
    skip: list[str] = []  # open elements from the outermost skipped one on
    core: list[str] = []
    count: Counter[str] = Counter()  # those of skip by name

    def end(opened: list[str], tag: str) -> None:
        # what was left open inside ends with it
        while (last := opened.pop()) != tag:
            count[last] -= opened is skip
        count[last] -= opened is skip

    def text(raw: str) -> None:
        nonlocal linked
        if not skip and raw:
            s = entities.unescape(raw) if "&" in raw else raw
            parts.append(s)
            if depth["a"]:
                linked += len(s.strip())

    def cut() -> None:
        nonlocal linked
        line = _SPACE.sub(" ", "".join(parts)).strip()
        if line:
            out.append((line, 2 * linked > len(line), bool(core)))
        parts.clear()
        linked = 0

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["cdata"]:
                text(m["cdata"])
            continue
        if m["close"]:
            if tag in BLOCKS:
                cut()
            if tag == "a":
                depth["a"] = max(0, depth["a"] - 1)
            if skip:
                if count[tag]:
                    end(skip, tag)
                elif tag in ("article", "main", "body", "html"):
                    # an open menu or the like doesn't reach beyond the part of the page it is in
                    skip.clear()
                    count.clear()
            if tag in ("article", "main") and tag in core:
                end(core, tag)
            continue
        if tag in BLOCKS:
            cut()
        elif tag == "br":
            text(" ")
        alone = tag in VOID or bool(_ALONE.search(m["attrs"][-8:]))
        if tag in RAW:
            # browsers don't heed the slash of such a tag; without an end of the element it is heeded here
            closer = None if alone and tag == "svg" else _CLOSERS[tag].search(page, at)
            at = closer.end() if closer else at if alone else len(page)
            continue
        if alone:
            continue
        if skip:
            skip.append(tag)
            count[tag] += 1
            continue
        attrs = m["attrs"]
        names = " ".join("".join(x) for x in _NAMES.findall(attrs)) if "=" in attrs else ""
        page_header = tag == "header" and not core
        noise = ADVERT if core and tag in PROSE else NOISE
        if tag in SKIPPED or page_header or (attrs and _HIDDEN.search(attrs)) or (names and tag not in ("html", "body", "article", "main") and noise.search(names)):
            skip.append(tag)
            count[tag] += 1
        elif tag in ("article", "main"):
            core.append(tag)
        elif tag == "a":
            depth["a"] += 1
    cut()
    return out


def kept(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[bool]:
    """Which lines lie between a surge point and its dive point, given the lines' lengths (0: no main text).

    The sum of the window that begins at a line is its block.  From a line whose block exceeds ``surge`` up to the line
    after which blocks are 0, lines are kept, and so are those before it back to where a window is 0.
    """
    n = len(lengths)
    blocks = [sum(lengths[i : i + window]) for i in range(n)]
    out, i = [False] * n, 0
    while i < n:
        if blocks[i] > surge and lengths[i] > 0:
            before = i - 1
            while before >= 0 and not out[before] and sum(lengths[max(0, before - window + 1) : before + 1]) > 0:
                out[before] = lengths[before] > 0
                before -= 1
            while i < n and blocks[i] > 0:
                out[i] = lengths[i] > 0
                i += 1
        i += 1
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, blocks joined by line feeds; empty if there is none.

    The windows run over all lines, of which those that are mostly links count as empty.  Article and main elements
    decide where they hold at least as much text as the windows find outside of them: then theirs is the main text, at any
    length and links too, and all else isn't.  Otherwise (a teaser, a related card) their lines are lines like others.
    """
    found = lines(page or "")
    by_windows = kept([0 if link else len(line) for line, link, _ in found])
    inside = sum(len(line) for line, link, core in found if core and not link)
    outside = sum(len(line) for (line, _, core), k in zip(found, by_windows, strict=True) if k and not core)
    marked = inside > 0 and inside >= outside
    return "\n".join(line for (line, _, core), k in zip(found, by_windows, strict=True) if (core if marked else k))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html; other columns ignored).

    A null or empty page, and one without main text, has an empty text.  Broken markup is read as far as it goes: an
    element that is never closed reaches to the end of what it is in.  Repeated rows give equal rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    tune(pages.sparkSession)
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
