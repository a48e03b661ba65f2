"""Main text of web pages by tag-path ratios.

A page becomes blocks: runs of text between block-level tags, each with its root-to-leaf path of
block-level tags. Subtrees that never are content (scripts, navigation) are left out, those that look like clutter (forms, headers, or
by role or names in class and id) unless they hold most of the page's text outside links (article and main beside them weigh more). Per path, text length and punctuation are summed and divided by the number of its
blocks; both ratios are smoothed over the neighbouring blocks and fused by their product. Paths whose best fused value passes the
threshold, in article or main half of it, are content paths: their blocks are the text, with the blocks beside them in the same
element and the headings before them.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Names of HTML elements, and words that pages use for what isn't content.
SKIPPED = frozenset("script style noscript template svg math canvas iframe object embed audio video map select option datalist button textarea input nav footer aside menu dialog title".split())
#: Left out like those, unless they hold most of the page, as do elements that their role, class or id marks.
WRAPPERS = frozenset("form fieldset label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist".split())
CLUTTER = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside widget widgets footer foot masthead topbar "
    "comment comments commentlist respond reply replies disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "pagination pager toc toolbar search form skip hidden copyright legal disclaimer header".split()
)
#: Parts of names that say nothing of what an element holds: 'nav-left' is clutter as 'nav' is, 'has-sidebar' or 'main-header-layout' isn't.
NEUTRAL = frozenset("container area wrapper wrap box list left right top bottom block inner outer links link icons buttons bar items item site primary secondary mobile".split())

#: Levels of a path and of marked elements that are told apart; what lies deeper counts as of the last one. Keeps the time of any page in proportion to its length.
DEPTH, MARKS = 200, 50

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}
#: Fixed: elements whose end tag may be left out before one of their kind, and what they stand in.
_SAME = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "dd": ("dd", "dt"), "dt": ("dd", "dt")}
_AROUND = {"li": ("ul", "ol", "menu"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "dd": ("dl",), "dt": ("dl",)}
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟،।]")


def _named(value: str) -> bool:
    """Whether a class or id has a name made of clutter words alone."""
    return any(any(w in CLUTTER for w in parts) and all(w in CLUTTER or w in NEUTRAL for w in parts) for parts in map(_WORD.findall, value.split()))


def _clutter(tag: str, attributes: str, in_article: bool) -> int:
    """0: content; 1: clutter unless it holds most of the page; 2: clutter."""
    if tag in SKIPPED:
        return 2
    found = int(tag in WRAPPERS or (tag == "header" and not in_article))
    if not attributes or tag in ("html", "body", "article", "main"):
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return 2
        if name == "role" and value in ROLES:
            found = 1
        if name in ("class", "id") and _named(value) and not (in_article and tag in HEADINGS | {"header"}):
            found = 1
    return found


def _without_clutter(raw: list[tuple[tuple[str, ...], list[tuple[str, bool, tuple[int, ...]]]]]) -> list[tuple[tuple[str, ...], str, int]]:
    """Blocks without the parts in marked elements that hold less text outside links than the rest of the page; what is in article or main counts four times there."""
    held: dict[int, int] = defaultdict(int)
    weighed: dict[int, int] = defaultdict(int)
    total = 0
    for path, parts in raw:
        weight = 4 if "article" in path or "main" in path else 1
        for text, linked, marks in parts:
            n = 0 if linked else sum(map(len, text.split()))
            total += weight * n
            for k in marks:
                held[k] += n
                weighed[k] += weight * n
    out = []
    for path, parts in raw:
        use = [(text, linked) for text, linked, marks in parts if all(held[k] > total - weighed[k] for k in marks)]
        text = " ".join(html.unescape("".join(t for t, _ in use)).split())
        if text:
            out.append((path, text, min(sum(len(t) for t, linked in use if linked), len(text))))
    return out


def _tag_end(page: str, at: int) -> int:
    """Position of the ``>`` that ends a tag whose name ends at ``at``: the first outside quotes, or the first of all if a quote isn't closed; -1 if there is none."""
    pos = at
    while m := _QUOTE_OR_END.search(page, pos):
        if m[0] == ">":
            return m.start()
        pos = page.find(m[0], m.end()) + 1
        if not pos:
            break
    return page.find(">", at)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page in one forward pass; kinds: text, open, close. Comments, declarations and the insides of raw elements are left out."""
    at, text, last = 0, 0, page.rfind(">")
    while (i := page.find("<", at)) >= 0 and i + 1 < len(page):
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = len(page) if end < 0 else end + 3
            kind = ""
        elif i > last:
            break  # no tag ends behind this
        else:
            closing = page[i + 1] == "/"
            if m := _NAME.match(page, i + 1 + closing):
                end, kind = _tag_end(page, m.end()) + 1, "close" if closing else "open"
            elif page[i + 1] in "!?/":
                end, kind = page.find(">", i + 1) + 1, ""
            else:
                at = i + 1
                continue
        if i > text:
            yield "text", page[text:i], ""
        at = text = end
        if kind:
            name = m[0].lower()
            yield kind, name, page[m.end() : end - 1]
            if kind == "open" and name in _RAW_END:
                found = _RAW_END[name].search(page, end)
                end = page.find(">", found.end()) + 1 if found else 0
                at = text = end or len(page)
    if text < len(page):
        yield "text", page[text:], ""


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters in links) of each block with text, clutter left out, in page order."""
    out: list[tuple[tuple[str, ...], list[tuple[str, bool, tuple[int, ...]]]]] = []
    stack: list[tuple[str, bool, int]] = []  # tag, whether it is a block, what clutter starts here
    places: dict[str, list[int]] = defaultdict(list)  # where a tag stands in the stack
    scopes: list[int] = []  # where blocks stand
    path: list[str] = []
    parts: list[tuple[str, bool, tuple[int, ...]]] = []  # text, whether in a link, the marked elements around it
    marks: tuple[int, ...] = ()
    cluttered, links, articles, marked, unmarked = 0, 0, 0, 0, 0

    def close_block() -> None:
        if parts:
            out.append((tuple(path[:DEPTH]), parts.copy()))
            parts.clear()

    def pop() -> None:
        nonlocal cluttered, links, articles, marks, unmarked
        tag, block, bad = stack.pop()
        places[tag].pop()
        if block:
            close_block()
            path.pop()
            scopes.pop()
        cluttered -= bad == 2
        if bad == 1 and unmarked:
            unmarked -= 1
        elif bad == 1:
            marks = marks[:-1]
        links -= tag == "a"
        articles -= tag in ("article", "main")

    def top(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    for kind, tag, attributes in tokens(page):
        if kind == "text":
            if not cluttered:
                parts.append((tag, links > 0, marks))
            continue
        if kind == "close":
            if tag in VOID or not places[tag]:
                if tag in BLOCKS:
                    close_block()
                continue
            if tag not in BLOCKS and scopes and scopes[-1] > places[tag][-1]:
                continue  # an inline end tag doesn't close blocks
            at = places[tag][-1]
            while len(stack) > at:
                pop()
            continue
        if tag in ("br", "hr", "wbr"):
            if not cluttered and tag != "wbr":
                parts.append((" ", False, marks))
            if tag == "hr":
                close_block()
            continue
        if tag in VOID or tag in _RAW_END:
            continue
        block = tag in BLOCKS
        if block:
            # end tags that HTML lets pages leave out
            if places["p"] and scopes and stack[scopes[-1]][0] == "p":
                at = scopes[-1]
                while len(stack) > at:
                    pop()
            if tag in _SAME and (at := top(_SAME[tag])) > top(_AROUND[tag]):
                while len(stack) > at:
                    pop()
            close_block()
        bad = _clutter(tag, attributes, articles > 0)
        if attributes.endswith("/") and not block:
            continue
        places[tag].append(len(stack))
        if block:
            scopes.append(len(stack))
            path.append(tag)
        stack.append((tag, block, bad))
        cluttered += bad == 2
        if bad == 1 and len(marks) < MARKS:
            marked += 1
            marks = (*marks, marked)
        elif bad == 1:
            unmarked += 1
        links += tag == "a"
        articles += tag in ("article", "main")
    while stack:
        pop()
    close_block()
    return _without_clutter(out)


def _smooth(values: list[float], width: int = 1) -> list[float]:
    kernel = [math.exp(-(d * d) / (2 * width * width)) for d in range(-2, 3)]
    n, out = len(values), []
    for i in range(n):
        pairs = [(kernel[d + 2], values[i + d]) for d in range(-2, 3) if 0 <= i + d < n]
        out.append(sum(a * b for a, b in pairs) / sum(a for a, _ in pairs))
    return out


def main_text(page: str, threshold: float = 0.2) -> str:
    """Blocks of the article, one a line."""
    found = blocks(page)
    if not found:
        return ""
    sums: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    for path, text, linked in found:
        s = sums[path]
        s[0] += len(text) - linked
        s[1] += len(_PUNCTUATION.findall(text)) if linked < len(text) else 0
        s[2] += 1
        s[3] += len(text)
    length = _smooth([sums[p][0] / sums[p][2] for p, _, _ in found])
    points = _smooth([sums[p][1] / sums[p][2] for p, _, _ in found])
    fused = [a * (1 + b) for a, b in zip(length, points, strict=True)]
    best: dict[tuple[str, ...], float] = {}
    for (p, _, _), v in zip(found, fused, strict=True):
        best[p] = max(best.get(p, 0.0), v)
    # article and main lower the bar for what is in them, and take nothing from other paths
    bar = threshold * max(best.values())
    chosen = {p for p, v in best.items() if v * (2 if "article" in p or "main" in p else 1) >= bar and sums[p][0] > 0} or set(best)
    # items of links alone are a menu, but in the article a list of sources or a linked cell
    menu = [linked > 0.9 * len(text) and not {"article", "main"} & set(path) and path[-1:] in (("li",), ("td",), ("dd",), ("dt",)) and not _PUNCTUATION.search(text) for path, text, linked in found]
    return "\n".join(text for (_, text, _), k, m in zip(found, _with_neighbours([p for p, _, _ in found], chosen), menu, strict=True) if k and not m)


def _with_neighbours(paths: list[tuple[str, ...]], chosen: set[tuple[str, ...]]) -> list[bool]:
    """Which blocks are content: those of chosen paths, the others of their elements that follow on without a gap, and headings before them."""
    keep = [p in chosen for p in paths]
    out = keep.copy()
    for order in (range(len(paths)), range(len(paths) - 1, -1, -1)):
        around: tuple[str, ...] = ()  # the element that holds the last content block
        for k in order:
            if keep[k]:
                around = paths[k][:-1]
            elif around and around[-1] not in ("html", "body") and paths[k][: len(around)] == around:
                out[k] = True
            else:
                around = ()
    near = False
    for k in range(len(paths) - 1, -1, -1):
        near = out[k] or (near and paths[k][-1:] != () and paths[k][-1] in HEADINGS)
        out[k] = near
    # in a page without elements around its blocks: short ones between two of the content
    ends = [k for k, x in enumerate(out) if x]
    for a, b in zip(ends, ends[1:]):
        if b - a <= 4 and all(len(paths[k]) <= len(paths[a]) + 1 and paths[k][: len(paths[a]) - 1] == paths[a][:-1] == paths[b][:-1] for k in range(a + 1, b)):
            out[a + 1 : b] = [True] * (b - a - 1)
    return out


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: id, the columns of ``keep``, ``text`` (empty if none) and ``n_chars``, its code points.

    White space within a block becomes one space, blocks are joined by LF; null html is empty. An empty table gives no rows,
    repeated rows one each. ``keep`` may not name ``text`` or ``n_chars``. No shuffle; other columns aren't read.
    """
    if taken := {"text", "n_chars"} & {id_col, *keep}:
        raise ValueError(f"{', '.join(sorted(taken))}: the result has columns of these names")
    small_batches(pages.sparkSession)
    source = pages.select(F.struct(id_col, *keep).alias("row"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["row"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])

    return source.mapInArrow(run, f"row {dict(source.dtypes)['row']}, text string, n_chars bigint").select("row.*", "text", "n_chars")
