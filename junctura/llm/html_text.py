"""Main text of web pages by the distribution of line blocks (operator 5).

Markup is stripped so that every block element becomes a line. Elements that are never text of an article (menus, footers,
sidebars, forms, scripts; containers whose whole name says advert, comments and the like) are lines without weight between blank lines, as many as a
window has; so are the bounds of an article. Over the lines slides a window that sums text lengths; where the sum leaves 0 the text surges, where it falls back to 0 it dives,
and what lies between is kept. Link text counts for nothing, but in an article or main element, where all text counts and outside of which nothing is kept.
A container whose name only may tell of such matter (related, notice, banner) goes if most of its text is links, so that it would dive, or if it lists articles.

Names tell by class, and by id on containers that are no section of an article, as headings and sections bear ids of their titles; never on headings,
paragraphs and list items. An article within an element that goes (a card, a reader's comment) goes too, unless the element was left open, or nothing else is found.

Each page is read once from left to right into tags and text; open and closing tags are paired by name.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3

RAW = frozenset("script style noscript template title svg annotation iframe textarea select object canvas video audio".split())
TO_THE_END = frozenset("script style title textarea".split())  # of the page, if they are not closed
#: An opening tag holds at most 60 quoted values here, else it ends at the first >; so no start of a tag is followed far.
TAG = re.compile(r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][\w:-]*)([^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+){0,60}+)>)|</?[a-zA-Z][^<>]*>""")
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul caption".split())
SPACE = frozenset("br td th wbr img input".split())
DROPPED = frozenset("nav footer aside form menu dialog button search".split())
NAMED = frozenset("div section ul ol dl table span figure details header".split())  # whose class may tell; not what holds a paragraph or a heading
COMMENT = frozenset("comment comments disqus reply replies respond".split())
ALWAYS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr newsletter "
    "subscribe subscription signup login comment comments disqus replies sidebar nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer share sharing pagination pager toolbar popup modal overlay copyright".split()
)
MAYBE = frozenset("related recommended recommendations social banner widget notice alert search header respond reply side foot".split())
FILLER = frozenset("box block section container wrapper wrap list area form bar links link posts post items item inner outer main top bottom left right site page content unit slot buttons button text".split())
PART = re.compile(r"[-_]+")
HOLDERS = frozenset("div section ul ol dl table details header figure".split())  # what a name that only may tell can drop
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
TELLING = re.compile(r"class|id|role|hidden|style", re.I)  # other attributes are not looked into
UNSEEN = re.compile(r"display\s*:\s*none", re.I)


def _named(value: str, among: frozenset[str] = ALWAYS) -> int:
    """2 if one of the names in a class or id says what is never text of an article, 1 if one may say so, else 0. All parts of a name must be known."""
    out = 0
    for name in value.lower().split():
        parts = {p.rstrip("0123456789") for p in PART.split(name)} - {""}
        if parts <= ALWAYS | MAYBE | FILLER:
            out = max(out, 2 if parts & among else 1 if parts & (MAYBE | ALWAYS) else 0)
    return out


def _dropped(name: str, rest: str, in_main: bool) -> int:
    """2: the element goes; 1: it goes if most of its text is links or it lists articles; 0: it stays."""
    if name in DROPPED or name == "header" and not in_main:
        return 2
    if not rest or not TELLING.search(rest):
        return 0
    found = {k.lower(): "".join(v) for k, *v in ATTRIBUTE.findall(rest)}
    if "hidden" in found and found["hidden"].lower() != "until-found" or found.get("aria-hidden", "").lower() == "true" or UNSEEN.search(found.get("style", "")):
        return 2
    if name == "article":
        return 2 * (_named(found.get("class", ""), COMMENT) == 2)
    if name not in NAMED:
        return 0
    if found.get("role", "").lower() in ROLES:
        return 2
    title = name == "section" and in_main  # its id may be that of its heading
    out = max(_named(found.get("class", "")), _named(found.get("id", ""), COMMENT if title else ALWAYS))
    return out if out == 2 or name in HOLDERS else 0


def _tokens(page: str) -> list[tuple[str, str, bool]]:
    """The page as (text, "", False) and (name, attributes, closing) with the name in <>, in order. What holds no text (scripts, comments) is left out."""
    out: list[tuple[str, str, bool]] = []
    at, unclosed = 0, set()
    while m := TAG.search(page, at):
        if m.start() > at:
            out.append((page[at : m.start()], "", False))
        at = m.end()
        if m[1] or m[2]:  # a comment, or a declaration
            stop = page.find("-->" if m[1] else ">", m.start() + 2)
            at = len(page) if stop < 0 else stop + (3 if m[1] else 1)
            continue
        name, rest, close = (m[4] or "").lower(), m[5] or "", m[3] == "/"
        if name in RAW and not close and not rest.endswith("/"):
            stop = None if name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if stop:
                at = stop.end()
            elif name in TO_THE_END:
                at = len(page)
            unclosed |= set() if stop else {name}
            if name not in ("script", "style", "template"):
                out.append((" ", "", False))
            continue
        out.append((f"<{name}>", rest, close))
    if at < len(page):
        out.append((page[at:], "", False))
    return out


def _paired(tokens: list[tuple[str, str, bool]]) -> dict[int, int]:
    """Where each element ends that is closed: a closing tag ends the last open one of its name."""
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for i, (x, rest, close) in enumerate(tokens):
        if x[0] == "<" and x[-1] == ">" and len(x) > 2:
            if close:
                if open_.get(x):
                    ends[open_[x].pop()] = i
            elif not rest.endswith("/"):
                open_.setdefault(x, []).append(i)
    return ends


def lines(page: str, reopen: bool = False) -> tuple[list[tuple[str, int, bool | None]], bool]:
    """The lines of a page as (text, length outside links, in an article or main element; null: of what goes), and whether it has such an element. reopen: an article begins even within an element that goes."""
    out: list[tuple[str, int, bool | None]] = []
    text: list[str] = []
    blank = [("", 0, False)] * (2 * WINDOW)
    tokens = _tokens(page)
    ends = _paired(tokens)
    is_tag = lambda x: x[0] == "<" and x[-1] == ">" and len(x) > 2
    articles = [i for i, (x, rest, close) in enumerate(tokens) if x in ("<article>", "<main>") and not close and _dropped(x[1:-1], rest, True) < 2]
    plain = link = main = 0
    found = False
    maybe_end, maybe_at = -1, 0

    def end():
        nonlocal plain
        if text:
            t = " ".join("".join(text).split())
            if t:
                out.append((t, plain, main > 0))
            text.clear()
        plain = 0

    i = -1
    while (i := i + 1) < len(tokens):
        x, rest, close = tokens[i]
        if not is_tag(x):
            t = html.unescape(x)
            text.append(t)
            if not link:
                plain += len(t.strip())
            continue
        name = x[1:-1]
        if name in BLOCK:
            end()
            if close:
                link = 0  # an <a> that was left open reaches no further
        elif name in SPACE:
            text.append(" ")
        mark = 0 if close or rest.endswith("/") else _dropped(name, rest, main > 0)
        if mark == 2:
            end()
            link = 0
            stop = ends.get(i, len(tokens))
            inside = bisect.bisect(articles, i)
            if (reopen or i not in ends) and inside < len(articles) and articles[inside] < stop:
                stop = articles[inside] - 1  # the article begins in what was left open
            gone = " ".join(html.unescape(" ".join(t for t, *_ in tokens[i:stop] if not is_tag(t))).split())
            out.extend([*blank[:WINDOW], (gone, 0, None), *blank[:WINDOW]])
            i = stop
        elif name == "a":
            link = 0 if close else 1  # a second <a> ends the first
        elif name in ("article", "main"):
            if not close:
                out.extend(() if main else blank)
                main, found = main + 1, True
            else:
                main = max(0, main - 1)
                if not main:
                    out.extend(blank)
        elif mark == 1 and maybe_end < i and i in ends:
            end()
            maybe_end, maybe_at = ends[i], len(out)
            listed = bisect.bisect(articles, maybe_end) - bisect.bisect(articles, i)
            if 0 < listed < len(articles) and not reopen:  # cards, or comments of readers, beside an article
                out.extend(blank)
                i, maybe_end = maybe_end, -1
                continue
        if i == maybe_end:
            end()
            size = sum(len(t) for t, _, inside in out[maybe_at:] if inside is not None)
            if size and 2 * sum(n for _, n, _ in out[maybe_at:]) < size:
                out[maybe_at:] = [*blank[:WINDOW], *((t, 0, None) for t, *_ in out[maybe_at:]), *blank[:WINDOW]]
    end()
    return out, found


def stretches(length: list[int]) -> list[tuple[int, int]]:
    """Where the windows' sums leave 0 and where they fall back to it: (first line, line after the last) of each stretch."""
    window = sum(length[: WINDOW - 1])
    found, begin = [], None
    for i in range(len(length)):
        window += length[i + WINDOW - 1] if i + WINDOW - 1 < len(length) else 0
        window -= length[i - WINDOW] if i >= WINDOW else 0
        if window and begin is None:
            begin = i  # surge
        elif not window and begin is not None:
            found.append((begin, i))  # dive
            begin = None
    return found if begin is None else [*found, (begin, len(length))]


def main_text(page: str | None) -> str:
    """The main text of one page, its blocks parted by two line ends; empty if there is none."""
    for reopen in (False, True):
        rows, found = lines(page or "", reopen)
        length = [(len(t) if found else n) if inside or not found else 0 for t, n, inside in rows]
        kept = [t for a, b in stretches(length) for t, *_ in rows[a:b] if t]
        if kept:
            break
    return "\n\n".join(kept)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """row (a struct of the columns but the html), text and n_chars for each row of pages.

    A null or empty page has an empty text. Repeated rows stay, and names of columns may clash. Each page is worked on alone, whatever its length; an empty table gives no rows.
    """
    rest = [pages[c] for c in pages.columns if c != column]
    source = pages.select(F.struct(*rest).alias("row"), pages[column].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])

    return source.mapInArrow(run, T.StructType([source.schema["row"], *T.StructType.fromDDL("text string, n_chars long").fields]))
