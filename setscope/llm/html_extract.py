"""Main text of web pages: site templates are found by counting element subtrees per host, and removed."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from setscope.llm.text import chunks
from setscope.session import materialize

#: A subtree is template if it stands on so many differing pages of its host, and on the square root of their number.
LEAST_PAGES = 5
#: Recurring subtrees that are broadcast to the pages; above, pages and subtrees are joined by host.
BROADCAST_SUBTREES = 200_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)"
                    r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)")
_RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg",
        "math", "object", "select"}
#: Those that the end of their parent does not close.
_OPEN_ENDED = {"script", "style", "title", "textarea"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CONTAINERS = {"address", "aside", "center", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form",
               "header", "menu", "nav", "ol", "section", "table", "ul"}
_BLOCKS = _HEADINGS | _CONTAINERS | {
    "article", "blockquote", "body", "caption", "dd", "dt", "figcaption", "head", "hgroup", "hr", "html", "legend", "li",
    "main", "optgroup", "option", "p", "pre", "search", "summary", "tbody", "tfoot", "thead", "tr"}
_SPACED = {"br", "img", "td", "th"}
#: Start tags that end an open element of the listed kinds, up to the given boundaries.
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
            "body": ({"head"}, {"html"})}
_PARAGRAPH_ENDS = _BLOCKS - {"body", "head", "html", "caption", "tbody", "thead", "tfoot", "tr", "legend", "option", "optgroup"}
_SCOPES = {"td", "th", "table", "button", "body", "html"}

#: Elements, roles and words of class and id that mark what is not article text.
_DROPPED = {"aside", "button", "canvas", "datalist", "dialog", "fieldset", "footer", "form", "head", "input", "label",
            "menu", "nav", "search"}
_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar",
          "navigation", "search", "tablist", "toolbar"}
_NAMES = {"ad", "ads", "adsense", "adslot", "advert", "adverts", "advertisement", "advertising", "alert", "aside", "banner",
          "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "dfp", "disqus",
          "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
          "notices", "notification", "outbrain", "pager", "pagination", "popup", "promo", "promoted", "recommended",
          "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
          "sponsored", "subscribe", "taboola", "toolbar", "topbar"}
_HEADER_NAMES = {"header"}
#: First words of class names that tell of the surroundings instead ("has-sidebar").
_ABOUT = {"has", "hide", "no", "show", "with", "without"}


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


def _mark(tag: str, source: str) -> str:
    """``hard`` for an element that never holds article text, ``soft`` for a header (its headings may stay), or nothing."""
    if tag in _DROPPED:
        return "hard"
    soft = "soft" if tag == "header" else ""
    if not source or source.isspace():
        return soft
    if _HIDDEN.search(_ATTRIBUTE.sub(" ", source).lower()):
        return "hard"
    if "=" not in source:
        return soft
    attributes = _attributes(source)
    if attributes.get("role", "").lower() in _ROLES or attributes.get("aria-hidden", "").lower() == "true" or \
            "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return "hard"
    if tag in ("html", "body"):
        return soft
    words = set()
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        own = [w.lower() for w in _WORD.findall(name)]
        if own and own[0] not in _ABOUT:
            words.update(own, ["".join(own)])
    if words & _NAMES:
        return "hard"
    if words & _HEADER_NAMES and tag not in _HEADINGS:
        return "soft"
    return soft


class Page:
    """Blocks of a page, and the subtrees that may be template. One pass, no recursion, whole text."""

    def __init__(self, source: str):
        #: Text, main part (article number, -1 for main, -2 for its headings, 0 elsewhere) of every block that no mark drops.
        self.blocks: list[tuple[str, int]] = []
        #: Hash and range of blocks of every container with text.
        self.subtrees: list[tuple[int, int, int]] = []
        self._text: list[str] = []
        self._stack: list[list] = []
        #: Places of the open elements in the stack, by tag.
        self._open: defaultdict[str, list[int]] = defaultdict(list)
        self._unclosed: set[str] = set()
        self._hard = self._soft = self._heading = self._articles = self._part = 0
        self._read(source)

    def _read(self, source: str) -> None:
        at, last = 0, source.rfind(">") + 1
        while match := _TOKEN.search(source, at, last):
            if match.start() > at:
                self._add(source[at:match.start()])
            at = match.end()
            if not match[2]:
                if match[0].startswith("<!--") and not match[0].endswith("-->"):
                    at = len(source)
                continue
            tag = match[2].lower()
            if match[1]:
                self._end(tag)
            elif tag in _RAW:
                if not match[3].endswith("/") or tag not in ("svg", "math"):
                    close = self._close_of(tag, source, at)
                    if close:
                        at = close.end()
                    elif tag in _OPEN_ENDED:
                        at = len(source)
                    elif self._stack and (close := self._close_of(self._stack[-1][0], source, at)):
                        at = close.start()
            elif tag in _VOID:
                if tag in _BLOCKS:
                    self._flush()
                elif tag in _SPACED:
                    self._text.append(" ")
            else:
                self._start(tag, match[3])
        self._add(source[at:])
        while self._stack:
            self._pop()
        self._flush()

    def _close_of(self, tag: str, source: str, at: int) -> re.Match | None:
        """The next end tag; a search without success is not made again further on."""
        if tag in self._unclosed:
            return None
        close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
        if not close:
            self._unclosed.add(tag)
        return close

    def _add(self, text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            if not self._hard and (not self._soft or self._part and self._heading):
                self._text.append(text)
            if self._stack and not text.isspace():
                frame = self._stack[-1]
                frame[1].update(" ".join(text.split()).encode("utf-8", "surrogatepass"))
                frame[3] = True

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text = []
            if text:
                self.blocks.append((text, -2 if self._part == -1 and self._heading else self._part))

    def _last_open(self, tags) -> int:
        """Place of the innermost open element of one of the tags; -1 for none."""
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=-1)

    def _close_from(self, place: int) -> None:
        while len(self._stack) > place:
            self._pop()

    def _close_open(self, kinds: set[str], bounds: set[str]) -> None:
        place = self._last_open(kinds)
        if place >= 0 and place >= self._last_open(bounds):
            self._close_from(place)

    def _start(self, tag: str, source: str) -> None:
        if tag in _PARAGRAPH_ENDS:
            self._close_open({"p"}, _SCOPES)
        if tag in _IMPLIED:
            self._close_open(*_IMPLIED[tag])
        if tag in _BLOCKS:
            self._flush()
        elif tag in _SPACED:
            self._text.append(" ")
        mark = _mark(tag, source)
        part = self._part
        if tag == "article" or (tag == "main" or 'role="main"' in source) and not part:
            if part > 0:
                mark = "hard"
            elif not mark and not self._hard:
                self._articles += tag == "article"
                self._part = self._articles if tag == "article" else -1
        self._open[tag].append(len(self._stack))
        self._hard += mark == "hard"
        self._soft += mark == "soft"
        self._heading += tag in _HEADINGS
        self._stack.append([tag, xxhash.xxh64(tag), len(self.blocks), False, mark, part])

    def _end(self, tag: str) -> None:
        place = self._last_open((tag,))
        if place >= 0 and (tag in ("article", "body", "html") or place > self._last_open(("article", "body"))):
            self._close_from(place)

    def _pop(self) -> None:
        tag, digest, first, has_text, mark, part = self._stack[-1]
        if tag in _BLOCKS:
            self._flush()
        self._stack.pop()
        self._open[tag].pop()
        if self._stack:
            parent = self._stack[-1]
            parent[1].update(digest.digest())
            parent[3] = parent[3] or has_text
        if has_text and (tag in _CONTAINERS or tag == "p" and not self._part):
            self.subtrees.append((digest.intdigest() - (1 << 63), first, len(self.blocks)))
        self._hard -= mark == "hard"
        self._soft -= mark == "soft"
        self._heading -= tag in _HEADINGS
        self._part = part

    def text(self, template: set[int] = frozenset()) -> str:
        """Blocks of the main part without template subtrees, joined by an empty line.

        The main part is all articles that stand in no other one, and the
        headings of main; without an article, main; without both, the whole
        page.
        """
        change = [0] * (len(self.blocks) + 1)
        for digest, first, end in self.subtrees:
            if digest in template:
                change[first] += 1
                change[end] -= 1
        kept: list[tuple[str, int]] = []
        depth = 0
        for block, step in zip(self.blocks, change):
            depth += step
            if not depth:
                kept.append(block)
        found = {part for _, part in kept}
        main = found - {0, -1} if max(found, default=0) > 0 else found - {0} or found
        return "\n\n".join(text for text, part in kept if part in main)


def host_of(url: Column) -> Column:
    """Lower-case host of an address; null without one."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def recurring_subtrees(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, template): hashes of the element subtrees that recur on many pages of a host.

    Pages that agree in their main text count once, so copies of an article
    don't make its elements a template. The share asked for falls with the
    size of the host, so a notice on a small part of a large host goes too; a
    host of n pages has at most the subtrees of sqrt(n) pages. Rows are (host, main text, subtree)
    once each and counted with map-side combine, so a large host is spread.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                hosts, mains, subtrees = [], [], []
                for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    page = Page(source)
                    main = xxhash.xxh64_intdigest(page.text().encode("utf-8", "surrogatepass")) - (1 << 63)
                    own = [None, *{s[0] for s in page.subtrees}]
                    hosts += [host] * len(own)
                    mains += [main] * len(own)
                    subtrees += own
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(mains, pa.int64()),
                                                  pa.array(subtrees, pa.int64())], names=["host", "main", "subtree"])

    seen = (pages.select(host_of(pages["url"]).alias("host"), pages["html"].alias("html"))
            .where("host is not null and html is not null")
            .mapInArrow(run, "host string, main long, subtree long").distinct())
    counts = seen.groupBy("host", "subtree").agg(F.count("*").alias("n"))
    counts = materialize(counts.where((F.col("n") >= least_pages) | F.col("subtree").isNull()), "subtrees")
    totals = counts.where("subtree is null").select("host", F.col("n").alias("pages"))
    return (counts.where("subtree is not null").join(totals, "host").where(F.col("n") * F.col("n") >= F.col("pages"))
            .groupBy("host").agg(F.collect_list("subtree").alias("template")))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Character references are decoded, white space inside a block is one
    space, blocks are joined by an empty line. A null or empty page has an
    empty text; a page without host has no template; repeated rows are
    extracted alike; further columns are not read; an empty table gives an
    empty result. The recurring subtrees are broadcast if they are few
    enough, and joined by host otherwise.
    """
    found = materialize(recurring_subtrees(pages, least_pages), "template")
    few = (found.agg(F.sum(F.size("template"))).first()[0] or 0) <= BROADCAST_SUBTREES
    hosted = pages.select("page_id", "url", "html", host_of(pages["url"]).alias("host"))
    joined = hosted.join(F.broadcast(found) if few else found, "host", "left")
    schema = StructType([pages.schema["page_id"], pages.schema["url"], StructField("text", StringType()),
                         StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                texts = [Page(source or "").text(set(template or ())) for source, template in
                         zip(part.column("html").to_pylist(), part.column("template").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return joined.select("page_id", "url", "html", "template").mapInArrow(run, schema)
