"""Main text of HTML pages by removal of site templates.

A page is parsed to text segments, each in a block, and to subtrees, each an interval of
segments with a hash of its markup and text. Spark counts per host on how many different pages
a subtree occurs; those on at least `share` of a host's pages and on `least` at least are
templates of the site and are deleted wherever they stand, within the article too, unless they
are passages that sites share: those stand on other hosts as well, and are no template on most of
them. Elements whose name, role or class says that they aren't the article go as well (navigation,
headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles). Where a page
marks its article (article, main), what stands outside goes too. Exact copies of a page count as
one page.

Cases: null and empty html give an empty text; markup that is never closed ends with the page,
end tags without a start are ignored; a start tag that is never closed is text; a null url belongs to a
host of its own; repeated rows give repeated results; extra columns are ignored; an empty table gives an
empty table. The parser doesn't recurse and takes linear time, so deep nesting, stray tags, quotes that
never close and very long pages do no harm.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import column, slices, stored

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"([^\s=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: HTML element names by what they mean here.
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CHROME = frozenset("nav footer aside form head script style noscript template iframe button select dialog menu svg object search textarea title noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id names of what isn't the article.
MARKS = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus respond widget pagination pager skip".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre search section summary table ul".split())
#: What a start tag closes, and what stops the search for it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("table td th article main section div body aside nav header footer form ul ol dl".split())


class Page:
    """segments: (block, text); subtrees: (hash, first, end); chrome: intervals of segments; content: those of articles."""

    def __init__(self, source: str | None):
        self.segments: list[tuple[int, str]] = []
        self.subtrees: list[tuple[int, int, int]] = []
        self.chrome: list[tuple[int, int]] = []
        self.content: list[tuple[int, int]] = []
        self._block, self._guard, self._stack = 0, 0, []
        self._open: dict[str, list[int]] = {}  # places of the open elements by name
        self._parse(source or "")

    def _parse(self, s: str) -> None:
        at, quotes = 0, True
        while m := _OPEN.search(s, at):
            name = m[2]
            if name is None:
                mark = "-->" if m[0] == "<!--" else ">"
                close = s.find(mark, m.start() + 2)
                end = len(s) if close < 0 else close + len(mark)
            else:
                close = self._tag_end(s, m.end()) if quotes else -1
                if close < 0:  # once in a page: from here on a tag ends at the first >
                    quotes, close = False, s.find(">", m.end())
                if close < 0:
                    break
                end = close + 1
            if m.start() > at:
                self._text(s[at : m.start()])
            at = end
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self._end(name)
                continue
            self._start(name, s[m.end() : close])
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(s, at)
                self._end(name)
                at = close.end() if close else len(s)
        if at < len(s):
            self._text(s[at:])
        while self._stack:
            self._pop()

    @staticmethod
    def _tag_end(s: str, at: int) -> int:
        """Where the > of a tag stands, outside quoted values; -1 if there is none."""
        while (at := _PLAIN.match(s, at).end()) < len(s):
            if s[at] == ">":
                return at
            before = at - 1
            while s[before].isspace():
                before -= 1
            if s[before] == "=":
                at = s.find(s[at], at + 1)
                if at < 0:
                    return -1
            at += 1
        return -1

    def _text(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self.segments.append((self._block, text))
        if self._stack:
            self._stack[-1][3].append(b"t" + " ".join(text.split()).encode("utf-8", "replace"))

    def _start(self, name: str, attrs: str) -> None:
        if name in ENDS_P:
            self._close({"p"}, SCOPE)
        if name in CLOSES:
            self._close(*CLOSES[name])
        if name in BLOCKS:
            self._block += 1
        if name == "br":
            self.segments.append((self._block, " "))
        if name in VOID or attrs.endswith("/") and name in ("svg", "path"):
            return
        chrome = name in CHROME or name == "header" and not self._guard
        if not chrome and attrs and "=" in attrs:
            found = {x[1].lower(): x[2] or x[3] or x[4] or "" for x in _ATTR.finditer(attrs)}
            named = set(re.split(r"[^a-z0-9]+", (found.get("class", "") + " " + found.get("id", "")).lower()))
            chrome = bool(found.get("role", "").lower() in ROLES or named & MARKS and name not in ("body", "html", "main", "h1")) or "hidden" in found.get("aria-hidden", "")
            chrome = chrome or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
        guard = name in ("article", "main") and not chrome
        self._guard += guard
        self._open.setdefault(name, []).append(len(self._stack))
        self._stack.append((name, len(self.segments), chrome, [name.encode()], guard))

    def _last(self, names) -> int:
        """The place of the innermost open element of these names, or -1."""
        return max((self._open[x][-1] for x in names if self._open.get(x)), default=-1)

    def _close(self, names: set[str], stop) -> None:
        at = self._last(names)
        if at > self._last(stop - names):
            while len(self._stack) > at:
                self._pop()

    def _end(self, name: str) -> None:
        if self._open.get(name):
            while self._pop() != name:
                pass
        elif name == "p":
            self._block += 1

    def _pop(self) -> str:
        name, first, chrome, parts, guard = self._stack.pop()
        self._open[name].pop()
        self._guard -= guard
        if name in BLOCKS:
            self._block += 1
        h = xxhash.xxh3_64(b"\0".join(parts)).intdigest() - (1 << 63)
        end = len(self.segments)
        if self._stack:
            self._stack[-1][3].append(h.to_bytes(8, "little", signed=True))
        if end > first:
            if chrome:
                self.chrome.append((first, end))
            if guard:
                self.content.append((first, end))
            if name in BLOCKS:  # a word in bold is no template
                self.subtrees.append((h, first, end))
        return name

    def text(self, templates: frozenset[int] = frozenset()) -> str:
        """Blocks of the article, without chrome and the subtrees named."""
        n = len(self.segments)
        keep = bytearray(n) if self.content else bytearray(b"\1") * n
        for a, b in self.content:
            keep[a:b] = b"\1" * (b - a)
        for a, b in self.chrome:
            keep[a:b] = bytes(b - a)
        if templates:
            for h, a, b in self.subtrees:
                if h in templates:
                    keep[a:b] = bytes(b - a)
        out, last, parts = [], None, []
        for (block, text), ok in zip(self.segments, keep):
            if ok:
                if block != last:
                    out.append(" ".join("".join(parts).split()))
                    last, parts = block, []
                parts.append(text)
        out.append(" ".join("".join(parts).split()))
        return "\n\n".join(x for x in out if x)


def host(url):
    """Host of a url column, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _subtrees(rows: DataFrame) -> DataFrame:
    """(host, page, hash): the subtrees of each row, each once."""

    def run(batches):
        for batch in slices(batches, "html"):
            hosts, pages, hashes = [], [], []
            for own, key, source in zip(column(batch, "host").to_pylist(), column(batch, "page").to_pylist(), column(batch, "html").to_pylist()):
                for h in {x[0] for x in Page(source).subtrees}:
                    hosts.append(own)
                    pages.append(key)
                    hashes.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(hashes, pa.int64())], ["host", "page", "hash"])

    return rows.select("host", "page", "html").mapInArrow(run, "host string, page bigint, hash bigint")


def templates(pages: DataFrame, share: float = 0.5, least: int = 5) -> DataFrame:
    """(host, hashes): subtrees on at least `share` of the host's different pages, and on `least` at least,
    that are such on half or more of the hosts (of `least` pages or more) on which they stand."""
    rows = pages.withColumn("page", F.xxhash64("html"))
    sizes = stored(rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least), "hosts")
    counts = stored(_subtrees(rows).distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    found = counts.join(sizes, "host").withColumn("often", (F.col("n") >= least) & (F.col("n") >= share * F.col("pages")))
    often = found.where("often").select("host", "hash")
    # a passage that stands on one page of another host isn't counted there
    most = found.join(often.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.avg(F.col("often").cast("int")).alias("part"))
    # a page has so many subtrees, and each is on a share of the pages: the list of a host is bounded
    return often.join(most.where("part >= 0.5").select("hash"), "hash").groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.5, least: int = 5) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    own = own.withColumn("host", host(F.col("url")))
    known = stored(templates(own.select("host", "html"), share, least), "templates")

    def run(batches):
        for batch in slices(batches, "html"):
            texts = [Page(s).text(frozenset(h or ())) for s, h in zip(column(batch, "html").to_pylist(), column(batch, "hashes").to_pylist())]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return own.join(known, "host", "left").select("page_id", "url", "html", "hashes").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
