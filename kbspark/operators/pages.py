"""Pages and markdown: article slice, HTML to loose markdown, markdown to HTML."""

from __future__ import annotations

import itertools
import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

#: Elements whose content goes, and elements that stand on lines of their own.
SKIPPED = frozenset("script style noscript nav footer aside head form".split())
LINES = frozenset("p div section article hr ul ol table tr blockquote pre br li h1 h2 h3 h4 h5 h6".split())
MARKER = 'itemprop="articleBody"'


def _from(c: Column, start: Column, *ends: str) -> Column:
    """From a position (1-based) to the first end mark after it that there is, else to the end."""
    at = [F.position(F.lit(e), c, start) for e in ends]
    end = F.coalesce(*[F.when(a > 0, a) for a in at])
    return F.when(end.isNull(), F.substr(c, start)).otherwise(F.substr(c, start, end - start))


def article(html: Column) -> Column:
    """The region of the article: by marker, else by role, else from the last h1; whole pages without any."""
    by_marker = F.position(F.lit(f"<div {MARKER}>"), html)
    by_role = F.position(F.lit('role="main"'), html)
    last_h1 = F.length(html) - F.position(F.lit("1h<"), F.reverse(html)) - 1
    plain = F.when(F.contains(html, F.lit("<h1")), _from(html, last_h1, "<script", "</body>")).otherwise(html)
    marked = F.when(by_marker > 0, _from(html, by_marker, "<footer", "</body>")).when(by_role > 0, _from(html, by_role, "</section>", "</body>")).otherwise(html)
    return F.when(F.contains(html, F.lit(MARKER)), marked).otherwise(plain)


class _Events(HTMLParser):
    """A page as a list of (what, value): "+" and "-" for tags, "" for text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        self.found.append(("+", tag))

    def handle_endtag(self, tag):
        self.found.append(("-", tag))

    def handle_data(self, data):
        self.found.append(("", data))


#: What begins a line of its own; other block elements only end the line before. JOIN stands before a run of text.
JOIN = "\0"
BEGINS = {"li": "\n- ", "hr": "\n---\n", **{f"h{n}": "\n" + "#" * n + " " for n in range(1, 7)}}
#: Runs are parted by a blank, but not at a line's start, behind a marker or before a blank.
_NO_BLANK = re.compile(rf"^{JOIN}|(?<=[-#] ){JOIN}|{JOIN}(?= )", re.M)


def _shown(events: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The events outside skipped elements."""
    steps = [(1 if what == "+" else -1) if what and value in SKIPPED else 0 for what, value in events]
    before = itertools.accumulate(steps, lambda depth, step: max(0, depth + step), initial=0)
    return [e for e, step, depth in zip(events, steps, before) if not step and not depth]


#: An ampersand, and what makes it a whole character reference.
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")


def _whole_only(html: str) -> str:
    """Ampersands that don't begin a reference with its semicolon are spelt out, so that decoding leaves them as they stand."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], html)


def to_markdown(html: str | None, bare: bool = True) -> str:
    """Loose markdown of an article's HTML: events become one string of lines, runs and marks, which patterns clean.

    bare: references without a semicolon are decoded where HTML does so ("&amp" is "&"); else only those with one are.
    """
    p = _Events()
    source = re.sub(r'<a class="headerlink"[^>]*>.*?</a>', "", html or "")
    p.feed(source if bare else _whole_only(source))
    p.close()
    out = []
    for what, value in _shown(p.found):
        if what:
            out.append((BEGINS.get(value, "\n") if what == "+" else "\n") if value in LINES else "")
        elif run := value.strip():
            # a run's blanks at its ends stay, as one
            out.append(JOIN + " " * value[0].isspace() + re.sub(r"\s+", " ", run) + " " * value[-1].isspace())
    text = _NO_BLANK.sub("", re.sub(r"\n+", "\n", "".join(out))).replace(JOIN, " ")
    text = re.sub(r"(?m)[ \t]+$", "", re.sub(r"(?m)^(?![ \t]*---[ \t]*$)[ \t]*[-#]+[ \t]*$", "", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def markdown(html: Column, bare: bool = True) -> Column:
    """to_markdown as an Arrow UDF: the parser keeps a state that no expression can."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: to_markdown(x, bare))

    return run(article(html))


def stripped(html: Column) -> Column:
    """Text without tags by patterns alone: scripts and styles go, tags become blanks, white space collapses."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def inline(c: Column) -> Column:
    """Code, strong and emphasis of one line, escaped before."""
    s = F.regexp_replace(T.escape_html(c), r"`([^`]+)`", "<code>$1</code>")
    s = F.regexp_replace(s, r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    return F.regexp_replace(s, r"\*([^*]+)\*", "<em>$1</em>")


def to_html(df: DataFrame, key: str, md: str) -> DataFrame:
    """(key, html): headings, items, rules and paragraphs by line; runs of items share a list (gaps and islands)."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(md), F.lit("")), "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    heading = F.length(F.regexp_extract("line", r"^(#{1,6}) ", 1))
    item = F.col("line").rlike(r"^([-*]|\d+\.) ")
    body = inline(F.regexp_replace("line", r"^(#{1,6}|[-*]|\d+\.) +", ""))
    tag = F.concat(F.lit("h"), heading.cast("string"))
    one = F.when(heading > 0, F.concat(F.lit("<"), tag, F.lit(">"), body, F.lit("</"), tag, F.lit(">"))).when(item, F.concat(F.lit("<li>"), body, F.lit("</li>"))).when(F.col("line").rlike(r"^(-{3,}|\*{3,})$"), F.lit("<hr>")).otherwise(F.concat(F.lit("<p>"), inline(F.col("line")), F.lit("</p>")))
    by = Window.partitionBy(key).orderBy("pos")
    d = lines.select(key, "pos", one.alias("html"), item.alias("item"))
    d = d.withColumns({"opens": F.col("item") & ~F.coalesce(F.lag("item").over(by), F.lit(False)), "ends": F.col("item") & ~F.coalesce(F.lead("item").over(by), F.lit(False))})
    d = d.withColumn("html", F.concat(F.when(F.col("opens"), "<ul>").otherwise(""), "html", F.when(F.col("ends"), "</ul>").otherwise("")))
    rows = F.array_sort(F.collect_list(F.struct("pos", "html")))
    return d.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["html"]), "\n").alias("html"))
