"""Text functions: Column -> Column, all in the JVM unless said otherwise."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column, functions as F

#: Words that are never searched for.
STOP = (
    "the a an and or for to of in on is are was be with it this that you your not no from at by i as had have has into how what when where who which "
    "will would can could should do does did done if then than them they we us our also but there here out via than much more most less some any all"
).split()
#: Words that stand for one another in a search.
SYNONYMS = {"broadcast": ["broadcast", "companion", "byoda"], "companion": ["companion", "broadcast", "byoda"], "byoda": ["byoda", "broadcast"]}


#: Combining marks that a search ignores.
MARKS = "".join(map(chr, range(0x300, 0x370)))


@functools.lru_cache(maxsize=1)
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition, marks aside, is one lower-case ASCII letter or digit; and
    those of the Latin blocks and their presentation forms whose decomposition is several characters, some such among them."""
    one, many = {}, {}
    for n in (*range(0x80, 0x300), *range(0x370, 0xD800), *range(0xE000, 0x1F200)):
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(n)) if x not in MARKS)
        plain = [x for x in base if x.isascii() and (x.islower() or x.isdigit())]
        if len(base) == 1 and plain:
            one[chr(n)] = base
        elif plain and (n < 0x300 or 0xFB00 <= n <= 0xFB06):
            many[chr(n)] = base
    return one, many


def fold(c: Column) -> Column:
    """Lower case without diacritics, character by character, so that places stay."""
    one, _ = _folds()
    return F.translate(F.lower(c), "".join(one), "".join(one.values()))


def fold_text(c: Column) -> Column:
    """Lower case by compatibility decomposition without marks, in the JVM: all characters that stand for one letter
    or digit, and Latin ligatures and fractions. fold_exact knows the rare rest (units, enclosed numbers)."""
    one, many = _folds()
    low = F.lower(c)
    apart = low
    for x, y in many.items():
        apart = F.replace(apart, F.lit(x), F.lit(y))
    # told by lengths and plain replacements: patterns would cost several times what the folding does
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(apart, "".join(one) + MARKS, "".join(one.values())))


def fold_exact(c: Column) -> Column:
    """As fold_text, by full compatibility decomposition, in an Arrow UDF."""

    @F.pandas_udf("string")
    def run(s):
        low = s.fillna("").str.lower().str.normalize("NFKD")
        return low.str.replace(f"[{MARKS[0]}-{MARKS[-1]}]", "", regex=True)

    return run(c)


def tokens(c: Column, exact: bool = False) -> Column:
    """Words of two letters or digits at least that aren't stop words, in order."""
    words = F.split((fold_exact if exact else fold_text)(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP))


def tokens_of(c: Column, words: list[str]) -> Column:
    """The tokens that are among some words, in order, by one pattern over the folded text."""
    able = [w for w in words if re.fullmatch("[a-z0-9]{2,}", w) and w not in STOP]
    if not able:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(fold_text(F.coalesce(c, F.lit(""))), F.lit(f"(?<![a-z0-9])(?:{'|'.join(able)})(?![a-z0-9])"), 0)


def collapse(c: Column) -> Column:
    """Runs of Unicode white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm(c: Column) -> Column:
    return F.lower(collapse(c))


def norm_quote(c: Column) -> Column:
    """norm without the destinations of markdown links."""
    return F.regexp_replace(norm(c), r"\]\([^)\n]+?\)", "]")


def quoted_in(quote: Column, text: Column) -> Column:
    """Whether the quote stands in the text word for word, link destinations aside; an empty quote doesn't."""
    q, t = norm(quote), norm(text)
    return F.coalesce((F.length(q) > 0) & (F.contains(t, q) | F.contains(norm_quote(text), norm_quote(quote))), F.lit(False))


def named_in(entry: Column, text: Column) -> Column:
    """Whether each run of two letters or digits at least of the entry stands in the text, white space aside; without runs it doesn't."""
    runs = F.regexp_extract_all(F.lower(entry), F.lit("[a-z0-9]{2,}"), 0)
    hay = norm(text)
    compact = F.regexp_replace(hay, r"(?U)\s+", "")
    return F.coalesce((F.size(runs) > 0) & F.forall(runs, lambda r: F.contains(hay, r) | F.contains(compact, r)), F.lit(False))


def setting_name(entry: Column) -> Column:
    return F.trim(F.substring_index(F.substring_index(entry, "→", 1), "->", 1))


def headline(c: Column, most: int = 90, least: int = 30) -> Column:
    """The first `most` characters up to a word's end, with an ellipsis if there was more."""
    s = collapse(F.coalesce(c, F.lit("")))
    head = F.substring(s, 1, most)
    last = F.length(head) - F.instr(F.reverse(head), " ")  # characters before the last blank
    cut = F.when((F.instr(head, " ") > 0) & (last > least), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.regexp_replace(cut, "[ ,;:.]+$", ""), F.lit("…")))


def snippet(text: Column, words: Column, before: int = 80, long: int = 300, plain: int = 240) -> Column:
    """The text around the first place where one of the words (not tokens) stands."""
    hay = fold(text)
    at = F.array_min(F.filter(F.transform(words, lambda w: F.position(w, hay)), lambda p: p > 0)) - 1
    start0 = F.greatest(at - before, F.lit(0))
    end = F.least(start0 + long, F.length(text))
    space = F.position(F.lit(" "), text, start0 + 1)
    start = F.when(start0 == 0, F.lit(0)).otherwise(F.when(space > 0, space).otherwise(F.lit(0)))
    body = collapse(F.substring(text, start + 1, F.greatest(end - start, F.lit(0))))
    around = F.concat(F.when(start > 0, F.lit("… ")).otherwise(F.lit("")), body, F.when(end < F.length(text), F.lit(" …")).otherwise(F.lit("")))
    return F.when(at.isNull(), F.substring(text, 1, plain)).otherwise(around)


def truncated(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def json_object(c: Column) -> Column:
    """The outermost braces of a model's answer, code fences and prose aside; null if there are none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def url_host(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"^https?://([^/:?#]+)", 1), r"^www\.", "")


def stem(repo: Column, number: Column) -> Column:
    return F.concat_ws("-", F.lower(F.split_part(repo, F.lit("/"), F.lit(2))), number.cast("string"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_of(slug_: Column) -> Column:
    return F.initcap(F.replace(slug_, F.lit("-"), F.lit(" ")))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
