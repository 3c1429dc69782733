"""Tags and versions: a vocabulary is a parameter everywhere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The device vocabulary in its order, and what marks each device in running text. Word boundaries are
#: spelt out, for letters, digits and _ of ASCII: \b of this JVM heeds other letters too.
DEVICES = {
    "G7": r"(?<![A-Za-z0-9_])(?:dexcom\s+)?g7(?![A-Za-z0-9_])",
    "G6": r"(?<![A-Za-z0-9_])(?:dexcom\s+)?g6(?![A-Za-z0-9_])",
    "DASH": r"(?<![A-Za-z0-9_])omnipod\s*dash(?![A-Za-z0-9_])",
    "Omnipod 5": r"(?<![A-Za-z0-9_])omnipod\s*5(?![A-Za-z0-9_])",
    "Libre": r"(?<![A-Za-z0-9_])libre(?![A-Za-z0-9_])",
    "Medtrum": r"(?<![A-Za-z0-9_])medtrum(?![A-Za-z0-9_])",
    "Dexcom": r"(?<![A-Za-z0-9_])dexcom(?![A-Za-z0-9_])",
    "Eversense": r"(?<![A-Za-z0-9_])eversense(?![A-Za-z0-9_])",
}
#: Fixed values: (tag, words all of which occur, whole values); the first rule that fits names a structured entry.
RULES = [("G7", [], ["g7", "dexcom g7"]), ("G6", [], ["g6", "dexcom g6"]), ("DASH", ["omnipod", "dash"], []), ("Omnipod 5", ["omnipod 5"], []), ("Omnipod 5", ["omnipod5"], []), ("Libre", ["libre"], []), ("Medtrum", ["medtrum"], []), ("Dexcom", ["dexcom"], []), ("Eversense", ["eversense"], [])]


def scan(c: Column, patterns: dict[str, str] = DEVICES) -> Column:
    """All tags whose pattern occurs in the text, in the vocabulary's order."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(t)) for t, p in patterns.items()]))


def canonical(c: Column, rules: list[tuple[str, list[str], list[str]]] = RULES) -> Column:
    """The one tag of a structured entry, or null."""
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    out = F.lit(None).cast("string")
    for tag, parts, whole in reversed(rules):
        ok = s.isin(whole) if whole else F.lit(False)
        if parts:
            each = F.lit(True)
            for p in parts:
                each = each & F.contains(s, F.lit(p))
            ok = ok | each
        out = F.when(ok, F.lit(tag)).otherwise(out)
    return F.when(F.length(s) > 0, out)


def canonical_set(*arrays: Column) -> Column:
    """Distinct tags of the arrays' entries, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(F.concat(*arrays), lambda e: canonical(e)), lambda t: t.isNotNull()))


def versions(c: Column, word: str = "android", label: str = "Android ", least: float = 8) -> Column:
    """Distinct versions named after the word, from `least` up, in order of first appearance."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?i)(?<![A-Za-z0-9_]){word}\s+(\d+(?:\.\d+)?)(?![A-Za-z0-9_])"), 1)
    return F.array_distinct(F.transform(F.filter(found, lambda v: v.cast("double") >= least), lambda v: F.concat(F.lit(label), v)))
