"""Validation: columns of error strings, tier by tier, and gates that raise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

TEXT_FIELDS, LIST_FIELDS, LEVELS = ("symptom", "cause", "fix"), ("settings_changed", "devices", "android_versions", "driver_tags"), ("high", "medium", "low")
#: What a record must have, by flavour.
SOCIAL_KEYS = ("title", *TEXT_FIELDS, *LIST_FIELDS, "confidence", "evidence_quote")
REPO_KEYS = ("issue_id", "repo", "url", *SOCIAL_KEYS)


class GateError(RuntimeError):
    """A gate found rows that must not go on."""


def errors(*rules: tuple[Column, str | Column]) -> Column:
    """The messages of the rules whose condition holds (null: holds not), in order."""
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in rules]))


def tiers(*parts: Column) -> Column:
    """The first array that isn't empty: later tiers are only looked at if the earlier ones are clean."""
    out = parts[-1]
    for p in reversed(parts[:-1]):
        out = F.when(F.size(p) > 0, p).otherwise(out)
    return out


def record_errors(json: Column, text: Column, keys: tuple[str, ...] = REPO_KEYS, repos: list[str] | None = None) -> Column:
    """Errors of a record in JSON against the text it was drawn from: missing keys, then types, then
    values that don't stand in the text. Null is a value; only keys that are not there are missing."""
    v = F.try_parse_json(json)
    return tiers(*_record_tiers(v, _names(json), lambda k: _kind(v, k), lambda k: _text(v, k), json, text, keys, repos))


def with_record_errors(df: DataFrame, json: Column, text: Column, keys: tuple[str, ...] = REPO_KEYS, repos: list[str] | None = None, column: str = "errors") -> DataFrame:
    """df with record_errors as a column, step by step: each record is parsed once, not once for each rule, and each tier is worked out once."""
    d = df.withColumns({"_json": json, "_text": text})
    d = d.withColumns({"_v": F.try_parse_json("_json"), "_names": _names(F.col("_json"))})
    d = d.withColumns({x: c for k in keys for x, c in ((f"_kind_{k}", _kind(F.col("_v"), k)), (f"_text_{k}", _text(F.col("_v"), k)))})
    *parts, found = _record_tiers(F.col("_v"), F.col("_names"), lambda k: F.col(f"_kind_{k}"), lambda k: F.col(f"_text_{k}"), F.col("_json"), F.col("_text"), keys, repos)
    d = d.withColumns({f"_tier_{i}": p for i, p in enumerate(parts)})
    d = d.withColumn(column, tiers(*[F.col(f"_tier_{i}") for i in range(len(parts))], found))
    return d.select(*[c for c in df.columns if c != column], column)


def _names(json: Column) -> Column:
    return F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))


def _kind(v: Column, k: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")), F.lit("VOID"))


def _text(v: Column, k: str) -> Column:
    return F.try_variant_get(v, f"$.{k}", "string")


def _record_tiers(v: Column, names: Column, kind: Callable[[str], Column], get: Callable[[str], Column], json: Column, text: Column, keys: tuple[str, ...], repos: list[str] | None) -> list[Column]:
    shape = errors((v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "record is not a JSON object"))
    missing = F.transform(F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: ~F.array_contains(names, k)), lambda k: F.concat(F.lit("missing required field '"), k, F.lit("'")))
    text_of = lambda k: F.when(kind(k) == "STRING", F.trim(get(k)))
    rules = []
    if "issue_id" in keys:
        rules.append((~((kind("issue_id") == "BIGINT") & F.coalesce(F.try_variant_get(v, "$.issue_id", "bigint") >= 1, F.lit(False))), "issue_id must be a positive integer"))
        if repos is not None:
            rules.append((~F.coalesce(get("repo").isin(repos), F.lit(False)), "repo is not a known one"))
        rules.append((~F.coalesce(text_of("url").rlike(r"^https://github\.com/.+/issues/\d+$"), F.lit(False)), "url must be an https issue link"))
        rules.append((~F.coalesce(F.length(text_of("title")) > 0, F.lit(False)), "title must be a non-empty string"))
    else:
        rules.append((~F.coalesce(F.length(text_of("title")).between(1, 300), F.lit(False)), "title must be a string of 1 to 300 characters"))
    rules += [(~((kind(f) == "VOID") | F.coalesce(F.length(text_of(f)) >= 3, F.lit(False))), f"{f} must be null or a non-trivial string") for f in TEXT_FIELDS]
    rules += [(~kind(f).isin("ARRAY<STRING>", "ARRAY<VOID>"), f"{f} must be an array of strings") for f in LIST_FIELDS]
    rules.append((~F.coalesce(get("confidence").isin(*LEVELS), F.lit(False)), "confidence must be high, medium or low"))
    rules.append((~F.coalesce(F.length(text_of("evidence_quote")) >= 5, F.lit(False)), "evidence_quote must be a string of 5 characters at least"))
    entries = lambda k: F.coalesce(F.from_json(F.get_json_object(json, f"$.{k}"), "array<string>"), F.array().cast("array<string>"))
    absent = lambda k, of: F.transform(F.filter(entries(k), lambda e: (F.length(of(e)) > 0) & ~T.named_in(of(e), text)), lambda e: F.concat(F.lit(f"{k} entry '"), e, F.lit("' is not in the text")))
    quote = errors((~T.quoted_in(get("evidence_quote"), text), "evidence_quote is not in the text word for word"))
    found = F.concat(quote, absent("devices", lambda e: e), absent("android_versions", lambda e: e), absent("settings_changed", T.setting_name))
    return [shape, missing, errors(*rules), found]


def routed(df: DataFrame, column: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the rejected with their errors in one string."""
    ok = F.size(column) == 0
    return df.where(ok).drop(column), df.where(~ok).withColumn("error", F.array_join(column, "; ")).drop(column)


def referential(records: DataFrame, sources: DataFrame, key: str, checks: list[tuple[Column, str]]) -> DataFrame:
    """records with errors: no source, or the checks against it."""
    j = records.join(sources.withColumn("_there", F.lit(True)), key, "left")
    there = F.col("_there").isNotNull()
    return j.withColumn("errors", tiers(errors((~there, "no matching source")), errors(*[(there & c, m) for c, m in checks]))).drop("_there")


def whitelist_violations(json: Column, allowed: list[str]) -> Column:
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*[F.lit(a) for a in allowed])))


def gate(df: DataFrame, bad: Column, what: str) -> DataFrame:
    """df, if no row is bad; else raises and nothing is written."""
    n = df.where(bad).limit(1).count()
    if n:
        raise GateError(what)
    return df


def at_least(df: DataFrame, by: str, least: dict[str, int]) -> DataFrame:
    """df, if each kind has as many rows as it must."""
    got = {r[by]: r["count"] for r in df.groupBy(by).count().where(F.col(by).isin(*least)).collect()}  # a row per kind
    short = {k: (got.get(k, 0), n) for k, n in least.items() if got.get(k, 0) < n}
    if short:
        raise GateError(f"too few rows: {short}")
    return df


def totals(df: DataFrame, column: str = "errors") -> DataFrame:
    return df.agg(F.count("*").alias("checked"), F.count_if(F.size(column) > 0).alias("failed"))
