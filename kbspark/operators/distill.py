"""Extraction by an injected model: batches, one retry, routing, totals."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import records as R, text as T
from .validate import REPO_KEYS, record_errors


def settled(distilled: DataFrame, parked: DataFrame, key: str = "stem") -> DataFrame:
    """Keys that are done or parked, each once."""
    return distilled.select(key).union(parked.select(key)).distinct()


def pick_batch(threads: DataFrame, done: DataFrame, limit: int = 200, key: str = "stem", anchors: DataFrame | None = None) -> DataFrame:
    """What isn't done: anchors (keys) first, then by comments and number."""
    rest = threads.join(done.select(key).distinct(), key, "left_anti")
    anchor = F.coalesce("_anchor", F.lit(False))
    rest = rest.withColumn("_anchor", F.lit(False)) if anchors is None else rest.join(anchors.select(key, F.lit(True).alias("_anchor")).distinct(), key, "left")
    order = [F.desc(anchor), F.desc_nulls_last("comment_count"), F.desc_nulls_last(F.when(~anchor, F.col("number"))), F.col(key)]
    return rest.orderBy(*order).limit(limit).drop("_anchor")


def pick_social_batch(posts: DataFrame, done: DataFrame, limit: int = 200, key: str = "stem") -> DataFrame:
    """Posts that aren't done, by comments and then key, both descending."""
    return posts.join(done.select(key).distinct(), key, "left_anti").orderBy(F.desc_nulls_last("comment_count"), F.desc(key)).limit(limit)


def remaining(threads: DataFrame, distilled: DataFrame, parked: DataFrame, key: str = "stem") -> DataFrame:
    """(total, distilled, parked, remaining): what is left is counted, so that a state of threads that went doesn't lessen it."""
    left = threads.join(settled(distilled, parked, key), key, "left_anti")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(threads, "total").crossJoin(n(distilled, "distilled")).crossJoin(n(parked, "parked")).crossJoin(n(left, "remaining"))  # four rows of one


def endpoint(prefix: str, key_file: str, provider: str, base: str, model: str, environ=os.environ) -> dict[str, str]:
    """Where a model is and its key: from <prefix>_BASE_URL, _MODEL, _API_KEY, else the key from a JSON file {provider: {key}}. Without a key it fails."""
    out = {"base": environ.get(f"{prefix}_BASE_URL", base).rstrip("/"), "model": environ.get(f"{prefix}_MODEL", model), "key": environ.get(f"{prefix}_API_KEY", "")}
    path = os.path.expanduser(environ.get(f"{prefix}_KEY_FILE", key_file))
    if not out["key"] and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            try:
                out["key"] = (json.load(f).get(provider) or {}).get("key", "")
            except json.JSONDecodeError:
                pass
    if not out["key"]:
        raise ValueError(f"no key of the model: set {prefix}_API_KEY, or {prefix}_KEY_FILE to a file with one under {provider!r}")
    return out


def chat_client(config: dict[str, str], system: str, opener=urllib.request.urlopen, timeout: float = 120) -> Callable[[str, str], tuple[str, int, int]]:
    """An extractor that asks a chat endpoint over https: (answer, tokens in, tokens out). The key travels with the closure, never in a plan."""
    if not config["base"].startswith("https://"):
        raise ValueError("a model is asked over https")

    def ask(text: str, hint: str) -> tuple[str, int, int]:
        user = text if not hint else f"{text}\n\nThe answer before was rejected: {hint}"
        body = {"model": config["model"], "temperature": 0, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        request = urllib.request.Request(f"{config['base']}/chat/completions", json.dumps(body).encode(), {"Authorization": f"Bearer {config['key']}", "Content-Type": "application/json"})
        with opener(request, timeout=timeout) as r:
            got = json.loads(r.read())
        usage = got.get("usage") or {}
        return got["choices"][0]["message"]["content"], int(usage.get("prompt_tokens", 0)), int(usage.get("completion_tokens", 0))

    return ask


def prompt(template: str, *cols: Column) -> Column:
    return F.format_string(template, *cols)


def extract(rows: DataFrame, extractor: Callable[[str, str], tuple[str, int, int]], key: str = "stem", text: str = "text", hint: str | None = None, workers: int = 4) -> DataFrame:
    """(key, text, answer, tokens_in, tokens_out, failed): extractor(text, hint) -> (answer, tokens in, tokens out).

    Rows are dealt to `workers` tasks, which is how many calls run at once. What an extractor
    raises becomes a value, so that a row is neither lost nor fails its task.
    """

    def run(batches):
        for b in batches:
            out = []
            for k, t, h in zip(b["k"], b["t"], b["h"]):
                try:
                    out.append((k, t, *extractor(t, h), None))
                except Exception as e:  # noqa: BLE001 - any failure of the model is a value
                    out.append((k, t, None, 0, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["k", "text", "answer", "tokens_in", "tokens_out", "failed"])

    kind = rows.schema[key].dataType.simpleString()
    given = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.col(hint) if hint else F.lit("")).alias("h"))
    return given.repartition(workers, "k").mapInPandas(run, f"k {kind}, text string, answer string, tokens_in bigint, tokens_out bigint, failed string").withColumnRenamed("k", key)


def checked(answers: DataFrame, keys: tuple[str, ...] = REPO_KEYS, repos: list[str] | None = None) -> DataFrame:
    record = T.json_object(F.col("answer"))
    errors = F.when(F.col("failed").isNotNull(), F.array("failed")).when(record.isNull(), F.array(F.lit("no JSON object in the answer"))).otherwise(record_errors(record, F.col("text"), keys, repos))
    return answers.withColumns({"record": record, "errors": errors})


def distill(rows: DataFrame, extractor, store: Callable[[DataFrame, str], DataFrame], key: str = "stem", keys: tuple[str, ...] = REPO_KEYS, repos: list[str] | None = None, workers: int = 4) -> DataFrame:
    """(key, record, errors, tokens_in, tokens_out, attempts): rows that fail are asked once more with their errors.

    store(df, name) writes a pass and reads it again: a model is never asked twice for what it has answered.
    """
    first = store(checked(extract(rows, extractor, key, workers=workers), keys, repos), "first")
    again = first.where(F.size("errors") > 0).withColumn("hint", F.array_join("errors", "; "))
    second = store(checked(extract(again, extractor, key, hint="hint", workers=workers), keys, repos), "second")
    s = second.select(key, F.col("record").alias("r2"), F.col("errors").alias("e2"), F.col("tokens_in").alias("i2"), F.col("tokens_out").alias("o2"))
    j = first.join(s, key, "left")
    two = F.col("e2").isNotNull()
    return j.select(key, F.when(two, F.col("r2")).otherwise(F.col("record")).alias("record"), F.when(two, F.col("e2")).otherwise(F.col("errors")).alias("errors"), (F.col("tokens_in") + F.coalesce("i2", F.lit(0))).alias("tokens_in"), (F.col("tokens_out") + F.coalesce("o2", F.lit(0))).alias("tokens_out"), F.when(two, 2).otherwise(1).alias("attempts"))


def report(done: DataFrame) -> DataFrame:
    """Totals of all attempts."""
    return done.agg(F.count("*").alias("rows"), F.count_if(F.size("errors") > 0).alias("parked"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(R.cost(F.sum("tokens_in"), F.sum("tokens_out")), 6).alias("cost"))
