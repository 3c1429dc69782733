"""Functions for ingesting raw records: timestamps, aliases, pseudonyms, costs."""

from __future__ import annotations

import hashlib
import os
import secrets

from pyspark.sql import Column, functions as F


def iso_timestamp(c: Column) -> Column:
    """ISO 8601 in UTC. Ten digits and more are epoch seconds by their first ten; zones and
    offsets are heeded, none means UTC; what can't be read is cut at 32 characters."""
    s = F.trim(c.cast("string"))
    epoch = F.when(s.rlike(r"^\d{10,}$"), F.timestamp_seconds(F.substring(s, 1, 10).cast("bigint")))
    parsed = F.when(s.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(F.regexp_replace(s, r"([+-]\d\d)(\d\d)$", "$1:$2")))
    at = F.coalesce(epoch, parsed)
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.substring(s, 1, 32))


def first_text(*cols: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cols])


def first_alias(json: Column, keys: list[str]) -> Column:
    """The first value under one of the keys of a JSON object that isn't blank."""
    return first_text(*[F.get_json_object(json, f"$.{k}") for k in keys])


def first_int(json: Column, keys: list[str]) -> Column:
    """The first value under one of the keys that is written as an integer; true and false aren't."""
    values = [F.get_json_object(json, f"$.{k}") for k in keys]
    return F.coalesce(*[F.when(v.rlike(r"^\d+$"), v.try_cast("bigint")) for v in values])


def to_int(c: Column, default: int = 0) -> Column:
    s = F.trim(c.cast("string"))
    return F.coalesce(F.when(s.rlike(r"^[+-]?\d{1,18}$"), s.try_cast("bigint")), F.lit(default))


def hmac_sha256(salt: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex, composed of sha2. The padded key is part of the plan: log no plan that holds it."""
    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def pseudonym(salt: bytes, identity: Column) -> Column:
    return F.concat(F.lit("member-"), F.substring(hmac_sha256(salt, identity), 1, 8))


def cost(tokens_in: Column, tokens_out: Column, price_in: float = 0.14, price_out: float = 0.28) -> Column:
    """Price of tokens at so much a million."""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def label_names(labels: Column) -> Column:
    """Names of an array of label structs."""
    return F.coalesce(F.transform(labels, lambda x: x["name"]), F.array().cast("array<string>"))


def login(user: Column) -> Column:
    """The login of a user struct; a mark where an account is gone."""
    return F.coalesce(user["login"], F.lit("?"))


def now_iso(now: Column | None = None) -> Column:
    """The time a query began, or a given one, as ISO 8601 in UTC."""
    return F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def load_salt(env: str, path: str, environ=os.environ) -> bytes:
    """The salt of an installation: from the environment, else from a file, which is made for its owner alone if it isn't there.

    On the driver. An empty salt is none; where none can be had or kept, it fails.
    """
    if given := environ.get(env, "").strip():
        return given.encode()
    path = os.path.expanduser(path)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if kept := f.read().strip():
                return kept.encode()
    made = secrets.token_hex(32)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        f.write(made + "\n")
    os.chmod(path, 0o600)
    return made.encode()
