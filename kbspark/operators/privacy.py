"""Privacy: whitelisted anonymous records, harvested names, leak scans, hygiene."""

from __future__ import annotations

import json as _json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as Ty

from ..functions import records as R, text as T
from .validate import errors

#: Alias keys of raw scrapes, by what they mean.
ALIASES = {
    "group": ["groupName", "group_name", "pageName", "groupsName", "group"],
    "group_url": ["groupUrl", "group_url", "groupsUrl", "inputUrl"],
    "id": ["id", "postId", "post_id"],
    "url": ["url", "postUrl", "post_url", "permalink"],
    "text": ["postText", "post_text", "text", "message", "body"],
    "date": ["date", "posted_at", "createdAt", "created_at", "timestamp", "time"],
    "comments": ["postComments", "comments", "commentList", "commentsData"],
    "comment_text": ["commentText", "text", "message", "body", "comment"],
    "comment_name": ["commentAuthor", "authorName", "author", "commentAuthorName", "name", "userName", "username", "user"],
    "comment_author": ["commentAuthorId", "authorId", "userId", "user_id", "actorId", "author", "user"],
    "comment_date": ["commentTimestamp", "date", "posted_at", "createdAt", "created_at", "timestamp", "time"],
    "reactions": ["postReactionsCount", "reactionsCount", "reactionCount", "reactions_count"],
}
#: Keys that stored threads and their comments may have, and keys under which names stand.
THREAD_KEYS = ["id", "source", "group", "group_url", "url", "posted_at", "text", "reactions_count", "comment_count", "comments"]
COMMENT_KEYS = ["pseudonym", "text", "posted_at"]
NAME_KEYS = frozenset("name fullName displayName profileName userName username screenName handle author authorName postAuthor postAuthorName commentAuthor commentAuthorName from actor createdBy postedBy user owner commentAuthorUsername".split())
#: Names without a longer ASCII run are looked up by so many characters of other runs.
KEY = 4
PSEUDONYM = r"^member-[0-9a-f]{8}$"
PERMALINK = r"^https://(?:www\.|m\.|web\.|mobile\.|business\.)?facebook\.com/"


def identity(comment: Column, post: Column, at: Column) -> Column:
    """What a commenter is known by: an id, an id within the author object, a name, or the place."""
    nested = [f"{k}.{i}" for k in ("author", "user", "commentAuthor") for i in ("id", "userId")]
    ids = [k for k in ALIASES["comment_author"] if k not in ("author", "user")]
    plain = lambda keys: [F.when(~F.get_json_object(comment, f"$.{k}").startswith("{"), F.get_json_object(comment, f"$.{k}")) for k in keys]
    names = [F.get_json_object(comment, f"$.{k}.name") for k in ("author", "user", "commentAuthor")]
    return F.coalesce(R.first_text(*plain(ids), *[F.get_json_object(comment, f"$.{k}") for k in nested], *plain(["author", "user"]), *plain(ALIASES["comment_name"]), *names), F.concat_ws(":", F.lit("anon"), post, at.cast("string")))


def group_slug(name: Column, url: Column) -> Column:
    segment = F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"/groups/([^/?#]+)", 1), F.lit(""))
    return F.coalesce(F.nullif(T.slug(F.coalesce(name, F.lit(""))), F.lit("")), F.nullif(T.slug(segment), F.lit("")), F.lit("group"))


def anonymise(raw: DataFrame, salt: bytes, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Threads from a column of JSON posts, by whitelist; `errors` names posts that can't be kept. keep: columns of one's own that stay, such as a batch number."""
    j = F.col(column)
    comments = F.coalesce(*[F.from_json(F.get_json_object(j, f"$.{k}"), "array<string>") for k in ALIASES["comments"]], F.array().cast("array<string>"))
    d = raw.select(
        *keep,
        j.alias("_j"),
        F.substring(F.regexp_replace(F.coalesce(R.first_alias(j, ALIASES["id"]), F.lit("")), "[^A-Za-z0-9_-]", ""), 1, 120).alias("id"),
        R.first_alias(j, ALIASES["group"]).alias("group"),
        R.first_alias(j, ALIASES["group_url"]).alias("group_url"),
        R.first_alias(j, ALIASES["url"]).alias("url"),
        R.iso_timestamp(R.first_alias(j, ALIASES["date"])).alias("posted_at"),
        F.coalesce(R.first_alias(j, ALIASES["text"]), F.lit("")).alias("text"),
        R.first_int(j, ALIASES["reactions"]).alias("reactions_count"),
        comments.alias("_comments"),
    )
    d = d.withColumn("group_url", F.coalesce("group_url", F.nullif(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(https?://[^/]+/groups/[^/?#]+)", 1), F.lit(""))))
    made = F.transform("_comments", lambda c, i: F.struct(R.pseudonym(salt, identity(c, F.col("id"), i)).alias("pseudonym"), F.coalesce(R.first_alias(c, ALIASES["comment_text"]), F.lit("")).alias("text"), F.coalesce(R.iso_timestamp(R.first_alias(c, ALIASES["comment_date"])), F.lit("")).alias("posted_at")))
    names = F.filter(F.transform("_comments", lambda c: R.first_text(F.get_json_object(c, "$.commentAuthor.name"), F.get_json_object(c, "$.user.name"), F.when(~F.get_json_object(c, "$.commentAuthor").startswith("{"), F.get_json_object(c, "$.commentAuthor")))), lambda n: n.isNotNull() & name_like(n))
    d = d.withColumns({"source": F.lit("facebook"), "comments": made, "_names": names, "stem": F.concat_ws("-", group_slug(F.col("group"), F.coalesce("group_url", "url")), "id")})
    leaks = F.exists("_names", lambda n: name_in(n, F.concat_ws("\n", "text", F.array_join(F.transform("comments", lambda c: c["text"]), "\n"))))
    return d.withColumn("errors", errors((F.col("id") == "", "post without an id"), (~F.coalesce(F.col("url").rlike("^https://"), F.lit(False)), "post without a permalink"), (leaks, "an author's name stands in the text"))).select(*keep, "stem", "id", "source", "group", "group_url", "url", "posted_at", "text", "comments", "reactions_count", "errors")


def name_like(c: Column, strict: bool = True) -> Column:
    """Has a letter (strict: of any script), is no URL, and not all of its words are two characters long at most (strict: letters beyond ASCII count as long)."""
    letter = c.rlike(r"\p{L}" if strict else "[A-Za-z]")
    long = F.exists(F.split(F.trim(c), r"\s+"), lambda w: (F.length(w) > 2) | (w.rlike(r"[^\x00-\x7F]") if strict else F.lit(False)))
    return F.coalesce(letter & ~F.lower(c).rlike(r"^(https?:|www\.)") & long, F.lit(False))


def name_in(name: Column, text: Column) -> Column:
    """Whether the whole name stands in the text, case and white space aside, with no ASCII letter or digit at its sides."""
    n, t = T.norm(name), T.norm(text)
    return F.contains(t, n) & F.regexp_like(t, F.concat(F.lit(r"(?<![a-z0-9])\Q"), n, F.lit(r"\E(?![a-z0-9])")))


def name_leaks(texts: DataFrame, roster: DataFrame, id_col: str = "doc_id", text: str = "text", name: str = "name") -> DataFrame:
    """Rows of texts with each roster name that stands in them.

    Texts and names meet in an equi join on a key, and the whole name is checked only on the pairs found so. No side needs to
    be small, and texts stay where they are: keys travel with the row's id and checksum. A name of several words is
    looked up by where its first word meets its second: the run of ASCII letters and digits on either side of the blank,
    or the one character of another kind. One of a single word is looked up by a whole run of ASCII letters and
    digits, or up to KEY characters of a run of others, such as an accented letter behind a quote; texts get such keys only if
    there is such a name. Wherever name_in finds the name, the text has these too. Rows without a text give none;
    rows without an id, and repeated rows, give their own.
    """
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    plain = lambda t: F.regexp_extract_all(t, F.lit("[a-z0-9]+"), 0)
    other = lambda t: F.regexp_extract_all(t, F.lit("[^a-z0-9\\s]+"), 0)
    end = lambda w: F.regexp_extract(w, "(?:[a-z0-9]+|[^a-z0-9])$", 0)
    begin = lambda w: F.regexp_extract(w, "^(?:[a-z0-9]+|[^a-z0-9])", 0)
    meet = lambda x, y: F.xxhash64(F.concat(x, F.lit(" "), y))
    names = roster.where(name_like(F.col(name))).select(F.col(name).alias("name")).distinct()
    names = names.withColumns({"_n": T.norm(F.col("name")), "_w": split(T.norm(F.col("name")))})
    parts = F.concat(plain(F.col("_n")), F.transform(other(F.col("_n")), lambda r: F.substring(r, 1, KEY)))
    longest = F.array_max(F.transform(parts, lambda r: F.struct(F.length(r).alias("n"), r.alias("k"))))["k"]
    several = F.size("_w") > 1
    names = names.select("name", several.alias("_several"), F.when(several, meet(end(F.get("_w", F.lit(0))), begin(F.get("_w", F.lit(1))))).otherwise(F.xxhash64(longest)).alias("_k"))
    singles = not names.where("not _several").isEmpty()

    rows = texts.where(F.col(text).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), T.norm(F.col(text)).alias("_t"))
    rows = rows.withColumn("_w", split(F.col("_t")))
    more = F.greatest(F.size("_w") - 1, F.lit(0))
    rows = rows.withColumns({"_x": F.slice(F.transform("_w", end), F.lit(1), more), "_y": F.slice(F.transform("_w", begin), F.lit(2), more)})
    grams = lambda r: F.flatten(F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(KEY), F.length(r) - i + 1)), lambda n: F.substring(r, i, n))))
    keyed = lambda many, keys: F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(many).alias("_several"), k.alias("_k")))
    offered = keyed(True, F.zip_with("_x", "_y", meet))
    if singles:
        single = F.concat(F.array_distinct(plain(F.col("_t"))), F.flatten(F.transform(F.array_distinct(other(F.col("_t"))), grams)))
        offered = F.concat(offered, keyed(False, F.transform(single, lambda w: F.xxhash64(w))))
    found = rows.select("_id", "_h", F.inline(offered)).join(names, ["_several", "_k"]).select("_id", "_h", "name").distinct()
    own = texts.withColumn("_h", F.xxhash64(text))
    here = F.col(id_col).eqNullSafe(F.col("_id")) & (own["_h"] == found["_h"])
    return own.join(found, here).where(name_in(F.col("name"), F.col(text))).drop("_id", "_h")


def hygiene(json: Column) -> Column:
    """Errors of a stored anonymous thread in JSON."""
    from .validate import whitelist_violations

    extra = whitelist_violations(json, THREAD_KEYS)
    raw = F.from_json(F.get_json_object(json, "$.comments"), "array<string>")
    comment = lambda c: errors(
        (F.size(whitelist_violations(c, COMMENT_KEYS)) > 0, "comment keys outside the whitelist"),
        (~F.coalesce(F.get_json_object(c, "$.pseudonym").rlike(PSEUDONYM), F.lit(False)), "comment author is no pseudonym"),
        (F.get_json_object(c, "$.text").isNull() | F.get_json_object(c, "$.posted_at").isNull(), "comment text and posted_at must be strings"),
    )
    top = errors(
        (F.size(extra) > 0, F.concat(F.lit("keys outside the whitelist: "), F.array_join(extra, ","))),
        (~F.get_json_object(json, "$.source").eqNullSafe(F.lit("facebook")), "source is not facebook"),
        (~F.coalesce(F.get_json_object(json, "$.url").rlike(PERMALINK), F.lit(False)), "url is no permalink"),
        (raw.isNull(), "comments must be an array"),
    )
    return F.concat(top, F.coalesce(F.flatten(F.transform(raw, comment)), F.array().cast("array<string>")))


def walk(value, names: bool, path: str = "", under: bool = False, lists: bool = True) -> Iterator[tuple[str, str]]:
    """(path, string) of all strings of a JSON value, or of those under name keys; no recursion, so any depth."""
    todo = [(path, value, under)]
    while todo:
        at, v, named = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{at}.{k}" if at else k, x, k in NAME_KEYS) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(f"{at}[{i}]", x, named and lists) for i, x in reversed(list(enumerate(v)))]
        elif isinstance(v, str) and (named or not names):
            yield at, v


def strings(df: DataFrame, id_col: str, json_col: str, names: bool = False, lists: bool = True) -> DataFrame:
    """(id, path, value): strings of JSON columns of any depth; with names only those under name keys. Bad JSON gives no rows."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for key, raw in zip(b["id"], b["json"]):
                try:
                    value = _json.loads(raw)
                except (TypeError, ValueError):
                    continue
                rows += [(key, p, s) for p, s in walk(value, names, lists=lists)]
            yield pd.DataFrame(rows, columns=["id", "path", "value"])

    schema = Ty.StructType([Ty.StructField("id", df.schema[id_col].dataType), Ty.StructField("path", Ty.StringType()), Ty.StructField("value", Ty.StringType())])
    return df.select(F.col(id_col).alias("id"), F.col(json_col).alias("json")).mapInPandas(run, schema)
