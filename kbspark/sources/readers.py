"""Sources: threads, posts, distilled records, markdown docs, raw scrapes, REST APIs."""

from __future__ import annotations

import json
import subprocess
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T

COMMENT = "struct<id:bigint,user:string,created_at:string,body:string>"
THREAD = f"id bigint, repo string, number int, title string, html_url string, state string, labels array<string>, created_at string, closed_at string, comment_count int, body string, comments array<{COMMENT}>"
SOCIAL = "id string, source string, group string, group_url string, url string, posted_at string, text string, comments array<struct<pseudonym:string,text:string,posted_at:string>>, reactions_count int"
DISTILLED = "issue_id int, repo string, source string, group string, group_url string, url string, title string, symptom string, cause string, fix string, settings_changed array<string>, devices array<string>, android_versions array<string>, driver_tags array<string>, confidence string, evidence_quote string"


def _stem() -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def read_json(spark: SparkSession, path: str, schema: str, strict: bool = False, pattern: str = "*-*.json") -> DataFrame:
    """One object per file, with its stem. strict: a corrupt file fails the read; else it is left out."""
    reader = spark.read.schema(schema if strict else f"{schema}, _corrupt string").option("multiLine", True).option("pathGlobFilter", pattern)
    if strict:
        return reader.option("mode", "FAILFAST").json(path).withColumn("stem", _stem())
    df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("stem", _stem())
    return df.where(F.col("_corrupt").isNull() & ~F.col("stem").isin("state", "manifest")).drop("_corrupt")


def read_threads(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return read_json(spark, path, THREAD, strict)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Social posts as threads: pseudonyms are users, texts are bodies; without a title the headline is one."""
    df = read_json(spark, path, SOCIAL, pattern="*.json").where("source = 'facebook'")
    comments = F.transform("comments", lambda c: F.struct(c["pseudonym"].alias("user"), c["text"].alias("body"), c["posted_at"].alias("created_at")))
    title = F.coalesce(F.nullif(T.headline(F.col("text")), F.lit("")), F.concat(F.coalesce("group", F.lit("")), F.lit(" post")))
    return df.withColumns({"comments": comments, "title": title}).withColumnRenamed("text", "body")


def read_distilled(spark: SparkSession, path: str) -> DataFrame:
    """Distilled records; those without a url, or of a repository without an issue id, fail the read."""
    df = read_json(spark, path, DISTILLED, pattern="*.json")
    ok = F.col("url").isNotNull() & (F.col("source").eqNullSafe("facebook") | F.col("issue_id").isNotNull())
    return df.withColumn("url", F.when(F.assert_true(ok, F.concat(F.lit("no attribution: "), F.col("stem"))).isNull(), F.col("url")))


def parse_docs(files: DataFrame, strict_first: bool = True) -> DataFrame:
    """(slug, source_url, title, text) of (slug, value) with markdown whose source line is the first, or any."""
    source = r"^# Source: <?([^>\s]+)>?\s*$"
    lines = F.split("value", "\r?\n")
    url = F.regexp_extract(F.element_at(lines, 1), source, 1) if strict_first else F.coalesce(F.element_at(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, source, 1)), lambda x: x != ""), 1), F.lit(""))
    h1 = F.nullif(F.trim(F.regexp_extract("value", r"(?m)^# (?!Source: )(.+)$", 1)), F.lit(""))
    title = F.coalesce(h1, T.title_of(F.col("slug")))
    # the title stands before the text once: source lines and the title's own line go
    rest = F.filter(lines, lambda x: ~x.rlike(source) & ~F.coalesce(F.trim(F.regexp_extract(x, r"^# (.+)$", 1)) == h1, F.lit(False)))
    return files.select("slug", url.alias("source_url"), title.alias("title"), F.concat(title, F.lit("\n"), F.array_join(rest, "\n")).alias("text"))


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return parse_docs(files.select(_stem().alias("slug"), "value"))


def read_scrape(spark: SparkSession, path: str) -> DataFrame:
    """(value): the objects of JSON files that hold an array or one object."""
    raw = spark.read.text(path, wholetext=True)
    items = F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return raw.select(F.explode(items).alias("value")).where(F.trim("value").startswith("{"))


def classify(json: Column) -> Column:
    """Kind of a stored record by its structure."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    has = lambda *k: F.forall(F.array(*map(F.lit, k)), lambda x: F.array_contains(keys, x))
    return F.when(has("evidence_quote", "confidence"), "distilled").when(has("comments", "text"), "social_thread").when(has("comments", "repo"), "thread").otherwise("unknown")


def get(url: str, headers: dict[str, str] | None = None, attempts: int = 6, most_wait: float = 900, pause: float = 0, opener=urllib.request.urlopen, sleep=time.sleep) -> str:
    """A page by http(s), `pause` seconds after the one before: waits as told on 403 and 429, longer each time on 5xx and broken connections."""
    if pause:
        sleep(pause)
    if urllib.parse.urlparse(url).scheme not in ("http", "https"):
        raise ValueError(f"no http url: {url}")
    for n in range(attempts):
        try:
            with opener(urllib.request.Request(url, headers=headers or {}), timeout=60) as r:
                return r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if n + 1 == attempts or e.code not in (403, 429) and e.code < 500:
                raise
            sleep(min(most_wait, float(e.headers.get("Retry-After") or 60)) if e.code in (403, 429) else 2**n)
        except OSError:
            if n + 1 == attempts:
                raise
            sleep(2**n)
    raise AssertionError


def get_by(command: list[str], run=subprocess.run) -> object:
    """JSON that a command line client prints; its message if it fails."""
    done = run(command, capture_output=True, text=True, check=False)
    if done.returncode:
        raise OSError(f"{command[0]}: {done.stderr.strip()}")
    return json.loads(done.stdout or "null")


def listed(url: str, pages: int, size: int = 0, pool: int = 0, skip: str = "", fetch=get) -> Iterator[tuple[int, dict]]:
    """(page, item) of a listing by pages, without items that have the key `skip`: until a page is empty or has fewer than
    `size` items, or `pool` items are there."""
    found = 0
    for page in range(1, pages + 1):
        body = fetch(url.replace("{page}", str(page)))
        items = json.loads(body) if body.strip() else []
        for item in items:
            if not skip or item.get(skip) is None:
                found += 1
                yield page, item
        if not items or len(items) < size or pool and found >= pool or "{page}" not in url:
            return


class _Pages(DataSourceReader):
    def __init__(self, options, fetch=get):
        self.urls, self.fetch = [u for u in options.get("urls", "").split() if u], fetch
        self.pages, self.size, self.pool = (int(options.get(k, d)) for k, d in (("pages", 12), ("size", 0), ("pool", 0)))
        self.skip, self.pause = options.get("skip", ""), float(options.get("pause", 0))

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        fetch = (lambda url: get(url, pause=self.pause)) if self.fetch is get and self.pause else self.fetch
        for page, item in listed(partition.value, self.pages, self.size, self.pool, self.skip, fetch):
            yield partition.value, page, json.dumps(item)


class RestListing(DataSource):
    """spark.read.format("rest_listing").option("urls", "https://.../issues?page={page} ..."): one partition per listing, one row per item.

    Options: pages (at most so many), size (of a full page; a shorter one is the last), pool (stop at so
    many items), skip (a key that leaves an item out, such as that of pull requests), pause (seconds between pages).
    """

    @classmethod
    def name(cls):
        return "rest_listing"

    def schema(self):
        return "url string, page int, body string"

    def reader(self, schema):
        return _Pages(self.options)


def sources(spark: SparkSession, named: dict[str, str]) -> DataFrame:
    """(name, url) of a fixed list of pages."""
    return spark.createDataFrame(list(named.items()), "name string, url string")


def fetch_pages(named: DataFrame, fetch: Callable[[str], str] = get, workers: int = 4) -> DataFrame:
    """(name, url, html, error) of (name, url): a page that fails has an error and doesn't stop the rest."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for name, url in zip(b["name"], b["url"]):
                try:
                    out.append((name, url, fetch(url), None))
                except Exception as e:  # noqa: BLE001 - a failed page is a value
                    out.append((name, url, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["name", "url", "html", "error"])

    return named.select("name", "url").repartition(workers, "name").mapInPandas(run, "name string, url string, html string, error string")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a JSON array of strings; anything else fails the read."""
    raw = spark.read.text(path, wholetext=True)
    v = F.try_parse_json("value")
    kind = F.coalesce(F.schema_of_variant(v), F.lit("no JSON"))
    ok = F.assert_true(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.concat(F.lit("a roster is an array of strings, not "), kind))
    names = F.when(ok.isNull(), F.from_json("value", "array<string>"))
    return raw.select(F.explode(names).alias("name")).distinct()


def targets(spark: SparkSession, paths: list[str], pattern: str = "*.json", leave: tuple[str, ...] = ("state.json", "state.facebook")) -> tuple[list[str], list[str]]:
    """(files, missing): the files of the paths, which name files or folders, state files of folders left out; paths where nothing is."""
    files, missing = [], []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            missing.append(path)
        elif fs.getFileStatus(p).isFile():
            files.append(path)
        else:
            found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}"))
            names = sorted(x.getPath().toString() for x in found if x.isFile())
            files += [n for n in names if not any(x in n.rsplit("/", 1)[1] for x in leave)]
    return files, missing


def read_objects(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, value, error): JSON files as text; what can't be read as JSON has an error that names it."""
    raw = spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.withColumn("error", F.when(F.try_parse_json("value").isNull(), F.concat(F.lit("not JSON: "), F.col("path"))))


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table; empty where there is none yet. One that can't be read fails: work isn't done again in silence."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", "false").parquet(path)
