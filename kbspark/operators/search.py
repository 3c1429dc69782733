"""Inverted index and TF-IDF search, browsing, facets: plans over (rec_id, build_ord, kind, title, text)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T

KINDS = ["doc", "thread", "distilled"]
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}


def unify(docs: DataFrame, threads: DataFrame, distilled: DataFrame | None = None) -> DataFrame:
    """UNION ALL with the kind; each input has rec_id, title, text and what else it likes."""
    parts = [df.withColumn("kind", F.lit(k)) for k, df in zip(KINDS, (docs, threads, distilled)) if df is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def kind_order(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, i in zip(KINDS, range(len(KINDS))) for x in (k, i)]), kind)


def _occurrences(records: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(rec_id, term, t): each token of title (t = 1) and text, in one scan; only: of these words."""
    own = lambda c: T.tokens(F.col(c)) if only is None else T.tokens_of(F.col(c), only)
    parts = F.array(*[F.struct(F.lit(flag).alias("t"), own(c).alias("words")) for c, flag in (("title", 1), ("text", 0))])
    return records.select("rec_id", F.inline(parts)).select("rec_id", F.explode("words").alias("term"), "t")


def postings(records: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(rec_id, term, title_tf, text_tf): one shuffle, combined within tasks before it."""
    return _occurrences(records, only).groupBy("rec_id", "term").agg(F.sum("t").cast("bigint").alias("title_tf"), F.sum(1 - F.col("t")).cast("bigint").alias("text_tf"))


#: Folders of a stored index that postings are dealt to by term, and files in each.
BUCKETS, FILES = 64, 4


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Index(NamedTuple):
    """records; postings (rec_id, term, title_tf, text_tf, bucket); terms (term, df); size (n)."""

    records: DataFrame
    postings: DataFrame
    terms: DataFrame
    size: DataFrame

    def of(self, words: list[str]) -> DataFrame:
        """Postings of some words: only the folders of their buckets are read, and of these the parts that may have them."""
        spark = self.records.sparkSession
        if not words:
            return self.postings.where(F.lit(False))
        at = [r[0] for r in spark.createDataFrame([(w,) for w in words], "term string").select(_bucket(F.col("term"))).distinct().collect()]
        return self.postings.where(F.col("bucket").isin(at) & F.col("term").isin(words)).drop("bucket")


def write_index(records: DataFrame, path: str) -> Index:
    """Tokenises the records once and stores what searches need. Terms that stand in very many records are dealt to several files by record."""
    spark = records.sparkSession
    records.write.mode("overwrite").parquet(f"{path}/records")
    stored = spark.read.parquet(f"{path}/records")
    dealt = postings(stored).withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("rec_id"), F.lit(FILES)))
    dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    document_frequency(spark.read.parquet(f"{path}/postings")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    stored.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/size")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> Index:
    """A stored index; a missing part fails."""
    schema = "rec_id string, term string, title_tf bigint, text_tf bigint, bucket int"
    return Index(spark.read.parquet(f"{path}/records"), spark.read.schema(schema).parquet(f"{path}/postings"), spark.read.schema("term string, df bigint").parquet(f"{path}/terms"), spark.read.schema("n bigint").parquet(f"{path}/size"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def frequencies(records: DataFrame) -> DataFrame:
    """(term, df) of all words. A record's distinct words are counted where it is read, and counts are combined before the
    shuffle; only if an id stands in several rows do ids travel with the words."""
    if not records.groupBy("rec_id").count().where("count > 1").isEmpty():
        return document_frequency(postings(records))
    words = F.array_distinct(F.concat(T.tokens(F.col("title")), T.tokens(F.col("text"))))
    return document_frequency(records.select(F.explode(words).alias("term")))


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (F.coalesce(df, F.lit(0)) + 0.5))


def query_terms(spark: SparkSession, queries: dict[int, str], synonyms: dict[str, list[str]] = T.SYNONYMS) -> DataFrame:
    """(query_id, qpos, term, alias, m) of the queries, which are few; repeated words count again."""
    q = spark.createDataFrame(list(queries.items()), "query_id int, query string")
    q = q.select("query_id", F.posexplode(T.tokens(F.col("query"))).alias("qpos", "term"))
    q = q.withColumn("m", F.count("*").over(Window.partitionBy("query_id")))
    pairs = [(t, a) for t, many in synonyms.items() for a in many]
    if not pairs:
        return q.withColumn("alias", F.col("term"))
    syn = spark.createDataFrame(pairs, "term string, alias_ string")
    return q.join(syn, "term", "left").select("query_id", "qpos", "term", F.coalesce("alias_", "term").alias("alias"), "m")


def search(records: DataFrame | Index, queries: dict[int, str], k: int = 25, synonyms: dict[str, list[str]] = T.SYNONYMS) -> DataFrame:
    """(query_id, rank, rec_id, score, matched): the k best of each query, over records or a stored index.

    Without an index frequencies are counted for the queries' own words alone: the words, a handful, filter the
    tokens before the shuffle. Scores are rounded to six places, ties go by build_ord.
    """
    index = records if isinstance(records, Index) else None
    records = index.records if index else records
    spark = records.sparkSession
    q = query_terms(spark, queries, synonyms)
    wanted = sorted({w for r in q.select("term", "alias").collect() for w in r})  # words of the queries, not of the corpus
    posts = index.of(wanted) if index else postings(records, wanted)
    df = index.terms.where(F.col("term").isin(wanted) if wanted else F.lit(False)) if index else document_frequency(posts)
    n = index.size if index else records.agg(F.count("*").alias("n"))
    best = posts.withColumnRenamed("term", "alias").join(F.broadcast(q), "alias").groupBy("query_id", "qpos", "term", "m", "rec_id").agg(F.max("title_tf").alias("title_tf"), F.max("text_tf").alias("text_tf"))
    weighed = best.join(df, "term", "left").crossJoin(F.broadcast(n))
    part = idf(F.col("n"), F.col("df")) * (5 * F.col("title_tf") + F.col("text_tf"))
    scored = weighed.withColumn("part", part).groupBy("query_id", "m", "rec_id").agg(F.sum("part").alias("raw"), F.count("*").alias("matched"))
    scored = scored.withColumn("score", F.round(F.col("raw") * (0.35 + 0.65 * F.col("matched") / F.col("m")), 6))
    scored = scored.join(records.select("rec_id", "build_ord"), "rec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "build_ord"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= (k or 25)).select("query_id", "rank", "rec_id", "score", "matched")


def found(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits with columns of their records. The hits, k a query at most, travel; the records stay where they are read."""
    return F.broadcast(hits).join(records, "rec_id")


def complete(symptom: Column, cause: Column, fix: Column) -> Column:
    out = F.lit(True)
    for c in (symptom, cause, fix):
        out = out & (F.length(F.trim(F.coalesce(c, F.lit("")))) > 0)
    return out


def conclusions_only(df: DataFrame, include: bool = False) -> DataFrame:
    """Without distilled records that lack a part; other kinds pass."""
    return df if include else df.where((F.col("kind") != "distilled") | F.col("complete"))


def facet_filter(df: DataFrame, kind: str | None = None, tag: str | None = None, version: str | None = None) -> DataFrame:
    """For results: applied after the limit, nothing is filled up."""
    for ok in ([F.col("kind") == kind] if kind else []) + ([F.array_contains("tags", tag)] if tag else []) + ([F.array_contains("versions", version)] if version else []):
        df = df.where(ok)
    return df


def facets(df: DataFrame, **arrays: str) -> DataFrame:
    """(facet, value, n) for array columns, in one pass."""

    def named(facet: str):
        return lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value"))

    pairs = F.flatten(F.array(*[F.transform(F.col(c), named(f)) for f, c in arrays.items()]))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def confidence_weight(c: Column) -> Column:
    out = F.lit(0)
    for name, w in CONFIDENCE.items():
        out = F.when(c == name, F.lit(w)).otherwise(out)
    return out


def browse_keys() -> list[Column]:
    """Order of the browse view, for kind, confidence, comments, title, rec_id."""
    first = F.when(F.col("kind") == "doc", 0).when(F.col("kind") == "distilled", 1).otherwise(2)
    return [first, F.when(F.col("kind") == "distilled", -confidence_weight(F.col("confidence"))).otherwise(F.lit(0)), F.desc_nulls_last("comments"), F.asc_nulls_last("title"), F.col("rec_id")]


def browse(df: DataFrame, page: int = 0, size: int = 40) -> DataFrame:
    """One page; the order is spelt out to the last tie."""
    return df.orderBy(*browse_keys()).offset(page * size).limit(size)


def top_records(df: DataFrame, k: int = 4) -> DataFrame:
    """The k complete records of greatest confidence, then comments, then title. Social records don't count, nor those without a
    repository or number, where the columns source, repo and issue_id are there to tell."""
    if "source" in df.columns:
        df = df.where(~F.col("source").eqNullSafe("facebook"))
    for c in ("repo", "issue_id"):
        if c in df.columns:
            df = df.where(F.col(c).isNotNull())
    return df.where("complete").orderBy(F.desc(confidence_weight(F.col("confidence"))), F.desc_nulls_last("comments"), F.asc_nulls_last("title"), "rec_id").limit(k)


def with_comments(records: DataFrame, counts: DataFrame, key: str = "stem", count: str = "comments") -> DataFrame:
    """records with the number of comments of their threads, 0 without a thread."""
    return records.join(counts.select(key, F.col(count).alias("_n")), key, "left").withColumn(count, F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_n")


def vocabulary_facet(df: DataFrame, tags: str, vocabulary: list[str]) -> DataFrame:
    """(value, n, ord): counts of the vocabulary's tags in its order, those that don't occur left out."""
    order = F.create_map(*[x for i, v in enumerate(vocabulary) for x in (F.lit(v), F.lit(i))])
    own = df.select(F.explode(F.array_distinct(F.col(tags))).alias("value")).where(F.col("value").isin(vocabulary))
    return own.groupBy("value").agg(F.count("*").alias("n")).withColumn("ord", F.element_at(order, F.col("value"))).orderBy("ord")


def version_facet(df: DataFrame, versions: str, k: int = 8) -> DataFrame:
    """(value, n): the k greatest versions by their number, with their counts."""
    own = df.select(F.explode(F.array_distinct(F.col(versions))).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    number = F.split_part("value", F.lit(" "), F.lit(-1)).try_cast("double")
    return own.orderBy(F.desc_nulls_last(number), "value").limit(k)


def issue_ref(repo: Column, number: Column) -> Column:
    """The repository's short name and the number."""
    return F.concat(F.split_part(repo, F.lit("/"), F.lit(2)), F.lit("#"), number.cast("string"))


def display(df: DataFrame) -> DataFrame:
    """df (kind, source, url, title, posted_at, repo, number) with what a card shows: where it comes from, its host, its day, its reference."""
    origin = F.when(F.col("source").eqNullSafe("facebook"), "community").when(F.col("kind") == "doc", "docs").otherwise("github")
    return df.withColumns({"origin": origin, "host": T.url_host(F.col("url")), "day": F.substring(F.coalesce("posted_at", F.lit("")), 1, 10), "ref": F.when(F.col("repo").isNotNull(), issue_ref(F.col("repo"), F.col("number")))})


def distilled_text(title: Column, *parts: Column) -> Column:
    """Search text of a distilled record: title, symptom, cause, fix, and lists joined by blanks."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), *[F.coalesce(p, F.lit("")) for p in parts])


def view(records: DataFrame | Index, query: str | None, browse_all: bool = False, kind: str | None = None, tag: str | None = None, version: str | None = None, page: int = 0) -> DataFrame:
    """What a reader sees: a browse page if it is asked for or if a facet is chosen without a query, the landing list for a blank query, else a search."""
    rows = records.records if isinstance(records, Index) else records
    blank = not (query or "").strip()
    if browse_all or blank and (kind or tag or version):
        return browse(facet_filter(rows, kind, tag, version), page)
    if blank:
        return top_records(rows)
    return facet_filter(found(search(records, {0: query}, 60), rows), kind, tag, version).orderBy("rank")


def acceptance(records: DataFrame | Index, queries: dict[int, str], kinds: tuple[str, ...] = ("doc", "thread"), k: int = 25) -> DataFrame:
    """(query_id, kind, hits, ok): whether each query finds records of each kind among its k best."""
    rows = records.records if isinstance(records, Index) else records
    spark = rows.sparkSession
    hits = found(search(records, queries, k), rows.select("rec_id", "kind")).groupBy("query_id", "kind").agg(F.count("*").alias("hits"))
    asked = spark.createDataFrame([(q, x) for q in queries for x in kinds], "query_id int, kind string")
    n = F.coalesce("hits", F.lit(0)).cast("bigint")
    return asked.join(hits, ["query_id", "kind"], "left").select("query_id", "kind", n.alias("hits"), (n > 0).alias("ok"))
