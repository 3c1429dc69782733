"""One query for each operator of this subpackage, over its whole table, with DuckDB SQL where that can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embed, exact, html, licenses, neardup, packing, sharding, toxicity, warc
from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, per_cent=80)


def op4_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), capacity=2048, separator=0)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=40)


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_warc, op3_near_duplicates, op4_exact_duplicates, op5_packing, op6_sharding, op7_near_vectors, op8_toxicity, op9_licenses, op10_html, pipeline)}

SQL = {
    "op2_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
        f as (select *, min(page_id) over (partition by d) as first from p)
        select page_id, n as payload_bytes, d as payload_digest,
               case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
               case when n >= 100 and page_id <> first then first end as refers_to
        from f""",
    "op4_exact_duplicates": r"""
        with t as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as k from documents),
        w as (select doc_id, first_value(doc_id) over (partition by k order by n desc, doc_id) as keep_id,
                     count(*) over (partition by k) as group_size, sha256(k) as text_sha256 from t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from w""",
}
