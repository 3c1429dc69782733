"""A corpus pipeline: every stage takes the documents that its predecessor kept.

    toxicity         documents that the classifier rejects go
    exact_dedup      of equal texts (white space aside) one stays
    near_dedup       of each group of near copies (five-word shingles, similarity 0.8) one stays
    packing          the rest is tokenised and packed into sequences of 2048 tokens

Each function takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each one's
result as Parquet in the shared folder and reads it again for the next. All but the last give the
columns of documents, whatever they are called. Rows are joined to decisions by doc_id; a doc_id that repeats is kept or
dropped as one, and so are the rows without one: they stay as long as one of them does.
Null and empty texts are documents like others: clean, equal to one another, and packed as a separator alone.
"""

from __future__ import annotations

import public_tokenizers
from kbspark.llm import exact, neardup, packing, toxicity
from kbspark.llm.common import new_path, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _kept(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    keep = decisions.where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_id"]), "left_semi")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs.select(F.col("doc_id").cast("bigint").alias("id"), "text"), table(spark, sf_dir, "labels"))
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    own = docs.withColumn("text", F.col("text").cast("string"))
    return toxicity.scored(own, model, docs.columns, name).where(F.col(name) < 0.5).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, exact.exact_duplicates(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, neardup.near_duplicates(docs, words=5, per_cent=80))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, separator=0)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("packing", pack_sequences)]

#: No stage but exact_dedup can be said in SQL: the classifier, the components and the packing can't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
