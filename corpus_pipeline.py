"""The corpus pipeline: five filtering and rewriting stages, then tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads
again for the next. All but the last return the columns of documents. n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veclode.llm import bpe, decontaminate, lines, neardup, toxicity
from veclode.llm.queries import toxicity_model, vocabulary
from veclode.llm.store import folder, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; the model learns from the labels outside the held-out fold."""
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return scored.where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and so do documents of which nothing else is left."""
    kept = lines.line_dedup(docs).where("n_removed = 0 OR trim(text) <> ''")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8) stays: the one of the smallest id.
    Texts that share an id are documents of their own; of rows that share both, one stays."""
    groups = written(neardup.groups(docs.select("doc_id", "text"), "doc_id", "text"))
    gone = groups.where("node <> component").select("node").distinct()
    twice = groups.where("n > 0 AND node = component").groupBy("node").count().where("count > 1").select("node")
    keyed = docs.withColumn("node", neardup.node_of("doc_id", "text"))
    once = keyed.join(gone.unionByName(twice), "node", "left_anti")
    one = keyed.join(twice, "node", "left_semi").dropDuplicates(["node"])
    return once.unionByName(one).select(*docs.columns)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that aligns with a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items).where(F.size("matches") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and digests of them and of what they decode to."""
    return bpe.round_trip(docs, vocabulary()).select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_copies),
    ("BPE encoding and decoding", encode),
]

#: The boosted trees of the first stage have no SQL form; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
