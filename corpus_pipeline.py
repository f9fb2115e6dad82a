"""From raw documents to token ids: rules, classifier, near-dedup, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash, mixing, pieces, quality_classifier, quality_rules
from tidemark.llm.runtime import materialize

#: Near copies share five-word shingles with a similarity of 0.8 or more; the contract of op4_near_duplicates is another.
NEAR_PERCENT = 80


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does."""
    return quality_rules.judge(docs).filter("kept").select("__row.*")


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold. The model learns from the labelled rows of the raw
    table: the stage before has taken out many that are labelled low."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality_classifier.fit(raw, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score(docs, model)
    return scored.filter(scored["score"] >= quality_classifier.THRESHOLD).select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; documents without an id stay. Ids must be whole numbers.

    Unlike texts under one id are judged apart: where there are any, texts are numbered in the order of id and digest. Of rows with the
    same id and text the one whose other columns come first as JSON stays. The input travels in one struct, so any column names do.
    """
    others = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("id"), F.col("text").alias("text"), others.alias("others"))
    known = packed.filter("id IS NOT NULL").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = known.select("id", "digest").distinct()
    if texts.groupBy("id").count().filter("count > 1").isEmpty():
        known = known.withColumn("node", F.col("id"))
    else:
        ordered = texts.repartitionByRange("id", "digest").sortWithinPartitions("id", "digest")
        nodes = materialize(ordered.withColumn("node", F.monotonically_increasing_id()), "nodes")
        known = known.join(nodes, ["id", "digest"])
    verdicts = minhash.near_duplicates(known.select("node", "text"), key="node", percent=NEAR_PERCENT).filter("kept").select(F.col("doc_id").alias("node"))
    kept = known.join(verdicts, "node", "left_semi").groupBy("node").agg(F.min_by("doc", "others").alias("doc"))
    return kept.select("doc.*").unionByName(docs.filter("doc_id IS NULL"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the probabilities raked to the target marginals."""
    return mixing.mix(docs).filter("selected").select("__row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their digest and that of what they decode to."""
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id"], with_ids=True)
    return out.select("__row.doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("quality_classifier", apply_quality_classifier),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_to_targets),
    ("sentencepiece", encode),
]

#: The classifier, the raking and the encoding have no SQL form; tests check each stage by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
