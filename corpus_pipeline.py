"""A training corpus from documents, in five stages; each works on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import jaccard, mixing, packing, substring, toxicity
from pairloom.llm.textkit import read, shared_folder

#: No stage is expressed in SQL: models, connected components and tokenizing have no SQL form.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour model does not call toxic; it learns from the labels not held out."""
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs.withColumn("_pl_kept", F.col("text")), model)
    return scored.filter("predicted = 0").withColumnRenamed("_pl_kept", "text").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of Jaccard similarity 0.8 over five words join, the one of least doc_id; all rows of texts without words stay."""
    groups = jaccard.near_duplicates(docs, shingle=5, percent=80)
    heads = groups.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct("o", "tag")).alias("h")).select("h.o", "h.tag", F.lit(True).alias("one"))
    heads = heads.union(groups.filter("n_shingles = 0").select("o", "tag", F.lit(False)).distinct())
    # Two texts of one crc32 and o meet here only by chance; then both stay.
    heads = heads.groupBy(F.col("o").alias("_pl_o"), F.col("tag").alias("_pl_tag")).agg(F.min("one").alias("_pl_one"))
    keyed = docs.withColumns({"_pl_o": substring.order_id(F.col("doc_id"), F.coalesce("text", F.lit(""))), "_pl_tag": F.crc32(F.coalesce("text", F.lit("")))})
    kept = keyed.join(heads, ["_pl_o", "_pl_tag"]).withColumn("_pl_each", F.when(F.col("_pl_one"), F.xxhash64("text")).otherwise(F.monotonically_increasing_id()))
    return kept.dropDuplicates(["_pl_o", "_pl_tag", "_pl_each"]).select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of 20 words or more that stand earlier."""
    left = substring.without_repeats(docs).select(F.col("o").alias("_pl_o"), F.col("tag").alias("_pl_tag"), F.col("kept_text").alias("_pl_text"))
    rest = docs.withColumns({"_pl_o": substring.order_id(F.col("doc_id"), F.coalesce("text", F.lit(""))), "_pl_tag": F.crc32(F.coalesce("text", F.lit("")))}).drop("text")
    out = rest.join(left.dropDuplicates(["_pl_o", "_pl_tag"]), ["_pl_o", "_pl_tag"]).withColumn("text", F.col("_pl_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at the target weights: a row for each round of a document that it takes words of."""
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces with their places in sequences of at most 4096."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_group),
    ("substring_dedup", drop_repeats),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    home = shared_folder(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{home}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
