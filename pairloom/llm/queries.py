"""The registered queries of this subpackage, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bytebpe, chat, heavy, importance, jaccard, langid, mixing, packing, quality, sharding, substring, toxicity
from .textkit import read


def _documents(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(read(spark, sf_dir, "documents"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": _documents(packing.pack_documents),
    "op2_quality_divergence": _documents(quality.judge_documents),
    "op3_toxicity_neighbours": lambda spark, sf_dir: toxicity.rate_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")),
    "op4_source_mix": _documents(mixing.mix_documents),
    "op5_ann_ivfpq": lambda spark, sf_dir: ann.search_embeddings(read(spark, sf_dir, "embeddings")),
    "op6_chat_rotation": lambda spark, sf_dir: chat.rotate_conversations(read(spark, sf_dir, "conversations")),
    "op7_substring_dedup": _documents(substring.dedup_documents),
    "op8_sharding": _documents(sharding.shard_documents),
    "op9_langid_centroids": _documents(langid.identify_documents),
    "op10_jaccard_join": _documents(jaccard.join_documents),
    "op11_heavy_hitters": heavy.heavy_hitters,
    "op12_importance_resampling": lambda spark, sf_dir: importance.resample_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")),
    "op13_byte_bpe": _documents(bytebpe.encode_documents),
    "pipeline": _pipeline,
}

ORACLES: dict[str, str] = {"op6_chat_rotation": chat.ORACLE, "op11_heavy_hitters": heavy.ORACLE}
