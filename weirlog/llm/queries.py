"""Queries opN_<name> and their SQL, with production parameters, over whole tables."""

from __future__ import annotations

from weirlog.llm import brown, media, mixing, neardup, packing, pii, quality, sharding, topk, toxicity
from weirlog.llm.common import documents


def op1_avi_clips(spark, sf_dir):
    return media.digests(media.store(documents(spark, sf_dir)))


def op2_quality_pu(spark, sf_dir):
    return quality.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_mix_sources(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


def op4_pii(spark, sf_dir):
    return pii.find(documents(spark, sf_dir))


def op5_toxicity_grades(spark, sf_dir):
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_exact_topk(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.search(vectors, vectors.filter(f"vec_id % {topk.EVERY} = 0"))


def op7_brown_lm(spark, sf_dir):
    return brown.score(documents(spark, sf_dir))


def op8_ngram_jaccard_join(spark, sf_dir):
    return neardup.join(documents(spark, sf_dir))


def op9_label_propagation(spark, sf_dir):
    return sharding.shard(documents(spark, sf_dir))


def op10_best_fit_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


QUERIES = {"op1_avi_clips": op1_avi_clips, "op2_quality_pu": op2_quality_pu, "op3_mix_sources": op3_mix_sources, "op4_pii": op4_pii, "op5_toxicity_grades": op5_toxicity_grades, "op6_exact_topk": op6_exact_topk, "op7_brown_lm": op7_brown_lm, "op8_ngram_jaccard_join": op8_ngram_jaccard_join, "op9_label_propagation": op9_label_propagation, "op10_best_fit_packing": op10_best_fit_packing}
ORACLE_SQL = {"op6_exact_topk": topk.SQL, "op3_mix_sources": mixing.SQL, "op8_ngram_jaccard_join": neardup.SQL}
