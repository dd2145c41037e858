"""The queries of this folder, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm.common import table

BPE, RANKS, SPECIAL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


#: Of the mixing query: even and odd sources are two domains, English weighs less than its bulk.
MIX = {("even",): 2, ("odd",): 3, ("even", "en"): 2, ("odd", "en"): 2, ("even", "en", "src0"): 3}


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.mixing import mixed

    docs = table(spark, sf_dir, "documents")
    domain = F.when(F.coalesce("source", F.lit("?")).rlike("[02468]$"), "even").otherwise("odd")
    return mixed(docs, MIX, share=0.8, epochs=2, seed=1, domain=domain)


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality_rules import line_quality

    return line_quality(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.url_filters import url_filter

    return url_filter(table(spark, sf_dir, "pages"), RULES)


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.suffixes import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.personal_data import personal_data

    return personal_data(table(spark, sf_dir, "documents"), redact=False)


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.path(BPE), SPECIAL)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.token_counts import token_counts

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.manifest import manifest

    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    return manifest(docs, F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.codebooks import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.discriminant import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nearest_neighbours": op1_nearest_neighbours,
        "op2_source_mixing": op2_source_mixing,
        "op3_line_frequency": op3_line_frequency,
        "op4_url_filters": op4_url_filters,
        "op5_repeated_passages": op5_repeated_passages,
        "op6_personal_data": op6_personal_data,
        "op7_harmonic_packing": op7_harmonic_packing,
        "op8_toxicity": op8_toxicity,
        "op9_ngram_join": op9_ngram_join,
        "pipeline": pipeline,
        "op10_token_counts": op10_token_counts,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_vector_codes": op12_vector_codes,
        "op13_quality_discriminant": op13_quality_discriminant,
    }


def oracle_sql() -> dict[str, str]:
    from quarry.llm import codebooks, manifest, mixing, neighbours, quality_rules

    weight = """CASE WHEN lang IS NULL THEN CASE domain WHEN 'even' THEN 2 ELSE 3 END
        WHEN source IS NULL THEN CASE lang WHEN 'en' THEN 2 ELSE 1 END
        WHEN domain = 'even' AND lang = 'en' AND source = 'src0' THEN 3 ELSE 1 END"""
    domain = "CASE WHEN regexp_matches(coalesce(source, '?'), '[02468]$') THEN 'even' ELSE 'odd' END"

    return {
        "op1_nearest_neighbours": neighbours.ORACLE,
        "op2_source_mixing": mixing.oracle(domain, weight, 0.8, 2, 1),
        "op3_line_frequency": quality_rules.ORACLE,
        "op11_merkle_manifest": manifest.ORACLE,
        "op12_vector_codes": codebooks.oracle(),
    }
