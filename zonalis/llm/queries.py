"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from zonalis.llm import prefix_trie, unit_dedup, url_cascade
from zonalis.llm.compression_toxicity import fit_toxicity, score_toxicity
from zonalis.llm.decontaminate import contaminated
from zonalis.llm.license_scan import scan_licenses
from zonalis.llm.piece_codec import round_trip
from zonalis.llm.periodic_runs import periodic_runs
from zonalis.llm.pii_surrogates import surrogate_texts
from zonalis.llm.quality_ranking import fit_ranking, rank_quality
from zonalis.llm.quality_rules import fit_ratios, quality_rules
from zonalis.llm.simhash import simhash_components
from zonalis.llm.token_planes import token_planes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The key of the registered query; a user keeps one of their own secret.
SURROGATE_KEY = b"zonalis-example-key"


def pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate_texts(spark, _table(spark, sf_dir, "documents"), SURROGATE_KEY)


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark, _table(spark, sf_dir, "documents"))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.repeated_units(spark, _table(spark, sf_dir, "documents"))


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.repeated_passages(spark, _table(spark, sf_dir, "documents"))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules(spark, docs, fit_ratios(docs, _table(spark, sf_dir, "labels")))


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return rank_quality(spark, docs, fit_ranking(docs, _table(spark, sf_dir, "labels")))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(spark, docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_cascade.judge_urls(spark, pages, url_cascade.rule_table(spark), url_cascade.hosts_by_words(pages))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_table(spark, sf_dir, "documents"), planted=True)


def trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark, _table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {
        "op1_pii_surrogates": pii_surrogates,
        "op2_license_scan": license_scan,
        "op3_simhash_components": simhash,
        "op4_benchmark_leaks": benchmark_leaks,
        "op5_repeated_units": repeated_units,
        "op5_repeated_passages": repeated_passages,
        "op6_token_planes": planes,
        "op7_quality_rules": rules,
        "op8_quality_ranking": ranking,
        "op9_piece_codec": pieces,
        "op10_toxicity": toxicity,
        "op11_prefix_trie": trie,
        "op12_url_cascade": url_verdicts,
        "op13_periodic_runs": runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_repeated_units": unit_dedup.ORACLE_SQL, "op11_prefix_trie": prefix_trie.ORACLE_SQL, "op12_url_cascade": url_cascade.ORACLE_SQL}
