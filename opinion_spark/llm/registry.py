"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from opinion_spark.llm import collocations, decontaminate, exact_dedup, licenses, merkle, mixing, ngram_join
from opinion_spark.llm import quotes, search, secrets, suffixes, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_bm25_search": search.op3_bm25_search,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_warc": warc.op5_warc,
    "op6_quotation_linking": quotes.op6_quotation_linking,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_suffix_dedup": suffixes.op9_suffix_dedup,
    "op10_source_mixing": mixing.op10_source_mixing,
    "op11_collocations": collocations.op11_collocations,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_license_scan": licenses.licenses_sql("documents"),
    "op4_secret_scan": secrets.secrets_sql("documents"),
    "op5_warc": warc.warc_sql("pages"),
    "op8_decontamination": decontaminate.decontamination_sql("documents", "benchmark"),
    "op10_source_mixing": mixing.mixing_sql("documents"),
    "op11_collocations": collocations.collocations_sql("documents"),
    "op12_merkle_manifest": merkle.merkle_sql("documents"),
    "op13_exact_dedup": exact_dedup.exact_dedup_sql("documents"),
}
