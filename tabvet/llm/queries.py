"""Registered queries of the training-data operators: key -> (callable, oracle SQL or None)."""
from __future__ import annotations

from tabvet.llm import (chat_format, decontaminate, exact_dedup, hard_negatives, license_scan, line_dedup, mixing, ngram_join, packing, periodic_runs,
                        quality, secrets, token_counts)
from tabvet.llm.common import table


def _documents(digest):
    return lambda spark, sf_dir: digest(table(spark, sf_dir, "documents"))


REGISTRY = {
    "op1_secret_scan": (_documents(secrets.digest_columns), None),
    "op2_line_dedup": (_documents(line_dedup.digest_columns), line_dedup.ORACLE.format(docs="documents")),
    "op3_exact_dedup": (_documents(exact_dedup.digest_columns), exact_dedup.ORACLE),
    "op4_mixing": (_documents(mixing.digest_columns), None),
    "op5_license_scan": (_documents(license_scan.digest_columns), None),
    "op6_quality_classifier": (lambda spark, sf_dir: quality.digest_columns(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), None),
    "op7_ngram_jaccard_join": (_documents(ngram_join.digest_columns), ngram_join.ORACLE),
    "op7_ngram_jaccard_links": (_documents(ngram_join.link_columns), ngram_join.LINKS_ORACLE),
    "op8_chat_format": (lambda spark, sf_dir: chat_format.digest_columns(table(spark, sf_dir, "conversations")), None),
    "op9_decontamination": (lambda spark, sf_dir: decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
                            decontaminate.ORACLE.format(docs="documents")),
    "op10_token_counts": (_documents(token_counts.count_tokens), None),
    "op11_periodic_runs": (_documents(periodic_runs.digest_columns), None),
    "op12_hard_negatives": (lambda spark, sf_dir: hard_negatives.query(table(spark, sf_dir, "embeddings")), hard_negatives.ORACLE),
    "op13_best_fit_packing": (_documents(packing.pack), None),
}
