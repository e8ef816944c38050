"""Registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.llm import ann, decontam, divergence, html_regions, lexical, licenses, maxent, packing, pii, secrets, simhash, tokenfile, toxicity
from chronopanel.llm.common import table


def op1_simhash_near_duplicates(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_conditional_compression(spark, sf_dir):
    return licenses.license_notices(table(spark, sf_dir, "documents"))


def op3_maxent_language_scores(spark, sf_dir):
    return maxent.language_scores(table(spark, sf_dir, "documents"))


def op4_variable_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_personal_data_span_field(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_secret_ledger_scan(spark, sf_dir):
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark, sf_dir):
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity_factorization_machine(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_id_files(spark, sf_dir):
    return tokenfile.token_file(table(spark, sf_dir, "documents"))


def op10_inverted_multi_index(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op11_block_max_maxscore(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_html_main_text(spark, sf_dir):
    return html_regions.main_texts(table(spark, sf_dir, "pages"))


def op13_source_divergence_audit(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_duplicates, op2_license_conditional_compression, op3_maxent_language_scores, op4_variable_best_fit_packing, op5_personal_data_span_field, op6_secret_ledger_scan, op7_benchmark_decontamination, op8_toxicity_factorization_machine,
    op9_token_id_files, op10_inverted_multi_index, op11_block_max_maxscore, op12_html_main_text, op13_source_divergence_audit)}
ORACLES = {"op6_secret_ledger_scan": secrets.ORACLE, "op7_benchmark_decontamination": decontam.ORACLE, "op11_block_max_maxscore": lexical.ORACLE,
           "op13_source_divergence_audit": divergence.ORACLE}
