"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from kpiforge.llm import (bpe_pairs, filter_audit, fingerprints, html_extract, lexical_search, packing, quality_rules, secrets_scan, sentencepiece_lattice,
                          simhash, token_counts, toxicity, warc)
from kpiforge.llm.common import read_table


def op1_html_extraction(spark, sf_dir):
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op2_secret_scan(spark, sf_dir):
    return secrets_scan.scan_documents(read_table(spark, sf_dir, "documents"))


def op3_simhash(spark, sf_dir):
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op7_warc(spark, sf_dir):
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_packing(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark, sf_dir):
    return sentencepiece_lattice.encode_documents(read_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_bpe(spark, sf_dir):
    return bpe_pairs.round_trip(read_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries():
    return {f.__name__: f for f in (op1_html_extraction, op2_secret_scan, op3_simhash, op4_toxicity, op5_fingerprints,
                                    op6_token_counts, op7_warc, op8_quality_rules, op9_packing, op10_sentencepiece, op11_filter_audit, op12_bpe,
                                    op13_lexical_search)}


def oracle_sql():
    return {"op11_filter_audit": filter_audit.AUDIT_SQL, "op13_lexical_search": lexical_search.SEARCH_SQL}
