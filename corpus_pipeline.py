"""Corpus pipeline: quality rules, toxicity, SimHash near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, with the columns of
documents; the last one returns the packed pieces. ``run`` writes every stage's result to the
shared folder and reads it again for the next. Nulls, empty tables, repeated rows and extra
columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from kpiforge.llm import packing, quality_rules, secrets_scan, simhash, toxicity
from kpiforge.llm.common import prepare, read_table, stored


def quality_stage(spark, docs, sf_dir):
    """Rejects documents that fail the base rule or a risk-controlled cut-off."""
    prepare(spark)
    return quality_rules.keep_good(docs, read_table(spark, sf_dir, "labels"))


def toxicity_stage(spark, docs, sf_dir):
    """Rejects documents scored as toxic."""
    prepare(spark)
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark, docs, sf_dir):
    """Keeps one document of each SimHash group, the one with the smallest doc_id."""
    prepare(spark)
    return simhash.keep_one_per_group(docs)


def secret_stage(spark, docs, sf_dir):
    """Masks secrets in the texts; every document stays."""
    prepare(spark)
    return secrets_scan.redact(docs)


def packing_stage(spark, docs, sf_dir):
    """Packs the kept documents' tokens into windows: one row per piece."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_stage), ("toxicity", toxicity_stage), ("simhash_near_duplicates", near_duplicate_stage),
          ("secret_scan", secret_stage), ("packing", packing_stage)]

#: Classifier, Hamming groups and tokenizer cannot be written in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
