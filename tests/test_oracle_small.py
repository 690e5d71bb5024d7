"""A subset of registered queries against their DuckDB oracle at sf0.001."""
import math
from pathlib import Path

import duckdb
import pytest

from conftest import SF_SMALL
from kpiforge.sources.tables import TABLES

NAMES = ["flagship", "null_sentinels", "prof_columns", "dedup_key", "recalc_total", "impute_median", "kpi_filtered",
         "det_outlier_iqr", "canon_case", "fs_mutual_info", "val_score", "measure_pack", "chart_time",
         "clean_table_rules", "impute_select", "report_summary", "prof_distribution", "prof_light", "fs_select_rules"]


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return round(v, 6) if not math.isnan(v) else "nan"
        return v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(str, t)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF_SMALL)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, cur.fetchall())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert out.count() > 0 and out.columns == ["category", "revenue"]


#: Queries without SQL -> (test module, what it calls).
UNIT_TESTS = {
    "canon_fuzzy": ("test_canon.py", "C.fuzzy_mapping"),
    "fuzzy_pairs": ("test_canon.py", "C.fuzzy_pairs"),
    "det_outlier_iforest": ("test_models.py", "iforest_scores"),
    "det_outlier_consensus": ("test_cleaning.py", "ml.outlier_consensus"),
    "fs_forest": ("test_cleaning.py", "select.forest_importance"),
    "impute_forest": ("test_cleaning.py", "forest.impute_forest"),
    "impute_knn": ("test_models.py", "knn.impute_knn"),
    "fs_select": ("test_whole_results.py", "select.select_columns"),
    "sql_batch": ("test_whole_results.py", "sqlbatch.sql_batch"),
    "clean_table": ("test_cleaning.py", "CL.fit_and_clean"),
    "run_log": ("test_cleaning.py", "CL.plan_table"),
    "stream_clean": ("test_cleaning.py", "clean_stream"),
    "sem_pattern": ("test_semantic.py", "semantic.semantic_map"),
    "src_csv_encoding": ("test_files.py", "read_csv_any_encoding"),
    "src_json": ("test_files.py", "files.read_json"),
    "sink_csv": ("test_files.py", "files.write_csv"),
    "sink_report": ("test_files.py", "files.write_report"),
    "sink_bundle": ("test_files.py", "files.write_bundle"),
    "cat_tables": ("test_files.py", "files.list_tables"),
}


def test_every_query_has_oracle_or_unit_test():
    import __spark_entry__ as E
    from kpiforge.suite import catalog
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == set(UNIT_TESTS)
    for module, word in UNIT_TESTS.values():
        assert word in (Path(__file__).parent / module).read_text()
