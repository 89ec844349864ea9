"""Catalogue queries against their SQL on the smallest tables, and the driver's contract."""

import os

import pytest

import __spark_entry__
from faithline.plans import catalogue, task_queries

SF = "/root/testdata/sf0.001"
SOME = ["dsl_filter_eq", "dsl_greater", "dsl_most_freq", "dsl_last", "dsl_all_less", "dsl_missing_column", "dsl_nested_stratified", "txt_checklist", "txt_baseline_answer", "val_parse_number", "tool_verdict", "iv_local_edits", "eval_baseline", "an_faith_table", "an_symmetry", "trace_duplicate", "trace_coerce", "trace_simulate", "dsl_program_parse", "dsl_program_batch", "trace_applicable_levels", "dsl_third", "dsl_before", "dsl_list_forms", "txt_answers", "an_accuracy", "an_graded_accuracy", "an_delta_colour", "sql_local_edits", *task_queries.QUERIES]


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 9)
    return x


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(x) for x in r]) for r in df.select(*names).collect())
    want = c.execute(f"SELECT {', '.join(names)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert got == sorted(repr([plain(x) for x in r]) for r in want)


def test_contract():
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries) and len([q for q in queries if q.startswith("dsl_")]) >= 50
