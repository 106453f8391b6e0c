"""Every registered query against its SQL twin, and its plan."""

import os
import re

import pytest

import __spark_entry__ as entry_points
import checks
from opinionlake.plans.catalog import CAPS, QUERIES
from opinionlake.plans.oracles import ORACLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return checks.duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


# Columns that are the same in every row by what they mean.
CONSTANT = {
    "incremental_rerun": {"to_process_count", "inserted_new"},
    "incremental_run": {"matched_existing"} if SF.endswith("sf0.001") else set(),
    "index_reuse": {"doc_count", "built_from"},
    "page_reviews": {"card_no"},
    "plain_values": {"names"},
    "user_get": {"found"} if SF.endswith("sf0.001") else set(),
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql_without_cross_join(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    rows = []
    assert checks.differences(df, con, ORACLES[name], rows) == []
    assert rows and checks.constant_columns(rows, df.columns) <= CONSTANT.get(name, set())


def test_caps_remove_rows(spark, con):
    for name, most in (("collect_capped", sum(CAPS.values())), ("page_collect", CAPS["aladin"])):
        assert len(con.execute(ORACLES[name]).fetchall()) <= most
    whole = con.execute(ORACLES["dedupe_content"]).fetchall()
    assert len(con.execute(ORACLES["collect_capped"]).fetchall()) < len(whole)
    assert len(con.execute(ORACLES["corpus_capped"]).fetchall()) < len(con.execute(ORACLES["content_keys"]).fetchall())


def test_the_row_report_ends_at_what_cleaning_keeps(con):
    kept = {r[0]: r[1] for r in con.execute(f"SELECT site, rows_kept FROM ({ORACLES['filter_report']})").fetchall()}
    for site in kept:
        assert kept[site] == len(con.execute(ORACLES[f"clean_{site}"]).fetchall())


def test_scans_read_needed_columns(spark):
    plan = QUERIES["length_features"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert schemas == {
        "doc_id:bigint,text:string", "event_id:bigint,value:double", "o_orderkey:bigint,o_orderdate:timestamp_ntz"
    }


@pytest.mark.parametrize("name", ["monthly_count", "hist_length", "top_terms", "features_full", "filter_report"])
def test_the_input_is_read_once(spark, name):
    """After the one pass that stages cleaned rows, no plan reads the source tables again."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "staged-" in plan and "documents.parquet" not in plan


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
