"""Catalogue queries against their SQL on the smallest tables (tools/compare.py runs all of them)."""

import pytest
from compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
CHOSEN = [
    "S4_clean_and_doubtful", "P18_build_metadata", "E1_tag_tokens", "E4_pair_one_hot", "F5_reason_counts", "F7_nested",
    "F9_in", "D1_dedupe_keep_first", "J1_salted_pair_counts", "K2_stratified_split", "K3_stratified_folds", "M10_scored_table",
    "A5_component_metrics", "M8_out_of_fold_worst_group", "C7_counterfactual_rows", "G6_histogram", "W3_log_cdf",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, con, name):
    assert compare(queries()[name](spark, SF), con, oracle_sql()[name]) == []


def test_entry_and_names(spark):
    rows = entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"Pol6TTaCod", "CoberturaLabel", "DoubtfulReason", "rows"}
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["K2_repeated_ids", "K3_repeated_ids", "D1_dedupe_wide", "P_encoded_dataset", "E3_sparse"])
def test_input_is_joined_once_and_written(spark, monkeypatch, name):
    """What these queries read in several passes is a written table, not the scan and join of the sources."""
    from premiumscope.catalogue import views

    made, kept = [], views.portfolio
    monkeypatch.setattr(views, "portfolio", lambda *given: made.append(1) or kept(*given))
    result = queries()[name](spark, SF)
    assert len(made) == 1
    assert not any("lineitem" in path for path in result.inputFiles())
