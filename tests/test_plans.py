"""Plan-shape checks on registered queries (SURVEY definition of done: no
Cartesian product other than broadcast one-row joins; top-k and
latest-per-key windows carry a partial group limit before the shuffle)."""
import pytest

from tabvet.plans.registry import REGISTRY

KEYS = ["column_profile", "numeric_stats", "iqr_outliers", "profile_top_values", "correlations",
        "clean_table", "ask_agg_sum", "split_stratified", "leakage_nmi", "roc_auc", "quality_verdict",
        "ledger_project_summary", "ledger_latest_run", "conversation_window", "dedupe_by_content_hash"]


def _plan(spark, sf, key):
    return REGISTRY[key][0](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_no_cartesian_product(spark, sf, key):
    assert "CartesianProduct" not in _plan(spark, sf, key)


@pytest.mark.parametrize("key", ["ledger_latest_run", "conversation_window", "profile_top_values_lineitem"])
def test_group_limit_before_shuffle(spark, sf, key):
    assert "WindowGroupLimit" in _plan(spark, sf, key)
