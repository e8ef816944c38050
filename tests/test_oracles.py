"""Registered queries against their SQL oracles: one per group by default, all with CHRONOPANEL_ALL=1."""

import os

import pytest
from check_oracles import compare, connect

import __spark_entry__ as entry

SAMPLE = ("e0_gated_trades_by_month", "s1_guarded_scan", "s10_immutable_write", "p30_path_identity", "j1_asof_backward", "j4_strictly_prior_asof", "j8_distribution_interval_join",
          "a2_cell_aggregate", "a23_loss_attribution", "b3_cagr_contrast_bootstrap", "f3_change_detector", "f6_lifecycle", "f7_blend_weight_steps", "k8_connected_plateaus", "w8_ewma", "a12_rank_ic_by_date", "a46_context_matrix", "w6_prefix_wealth_metrics", "k1_entry_candidates", "k7_grid_neighbours", "d15_slice_digest",
          "t8_expanding_folds", "t14_recalibration", "r3_stop_overlay", "f1_recipe_hysteresis", "b2_partition_block_bootstrap", "u4_fold_table_function", "z10_resume_equals_continuous")


@pytest.fixture(scope="session")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("CHRONOPANEL_ALL") else SAMPLE)
def test_oracle(spark, con, sf_dir, name):
    ok, note, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), sf_dir)
    assert ok is not False, note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
