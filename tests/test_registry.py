"""Registered queries against their SQL; VOXEVAL_ALL=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

ORACLES = entry.oracle_sql()
SAMPLE = (
    "s2_file_inventory s4_read_volumes p3_group_key p8_linear_score p13_noisy_or j4_mirror j5_box_join j9_retry r3_gaussian_blur r5_foreground_mask "
    "r8_close r9_largest_component r13_constrained_peak r16_affine_resample_each r21_align r25_build_atlas r30_harmonize_blur f5_hot_extent f8_ap_gradient "
    "f9_peak_boxes f11_zonal_ratio f17_asymmetry k1_merge_rare k2_stratified_folds k3_group_folds m2_auc_by_group m4_scoreboard m6_paired_bootstrap "
    "m9_shift_report l4_fit_many_logistic l5_cv_predict_features l9_fit_stack e4_seed_weighted_bag e8_weight_scan c5_fit_beta c7_prior_shrink "
    "c8_label_flip_sensitivity q1_check_submission q5_leak_check st1_score_stream u1_batch_score"
).split()
NAMES = list(ORACLES) if os.environ.get("VOXEVAL_ALL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, connect(sf), sf, entry.queries()[name], ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 12


@pytest.mark.parametrize("name", ["j10_grid_join", "m2_auc", "r20_ncc", "k2_stratified_folds", "c1_temperature_floor", "e11_pool_scan", "f15_integrated_excess"])
def test_no_cartesian_product(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
