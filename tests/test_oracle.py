"""Every registered query with SQL equals its DuckDB equivalent; every other one has rows, and a test of its method by name."""

import importlib

import pytest

from freshet.plans import registry
from tests.oracle import differences

SF = "/root/testdata/sf0.01"
registry.load()

#: Queries that SQL does not state, with the test that holds their operator against brute force or its rule.
METHOD_TESTS = {
    "agg_bootstrap": "test_methods.test_bootstrap_interval_covers_the_value",
    "grid_synthetic_extent": "test_small_forms.test_synthetic_extent_by_hand",
    "join_idw_hierarchical": "test_large_groups.test_idw_by_squares_is_near_the_exact_mean",
    "rain_augment": "test_small_forms.test_augmented_rain_by_hand",
    "rain_ensemble": "test_large_groups.test_noise_is_smooth_and_keeps_its_spread",
    "rain_storm_ensemble": "test_large_groups.test_storms_are_read_again_at_old_steps",
    "score_bulk": "test_methods.test_scores_lie_in_range_and_invalid_requests_go",
    "smp_assign_periods": "test_methods.test_periods_follow_weights",
    "smp_balanced_tiles": "test_methods.test_split_and_balance_have_exact_counts",
    "smp_pairs": "test_methods.test_sample_of_pairs_is_the_same_at_any_partitioning",
    "smp_split_tiles": "test_methods.test_split_and_balance_have_exact_counts",
    "src_process_files": "test_methods.test_files_that_fail_are_rows",
    "str_throttled_warnings": "test_small_forms.test_late_and_repeated_warnings",
    "tile_scenarios": "test_small_forms.test_scenario_copies_of_tiles",
    "win_throttle": "test_large_groups.test_throttled_chains_over_levels",
}


def test_queries_without_sql_have_a_test_of_their_method():
    assert set(registry.QUERIES) - set(registry.SQL) == set(METHOD_TESTS)
    for name in METHOD_TESTS.values():
        module, test = name.split(".")
        assert callable(getattr(importlib.import_module(f"tests.{module}"), test))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tmp_path, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.SQL:
        assert differences(df, registry.SQL[name], SF, str(tmp_path / "out")) == []
    else:
        assert df.limit(1).count() == 1
