"""Physical-plan checks: pushdown, pruning, and no unbounded joins."""

import __spark_entry__ as E

from conftest import SF_SMALL


def plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_drift_scans_are_filtered_and_pruned(spark):
    p = plan(spark, "d2_categorical_drift")
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in p or \
           "LessThan(l_shipdate" in p
    assert "GreaterThanOrEqual(l_shipdate" in p
    assert "l_orderkey" not in p          # column pruning: keys are never read
    assert "SortMergeJoin" not in p and "CartesianProduct" not in p


def test_profile_and_metrics_have_no_shuffle_joins(spark):
    for name in ("q1_profile_numeric", "q2_profile_categorical", "e3_confusion_matrix",
                 "q7_histogram", "p7_prepare", "g1_check_requirements"):
        p = plan(spark, name)
        assert "SortMergeJoin" not in p, name
        assert "CartesianProduct" not in p, name


def test_split_and_folds_do_not_shuffle(spark):
    for name in ("p6_train_test_split", "t2_assign_folds", "c0_normalize_missing"):
        p = plan(spark, name)
        assert "Exchange" not in p, name
