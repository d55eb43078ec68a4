"""Joins whose sides the planner takes for smaller than they are broadcast nothing."""

import pytest

from rasterloom.plans import queries


def plan(df):
    df.collect()  # the plan as it was run in the end
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make", [queries.moved_pairs, queries.stray_pairs])
def test_points_meet_without_broadcasts(spark, data, make):
    p = plan(make(spark, data))
    assert "SortMergeJoin" in p and "Broadcast" not in p


def test_cones_meet_stars_without_broadcasts(spark, data):
    p = plan(queries.QUERIES["cone_search"](spark, data))
    assert "SortMergeJoin" in p and "Broadcast" not in p
