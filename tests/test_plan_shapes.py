"""Scale guards on the physical plans of every registered query."""

import pytest

from lagscope.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
# built eagerly (iterative, checkpointed) -- their plans are checked in test_cluster
EAGER = {"pca_projection", "density_clusters", "cluster_members"}


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name, fn in QUERIES.items():
        if name in EAGER:
            continue
        out[name] = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_cartesian_or_nested_loop_joins(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_no_row_at_a_time_python(plans):
    assert [n for n, p in plans.items() if "Python" in p or "Pandas" in p] == []


def test_only_the_lag_kernel_leaves_the_jvm(plans):
    """Blocks of series and chunks of days as Arrow batches, twice per query."""
    assert {n: p.count("MapInArrow") for n, p in plans.items() if "InArrow" in p} == {
        n: 2 for n in plans if n.startswith("tlcc_")}


def test_fact_scans_are_pruned(plans):
    import re

    seen = 0
    for name, p in plans.items():
        for cols in re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem\.parquet", p):
            seen += 1
            assert "l_partkey" not in cols, (name, cols)          # never used: must be pruned
            assert len(cols.split(",")) <= 9, (name, cols)
    assert seen > 20
