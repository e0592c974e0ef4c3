"""Plan guards: the physical plans keep the properties the design relies on."""

import re

from tests.conftest import SF_SMALL

import __spark_entry__ as entry_mod

Q = entry_mod.queries()


def plan(spark, name):
    return Q[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_recommend_prunes_and_pushes_down(spark):
    p = plan(spark, "recommend")
    assert "In(vec_id, [0,1" in p               # anchor filter reaches the parquet scan
    assert "LeftSemi" in p and "Broadcast" in p     # cluster pre-filter is a broadcast semi-join
    assert "WindowGroupLimit" in p                  # top-k per anchor, partial before the shuffle
    assert "MapInPandas" in p                       # block kernel, not a pair cross product
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_dedupe_limits_before_shuffle(spark):
    p = plan(spark, "dedupe_first")
    assert re.search(r"WindowGroupLimit .*Partial", p)


def test_no_single_task_percentile(spark):
    for name in ("percentile_floor", "distance_profile", "weighted_edges"):
        p = plan(spark, name)
        assert "percentile(" not in p.lower()


def test_projection_is_pruned(spark):
    p = plan(spark, "project")
    read = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert set(f.split(":")[0] for f in read.split(",")) == {"p_partkey", "p_name", "p_retailprice"}


def test_global_rank_has_no_unpartitioned_window(spark):
    # ranks come from range partitions + offsets, not rank() over one partition
    p = plan(spark, "rank_settings")
    assert "rank(" not in p and "SinglePartition" not in p


def test_store_recommend_prunes_partitions(spark):
    # the store is partitioned by cluster_id; the anchors' clusters prune it at run time
    assert "dynamicpruning" in plan(spark, "store_recommend")
