"""Every registered query against its oracle SQL, and the shape of the plans."""

import pytest

import __spark_entry__ as entry
import catalog
from conftest import SF
from oracle import compare, connect

QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE
PYTHON = ("MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "ArrowEvalPython", "BatchEvalPython")
# Unicode composition, archive decoding, distances in tiles and time warping.
MAY_USE_PYTHON = {
    "fn_text_key", "src_keypoint_frames", "src_npz_metadata", "join_knn_candidates", "sep_silhouette", "sep_davies_bouldin", "sep_metrics_row",
    "dtw_distance", "dtw_intra_class", "dtw_inter_class", "dtw_pair_sample", "rpt_dtw_quantiles",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert compare(df, ORACLE[name], con) is None
    else:
        assert df.columns and df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in MAY_USE_PYTHON:
        assert not any(node in plan for node in PYTHON)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracle_covers_known_queries():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)
