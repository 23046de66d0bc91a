"""Plans that must stay as they are: pruned columns, rank limits before shuffles, combine steps, no row-at-a-time Python."""

import contextlib
import io

from chronolith.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        QUERIES[name](spark, SF).explain("formatted")
    return out.getvalue()


def test_rank_limit_before_the_shuffle(spark):
    p = plan(spark, "sample_bottomk")
    assert p.count("WindowGroupLimit") >= 2 and "n_chars" not in p.split("ReadSchema")[1].split("\n")[0]


def test_first_copies_are_combined(spark):
    p = plan(spark, "dedup_canonical")
    assert "Window" not in p and "partial_min" in p


def test_scan_reads_two_columns(spark):
    p = plan(spark, "weighted_loss_rollup")
    assert "l_orderkey" not in p


def test_no_row_at_a_time_python(spark):
    for name in QUERIES:
        if not name.startswith("stream_"):
            p = plan(spark, name)
            assert "BatchEvalPython" not in p and "CartesianProduct" not in p, name


def test_pairs_meet_by_key(spark):
    for name in ("neighbor_methods", "low_overlap_links"):
        assert "NestedLoop" not in plan(spark, name) and "CartesianProduct" not in plan(spark, name), name


def test_no_window_without_a_key_over_nodes_and_no_nested_loop_for_lexical_parents(spark):
    assert "BroadcastNestedLoopJoin" not in plan(spark, "tfidf_parent") and "SortMergeJoin [parent" not in plan(spark, "tfidf_parent")
    p = plan(spark, "dedup_canonical")
    assert "Window" not in p
