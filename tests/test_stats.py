"""Questions on the task report, with the values the report database would give."""

from decimal import Decimal as D

import pytest

from dagtrail import schemas as S
from dagtrail.operators import stats


def report(spark, *rows):
    """Rows of (node, vertex name, duration, status) with the other columns empty."""
    filled = []
    for i, (node, name, duration, status) in enumerate(rows):
        values = {"eventTime": i, "nodeID": node, "taskID": f"t{i}", "status": status, "vertexName": name}
        values[S.DURATION_COLUMN] = duration
        filled.append(tuple(values.get(c) for c in S.REPORT_COLUMNS))
    return spark.createDataFrame(filled, S.TASK_REPORT)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def succeeded(spark, *triples):
    return stats.succ_task_events(report(spark, *[(*t, "SUCCEEDED") for t in triples]))


def test_status_distribution(spark):
    df = report(spark, *[(None, "Map 1", 1, s) for s in ("SUCCEEDED", "KILLED", "KILLED", None)])
    assert rows(stats.status_distribution(df)) == [("KILLED", 2), ("SUCCEEDED", 1), (None, 1)]


def test_node_restarts(spark):
    ok = "SUCCEEDED"
    df = report(
        spark,
        ("b:1", "M", 1, ok), ("b:2", "M", 1, ok), ("b:2", "M", 1, ok), ("a:1", "M", 1, ok),
        ("a:2", "M", 1, "FAILED"), (None, "M", 1, ok),
    )
    assert [tuple(r) for r in stats.node_restarts(df).collect()] == [("a", 0), ("b", 1), (None, -1)]


def test_succeeded_attempts(spark):
    df = stats.succ_task_events(report(spark, ("h:1", "Map 1", 5, "SUCCEEDED"), ("h:1", "Map 1", 5, "FAILED")))
    assert df.columns == ["eventTime", "hostname", "taskType", "contID", "taskID", *S.MEASURES, "vertexName", "vertexNumTasks"]
    (row,) = df.collect()
    assert (row.hostname, row.taskType, row.taskDurationMillis) == ("h", "Map", 5)


def test_durations_are_rounded_half_up(spark):
    df = succeeded(spark, ("h:1", "Map 1", 1), ("h:1", "Map 1", 2), ("h:1", "Map 1", None), ("h:1", "Red", None))
    assert rows(stats.duration_by_type(df)) == [("Map", 3, D(2), D(1)), ("Red", 1, None, None)]
    assert rows(stats.averages_by_node(df)) == [("h", "Map", 3, D(2), D(1)), ("h", "Red", 1, None, None)]


def test_ranking_of_nodes(spark):
    df = succeeded(spark, ("a:1", "Map", 1), ("b:1", "Map", 1), ("b:1", "Map", 1), ("c:1", "Red", 1))
    ranked = stats.node_averages_ranked(stats.averages_by_node(df)).collect()
    assert [(r.hostName, r.taskType, r.numTasksByType) for r in ranked] == [("b", "Map", 2), ("a", "Map", 1), ("c", "Red", 1)]


def test_node_distance_uses_rounded_unweighted_averages(spark):
    df = succeeded(spark, ("a:1", "Map", 10), ("b:1", "Map", 20), ("c:1", "Map", 40), ("c:1", "Map", 41), ("c:1", "Map", 40))
    # node averages 10, 20, 40; their mean is 23.33
    assert rows(stats.node_distance(stats.averages_by_node(df))) == [("Map", D(23), D(12), D(17), D("71.4"))]


def test_node_distance_of_nothing_known(spark):
    df = succeeded(spark, ("a:1", "Map", None))
    assert rows(stats.node_distance(stats.averages_by_node(df))) == [("Map", None, None, None, None)]


def test_a_mean_of_zero_fails(spark):
    df = succeeded(spark, ("a:1", "Map", 0))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        stats.node_distance(stats.averages_by_node(df)).collect()


def test_cluster_skew(spark):
    df = succeeded(
        spark, ("a:1", "Map 1", 100), ("a:2", "Map 2", 100), ("b:1", "Map 1", 25), ("b:1", "Reducer 1", 999),
        ("c:1", "Map 1", None), ("d:1", "Map 1", 67),
    )
    assert rows(stats.cluster_skew(df)) == [
        ("a", 200, D("100.0"), 2), ("b", 25, D("12.5"), 1), ("c", None, None, 1), ("d", 67, D("33.5"), 1),
    ]


def test_top_tasks(spark):
    df = succeeded(spark, *[("a:1", "Map", d) for d in (5, None, 9, 7)])
    top = stats.top_tasks(df, 3)
    assert [r.taskDurationNano for r in top.collect()] == [None, 9_000_000, 7_000_000]
    assert len(top.columns) == 14 and "total I/O Nano" in top.columns
    assert stats.top_tasks(df).count() == 4
