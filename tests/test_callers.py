"""Event filters, callers, applications, manifest, ingest counts."""

import pytest
from pyspark.sql import functions as F

from dagtrail import schemas as S
from dagtrail.operators import callers as C
from tests.samples import event, frame, submitted, task, vertex


def values(df, column):
    return sorted(r[column] for r in df.collect())


def test_filter_event_types(spark):
    df = frame(spark, [event("A"), event("B"), event("C"), event("A")])
    assert values(C.filter_event_types(df, ["A", "C"]), "eventType") == ["A", "A", "C"]
    assert C.filter_event_types(df, None).count() == 4
    assert C.filter_event_types(df, []).count() == 0


@pytest.mark.parametrize("bad", [None, "", "  "])
def test_filter_refuses_blank_types(spark, bad):
    with pytest.raises(ValueError, match="blank"):
        C.filter_event_types(frame(spark, [event("A")]), ["A", bad])


def test_the_first_caller_of_a_dag_counts(spark):
    df = frame(
        spark,
        [
            submitted("late", time=5, dag="d1"),
            submitted(None, time=1, dag="d1"),
            submitted("by file", time=2, dag="d1", file="a", pos=9),
            submitted("same time, later file", time=2, dag="d1", file="b", pos=1),
            submitted("same file, later", time=2, dag="d1", file="a", pos=10),
            submitted(None, dag="d2"),
            event("OTHER", {"callerId": "not a submission"}, dag="d3"),
        ],
    )
    assert [tuple(r) for r in C.dag_callers(df).collect()] == [("d1", "by file")]


def sample(spark):
    return frame(
        spark,
        [
            vertex("v", time=0, dag="d1", app="a1"),  # before its submission: still tagged
            submitted("c1", time=1, dag="d1", app="a1"),
            task("v", time=2, dag="d1", app="a1"),
            task("v", time=2, dag="d1", app=" "),
            submitted("c2", time=1, dag="d2", app="a2"),
            task("v", time=3, dag="d3", app="a3"),
            task("v", time=3, dag=None, app="a3"),
        ],
    )


def test_events_without_a_known_caller_are_dropped(spark):
    tagged = C.with_caller(sample(spark))
    assert values(tagged, "callerId") == ["c1", "c1", "c1", "c1", "c2"]
    assert values(C.with_caller(sample(spark), [S.TASK_FINISHED]), "callerId") == ["c1", "c1"]
    assert values(C.delivered(sample(spark)), "appId") == ["a1", "a1", "a1", "a2"]


def test_groups(spark):
    df = sample(spark)
    assert values(C.caller_ids(df), "callerId") == ["c1", "c2"]
    assert values(C.caller_ids(df, [S.TASK_FINISHED]), "callerId") == ["c1"]
    assert values(C.app_ids(df), "appId") == ["a1", "a2"]
    assert values(C.app_ids(df, [S.TASK_FINISHED]), "appId") == ["a1"]
    assert C.events_for_caller(df, "c1").count() == 4
    assert C.events_for_caller(df, "c1", [S.TASK_FINISHED]).count() == 2
    assert C.events_for_caller(df, "nobody").count() == 0
    assert C.events_for_app(df, "a1").count() == 3
    assert C.events_for_app(df, "a3").count() == 0
    assert C.events_for_app(df, " ").count() == 0


def test_manifest(spark):
    manifest = spark.createDataFrame([("c1",), ("c1",), ("c9",)], "appId string")
    assert values(C.manifest_app_ids(manifest), "appId") == ["c1", "c9"]
    assert C.manifest_for_app(manifest, "c1").count() == 2
    found = C.events_for_manifest(sample(spark), manifest)
    assert values(found, "callerId") == ["c1"] * 4
    assert C.events_for_manifest(sample(spark), manifest, [S.VERTEX_INITIALIZED]).count() == 1


def test_ingest_summary(spark):
    df = sample(spark).withColumn("srcFile", F.when(F.col("dagId") == "d3", "g").otherwise(F.col("srcFile")))
    (row,) = C.ingest_summary(df, S.TIME_TYPES).collect()
    assert row.asDict() == {
        "totalEvents": 7, "eventsWithoutCaller": 2, "rejectedEvents": 2, "passedEvents": 3,
        "survivingEvents": 5, "survivingPercent": 71, "foundFiles": 2,
    }
    (row,) = C.ingest_summary(df).collect()
    assert (row.rejectedEvents, row.passedEvents) == (0, 5)


def test_ingest_summary_of_nothing(spark):
    (row,) = C.ingest_summary(sample(spark).limit(0), S.TIME_TYPES).collect()
    assert (row.totalEvents, row.survivingPercent, row.foundFiles) == (0, None, 0)


@pytest.mark.parametrize("limit, expected", [(2, 2), (0, 7), (-1, 7), (None, 7), (100, 7)])
def test_limit(spark, limit, expected):
    assert C.limited_events(sample(spark), limit).count() == expected


def test_limit_after_an_order(spark):
    rows = C.limited_events(sample(spark), 2, ["eventTime", "dagId"]).collect()
    assert [(r.eventTime, r.dagId) for r in rows] == [(0, "d1"), (1, "d1")]
