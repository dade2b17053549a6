"""Payload lookups, counters and scalar expressions."""

import json

import pytest
from pyspark.sql import functions as F

from dagtrail import schemas as S
from dagtrail.functions import payload as P
from dagtrail.operators.features import attempt_finishes
from tests.samples import counter_doc, event, finish, frame, vertex


def one(df, column):
    (row,) = df.select(column.alias("x")).collect()
    return row.x


def text(spark, value):
    return spark.createDataFrame([(value,)], "t string")


def test_first_pair_with_the_key_wins(spark):
    df = frame(spark, [event("X", [("a", "1"), ("b", None), ("a", "2")])])
    assert one(df, P.kv("a")) == "1"
    assert one(df, P.kv("b")) is None
    assert one(df, P.kv("absent")) is None
    assert one(df, P.kv_or_blank("absent")) == ""


@pytest.mark.parametrize("key", ["it's", 'a"b', "a\\b", "a b", ""])
def test_any_key(spark, key):
    assert one(frame(spark, [event("X", [("other", "1"), (key, "2")])]), P.kv(key)) == "2"


def test_lookup_in_missing_payload(spark):
    df = frame(spark, [event("X")]).withColumn("eventData", F.lit(None).cast(S.HISTORY_EVENT["eventData"]))
    assert one(df, P.kv("a")) is None


@pytest.mark.parametrize(
    "plugin, expected",
    [
        ('{"taskSchedulerName":"LLAP"}', True),
        ('{"taskSchedulerName":"YARN"}', False),
        ('{"taskSchedulerName":"llap"}', False),
        ("{}", False),
        ("{", False),
        ("[1]", False),
        ("", False),
        (None, False),
    ],
)
def test_is_llap(spark, plugin, expected):
    data = {} if plugin is None else {"servicePlugin": plugin}
    assert one(frame(spark, [event("X", data)]), P.is_llap()) is expected


@pytest.mark.parametrize(
    "name, op, task",
    [("Map 1", "Map", "Map"), ("Map", "Map", "Map"), (" Map 1", " Map 1", ""), ("", "", ""), (None, None, None)],
)
def test_types_of_a_vertex_name(spark, name, op, task):
    df = text(spark, name)
    assert one(df, P.op_type(F.col("t"))) == op
    assert one(df, P.task_type(F.col("t"))) == task


@pytest.mark.parametrize("node, host", [("h:1", "h"), ("h", "h"), ("h:1:2", "h"), (":1", ""), (None, None)])
def test_host_name(spark, node, host):
    assert one(text(spark, node), P.host_name(F.col("t"))) == host


@pytest.mark.parametrize(
    "value, number",
    [("12", 12), ("-3", -3), ("+3", 3), (" 12", None), ("1.5", None), ("", None), ("9" * 30, None), (None, None)],
)
def test_whole_number(spark, value, number):
    assert one(text(spark, value), P.whole_number(F.col("t"))) == number


def features(spark, **kw):
    (row,) = P.with_counters(attempt_finishes(frame(spark, [finish("a", **kw)]))).collect()
    return row


def test_all_counters_reach_their_columns(spark):
    names = [*S.REPORT_COUNTERS.values(), S.DURATION_COUNTER]
    row = features(spark, counters=counter_doc([(n, i) for i, n in enumerate(names)]))
    for i, column in enumerate([*S.REPORT_COUNTERS, S.DURATION_COLUMN]):
        assert row[column] == i


def test_first_counter_over_all_groups_wins_even_with_null(spark):
    doc = counter_doc(
        [("HDFS_BYTES_READ", None), ("HDFS_READ_OPS", 1)], [("HDFS_BYTES_READ", 5), ("HDFS_READ_OPS", 2)]
    )
    row = features(spark, counters=doc)
    assert (row.hdfsBytesRead, row.hdfsReadOps, row.hdfsWriteOps) == (None, 1, None)


@pytest.mark.parametrize(
    "value, number", [("x", None), ("12", 12), (1.5, None), (True, None), ([1], None), (-7, -7), (10**25, None)]
)
def test_a_counter_that_is_no_whole_number_loses_only_itself(spark, value, number):
    row = features(spark, counters=counter_doc([("HDFS_BYTES_READ", value), ("HDFS_READ_OPS", 1)]))
    assert (row.hdfsBytesRead, row.hdfsReadOps) == (number, 1)


@pytest.mark.parametrize(
    "odd_group",
    [5, "text", None, [], {}, {"counters": 5}, {"counters": {"counterName": "HDFS_BYTES_READ"}}, {"counters": [7, None]}],
)
def test_an_odd_group_loses_only_itself(spark, odd_group):
    good = {"counters": ["odd", {"counterName": "HDFS_BYTES_READ", "counterValue": 3}]}
    row = features(spark, counters=json.dumps({"counterGroups": [odd_group, good]}))
    assert row.hdfsBytesRead == 3


@pytest.mark.parametrize("doc", [None, "", "{", "[1]", "{}", '{"counterGroups":5}', '{"counterGroups":[]}'])
def test_without_counters_the_duration_is_still_known(spark, doc):
    row = features(spark, counters=doc)
    assert row.taskDurationMillis == 15
    assert all(row[c] is None for c in S.REPORT_COUNTERS)


@pytest.mark.parametrize(
    "data, expected",
    [
        ({}, 15),
        ({"startTime": None}, None),
        ({"endTime": "x"}, None),
        ({"endTime": " 25"}, None),
        ({"startTime": "-9223372036854775808", "endTime": "1"}, None),
    ],
)
def test_duration_from_start_and_end(spark, data, expected):
    assert features(spark, data=data).taskDurationMillis == expected


def test_the_duration_counter_comes_first(spark):
    assert features(spark, counters=counter_doc([(S.DURATION_COUNTER, 7)])).taskDurationMillis == 7


def test_counters_are_parsed_once(spark):
    plan = P.with_counters(attempt_finishes(frame(spark, [finish("a")])))
    optimized = plan._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("from_json(StructField(counterGroups,ArrayType(StructType") == 1


def test_vertex_sample_is_llap(spark):
    assert one(frame(spark, [vertex("v")]), P.is_llap()) is True
