"""Entity logs: cutting lines into objects and reading them as events."""

import json

import pytest
from pyspark.sql import functions as F

from dagtrail import schemas as S
from dagtrail.functions.entity import entities
from dagtrail.operators.features import task_features
from dagtrail.sources.entitylog import entity_summary, read_ats, read_entity_lines, to_events
from tests.samples import finish, frame, start, vertex


def names(spark, line):
    df = spark.createDataFrame([(line,)], "line string")
    rows = df.select(F.explode(entities(F.col("line"))).alias("e")).select("e.entity").collect()
    return [r.entity for r in rows]


A, B, C = ('{"entity":"%s","otherinfo":{"x":[{"y":{}}]}}' % n for n in "abc")


@pytest.mark.parametrize(
    "line, expected",
    [
        (A, ["a"]),
        (A + B, ["a", "b"]),
        (f"{A}  {B}\t{C}", ["a", "b", "c"]),
        (f"{A},{B}", ["a", "b"]),
        (f"[{A},{B}]", ["a", "b"]),
        (f"text {A} more", ["a"]),
        (f"{A} text {B} text {C}", ["a", "b", "c"]),
        (A + "{bad}" + B, ["a", "b"]),
        (f"{A},{{bad}},{B}", ["a", "b"]),
        (f"{A} text {{bad}} text {B}", ["a", "b"]),
        (A + '{"entity":', ["a"]),
        (f"{A}}} {B}", ["a", "b"]),
        ('{"entity":"}{"}' + B, ["b"]),  # braces are counted even inside texts
        ('{"entity":"}"}' + B, ["}", "b"]),
        ('{"entity":"x\\"}{"}', ['x"}{']),
        ('{"entity":" a"}' + B, [" a", "b"]),
        ("{}", [None]),
        ("", []),
        ("no object", []),
        (None, []),
    ],
)
def test_objects_of_a_line(spark, line, expected):
    assert names(spark, line) == expected


def test_a_line_with_many_objects(spark):
    line = " x ".join('{"entity":"%d"}' % i for i in range(500))
    assert names(spark, line) == [str(i) for i in range(500)]


def entity(**changes):
    base = {
        "entity": "attempt_1",
        "entitytype": "TEZ_TASK_ATTEMPT_ID",
        "events": [{"eventtype": "TASK_ATTEMPT_FINISHED", "timestamp": 17}],
        "primaryfilters": {
            "applicationId": ["app_1"], "TEZ_DAG_ID": ["dag_1"], "TEZ_VERTEX_ID": ["vertex_1"],
            "TEZ_TASK_ID": ["task_1"],
        },
        "otherinfo": {"status": "SUCCEEDED", "endTime": 5, "nested": {"a": [1, 2]}, "none": None, "flag": True},
    }
    base.update(changes)
    return {k: v for k, v in base.items() if v != "absent"}


def read(spark, *objects):
    df = spark.createDataFrame([(json.dumps(o), "f") for o in objects], "line string, srcFile string")
    return to_events(df).collect()


def test_an_entity_becomes_an_event(spark):
    (row,) = read(spark, entity())
    assert row.asDict(recursive=True) == {
        "eventType": "TASK_ATTEMPT_FINISHED", "eventTime": 17, "appId": "app_1", "dagId": "dag_1",
        "vertexId": "vertex_1", "taskId": "task_1", "taskAttemptId": "attempt_1",
        "eventData": [
            {"key": "status", "value": "SUCCEEDED"}, {"key": "endTime", "value": "5"},
            {"key": "nested", "value": '{"a":[1,2]}'}, {"key": "none", "value": None},
            {"key": "flag", "value": "true"},
        ],
        "srcFile": "f", "srcPos": row.srcPos,
    }


def test_a_vertex_entity_names_the_vertex(spark):
    (row,) = read(spark, entity(entity="vertex_9", entitytype="TEZ_VERTEX_ID"))
    assert (row.vertexId, row.taskAttemptId) == ("vertex_9", None)
    (row,) = read(spark, entity(entity="x", entitytype="TEZ_DAG_ID"))
    assert (row.vertexId, row.taskAttemptId) == ("vertex_1", None)


@pytest.mark.parametrize(
    "events",
    [
        "absent",
        [],
        {"eventtype": "TASK_ATTEMPT_FINISHED"},
        [{"eventtype": "TASK_ATTEMPT_FINISHED"}, {"eventtype": "TASK_ATTEMPT_FINISHED"}],
        [{"timestamp": 5}],
        ["TASK_ATTEMPT_FINISHED"],
        [{"eventtype": "TASK_FINISHED", "timestamp": 5}],
    ],
)
def test_entities_that_are_no_wanted_event(spark, events):
    assert read(spark, entity(events=events, otherinfo={"t": "TASK_ATTEMPT_FINISHED"})) == []


@pytest.mark.parametrize("stamp", ["5", 5.5, None, [5]])
def test_a_time_that_is_no_whole_number_is_zero(spark, stamp):
    (row,) = read(spark, entity(events=[{"eventtype": "TASK_ATTEMPT_STARTED", "timestamp": stamp}]))
    assert row.eventTime == 0


@pytest.mark.parametrize("value", ["vertex_1", [], ["a", "b"], {"a": 1}, None, [None]])
def test_a_filter_needs_exactly_one_entry(spark, value):
    filters = {"applicationId": ["app_1"], "TEZ_VERTEX_ID": value}
    (row,) = read(spark, entity(primaryfilters=filters))
    assert (row.appId, row.vertexId) == ("app_1", None)


@pytest.mark.parametrize("part", ["primaryfilters", "otherinfo"])
@pytest.mark.parametrize("value", ["absent", [1], "text", None])
def test_absent_or_odd_parts(spark, part, value):
    (row,) = read(spark, entity(**{part: value}))
    if part == "otherinfo":
        assert row.eventData == []
    else:
        assert (row.appId, row.taskAttemptId) == (None, "attempt_1")


def test_escaped_type_names_are_found(spark):
    line = json.dumps(entity()).replace("TASK_ATTEMPT_FINISHED", "\\u0054ASK_ATTEMPT_FINISHED")
    df = spark.createDataFrame([(line, "f")], "line string, srcFile string")
    assert to_events(df).count() == 1


def as_entity(e):
    kind, time, app, dag, vertex_id, task_id, attempt, pairs, _, _ = e
    info = {k: json.loads(v) if v and v.startswith("{") else v for k, v in pairs}
    is_vertex = kind == S.VERTEX_INITIALIZED
    filters = {"applicationId": app, "TEZ_DAG_ID": dag, "TEZ_TASK_ID": task_id}
    if not is_vertex:
        filters["TEZ_VERTEX_ID"] = vertex_id
    return {
        "entity": vertex_id if is_vertex else attempt,
        "entitytype": "TEZ_VERTEX_ID" if is_vertex else "TEZ_TASK_ATTEMPT_ID",
        "events": [{"eventtype": kind, "timestamp": time}],
        "primaryfilters": {k: [v] for k, v in filters.items() if v is not None},
        "otherinfo": info,
    }


def test_files_give_the_same_report_as_tables(spark, tmp_path):
    events = [
        vertex("v1", time=1), vertex("v2", scheduler="YARN", time=1), vertex("v1", name="Map 2", time=2),
        start("a1", "v1", time=3), start("a2", "v2", time=3),
        finish("a1", "v1", time=4, counters='{"counterGroups":[{"counters":[{"counterName":"ROWS_EMITTED","counterValue":7}]}]}'),
        finish("a1", "v1", time=5), finish("a2", "v2", time=5),
    ]
    deep = tmp_path / "logs" / "app" / "part"
    deep.mkdir(parents=True)
    texts = [json.dumps(as_entity(e)) for e in events]
    (deep / "entitylog-one").write_text(texts[0] + texts[1] + "\n\n{bad}" + texts[2] + "\n" + "\n".join(texts[3:5]))
    (tmp_path / "logs" / "entitylog-two").write_text(" ".join(texts[5:]))
    (deep / "summarylog-one").write_text("\n".join(texts))
    logs = read_ats(spark, str(tmp_path / "logs"))
    expected = sorted(map(tuple, task_features(frame(spark, events)).collect()), key=str)
    assert sorted(map(tuple, task_features(logs).collect()), key=str) == expected
    assert len({(r.srcFile, r.srcPos) for r in logs.collect()}) == len(events)
    (summary,) = entity_summary(read_entity_lines(spark, str(tmp_path / "logs"))).collect()
    assert summary.asDict() == {"totalEvents": 8, "passedEvents": 8, "rejectedEvents": 0, "foundFiles": 2}


def test_positions_rise_along_a_file_that_is_split(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    lines = [json.dumps(entity(entity=f"a{i:05d}")) for i in range(3000)]
    (folder / "entitylog-1").write_text("\n".join(lines))
    (folder / "entitylog-2").write_text("\n".join(lines[:700]))
    settings = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        events = read_ats(spark, str(folder))
        assert events.rdd.getNumPartitions() > 5
        rows = events.orderBy("srcFile", "srcPos").select("srcFile", "taskAttemptId").collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    for file in {r.srcFile for r in rows}:
        attempts = [r.taskAttemptId for r in rows if r.srcFile == file]
        assert attempts == sorted(attempts)
