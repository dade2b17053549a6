"""The streaming report against the batch report."""

import json

import pytest

from dagtrail.operators.features import task_features
from dagtrail.streaming.features import landed_events, stream_ats, stream_history, stream_task_features
from tests.samples import finish, frame, start, vertex

HOUR = 3_600_000


def _append(df, folder):
    df.drop("srcFile", "srcPos").coalesce(1).write.mode("append").parquet(folder)


def _run(spark, events, base):
    return stream_task_features(events, str(base / "landing"), str(base / "checkpoint"))


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stream_equals_batch_after_each_arrival(spark, tmp_path):
    folder = str(tmp_path / "events")
    arrivals = [
        [vertex("v1", name="Map 1", time=HOUR), vertex("v2", scheduler="YARN", time=HOUR), finish("a2", "v1", time=HOUR + 6)],
        [finish("a1", "v1", time=HOUR + 5), start("a1", "v1", time=HOUR + 1), finish("", "v1", time=HOUR + 5)],
        # an earlier and a later start of the vertex, three days after its first finish, and its finish
        [vertex("v1", name="Map 9", time=72 * HOUR), vertex("v1", name="Map 0", time=1), finish("a1", "v1", time=80 * HOUR)],
        [finish("a3", "v2", time=HOUR + 7), start("a3", "v2", time=HOUR + 1), finish("a1", "v1", time=HOUR + 4)],
    ]
    so_far = []
    for events in arrivals:
        so_far += events
        _append(frame(spark, events), folder)
        report = _run(spark, stream_history(spark, folder), tmp_path)
        assert _sorted(report) == _sorted(task_features(frame(spark, so_far)))
    assert {r.vertexName for r in report.collect()} == {"Map 9"}
    assert report.count() == 5 and report.where("nodeID is not null").count() == 1


def test_a_batch_run_again_replaces_what_it_wrote(spark, tmp_path):
    folder = str(tmp_path / "events")
    _append(frame(spark, [vertex("v1"), finish("a1", "v1")]), folder)
    for run in ("one", "two"):
        stream_task_features(stream_history(spark, folder), str(tmp_path / "landing"), str(tmp_path / run))
    assert landed_events(spark, str(tmp_path / "landing")).count() == 2


def test_stream_of_json_keeps_rejected_records(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    good = [r.asDict(True) for r in frame(spark, [vertex("v1"), finish("a1", "v1")]).drop("srcFile", "srcPos").collect()]
    lines = [json.dumps(good[0]), '{"eventType":"TASK_ATTEMPT_FINISHED","eventData":"odd"}', json.dumps(good[1]), '{"eve']
    (folder / "a.json").write_text("\n".join(lines))
    assert _run(spark, stream_history(spark, str(folder), "json"), tmp_path).count() == 1
    rejected = spark.read.parquet(str(tmp_path / "landing-rejected/batch-0"))
    assert sorted(rejected.toPandas()["rejectedRecord"]) == sorted([lines[1], lines[3]])


def test_stream_of_entity_logs(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    lines = [
        '{"entity":"v1","entitytype":"TEZ_VERTEX_ID","events":[{"eventtype":"VERTEX_INITIALIZED","timestamp":5}],'
        '"primaryfilters":{"applicationId":["app"]},'
        '"otherinfo":{"vertexName":"Map 1","numTasks":3,"servicePlugin":{"taskSchedulerName":"LLAP"}}}',
        '{"entity":"a1","entitytype":"TEZ_TASK_ATTEMPT_ID","events":[{"eventtype":"TASK_ATTEMPT_STARTED","timestamp":6}],'
        '"primaryfilters":{"TEZ_VERTEX_ID":["v1"]},"otherinfo":{"nodeId":"h:1","containerId":"c"}}'
        '{"entity":"a1","entitytype":"TEZ_TASK_ATTEMPT_ID","events":[{"eventtype":"TASK_ATTEMPT_FINISHED","timestamp":9}],'
        '"primaryfilters":{"TEZ_VERTEX_ID":["v1"]},"otherinfo":{"status":"SUCCEEDED","startTime":6,"endTime":9}}',
    ]
    (folder / "entitylog-1").write_text("\n".join(lines))
    (folder / "summary-1").write_text("\n".join(lines))
    (row,) = _run(spark, stream_ats(spark, str(folder)), tmp_path).collect()
    assert (row.nodeID, row.contID, row.status, row.taskDurationMillis) == ("h:1", "c", "SUCCEEDED", 3)
    assert (row.vertexName, row.vertexNumTasks) == ("Map 1", 3)


def test_stream_needs_a_directory(spark, tmp_path):
    with pytest.raises(ValueError, match="not a directory"):
        stream_history(spark, str(tmp_path / "absent"))
