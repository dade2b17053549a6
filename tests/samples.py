"""Small events for tests."""

import json

from dagtrail import schemas as S

_position = iter(range(10**9))


def event(kind, data=(), time=0, app="app", dag="dag", vertex=None, task=None, attempt=None, file="f", pos=None):
    pairs = list(data.items()) if isinstance(data, dict) else list(data)
    pos = next(_position) if pos is None else pos
    return (kind, time, app, dag, vertex, task, attempt, pairs, file, pos)


def submitted(caller, dag="dag", **kw):
    return event(S.DAG_SUBMITTED, {"callerId": caller} if caller is not None else {}, dag=dag, **kw)


def vertex(vertex_id, name="Map 1", scheduler="LLAP", tasks="3", **kw):
    plugin = json.dumps({"taskSchedulerName": scheduler})
    data = {"vertexName": name, "numTasks": tasks, "servicePlugin": plugin}
    return event(S.VERTEX_INITIALIZED, {k: v for k, v in data.items() if v is not None}, vertex=vertex_id, **kw)


def start(attempt, vertex_id="v", node="host:1", container="c", **kw):
    return event(
        S.TASK_ATTEMPT_STARTED, {"nodeId": node, "containerId": container}, vertex=vertex_id, attempt=attempt, **kw
    )


def counter_doc(*groups):
    return json.dumps(
        {
            "counterGroups": [
                {"counters": [{"counterName": n, "counterValue": v} for n, v in group]} for group in groups
            ]
        }
    )


def finish(attempt, vertex_id="v", status="SUCCEEDED", counters=None, data=None, **kw):
    pairs = {"status": status, "counters": counters, "startTime": "10", "endTime": "25", **(data or {})}
    kw.setdefault("task", f"task of {attempt}")
    return event(
        S.TASK_ATTEMPT_FINISHED, {k: v for k, v in pairs.items() if v is not None},
        vertex=vertex_id, attempt=attempt, **kw,
    )


def task(vertex_id="v", taken="5", status="SUCCEEDED", failed="0", task_id="t", **kw):
    pairs = {"timeTaken": taken, "status": status, "numFailedTaskAttempts": failed}
    return event(S.TASK_FINISHED, {k: v for k, v in pairs.items() if v is not None}, vertex=vertex_id, task=task_id, **kw)


def frame(spark, events):
    return spark.createDataFrame(list(events), S.ddl(S.HISTORY_EVENT))
