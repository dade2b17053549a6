"""The task report: vertices, placement, use-once starts."""

import random

import pytest

from dagtrail import schemas as S
from dagtrail.operators import lookup as L
from dagtrail.operators.features import lost_counters, task_features
from dagtrail.operators.vertices import attempt_starts, llap_vertices, vertices
from tests.samples import counter_doc, event, finish, frame, start, vertex


def placed(df):
    rows = task_features(df).collect()
    return sorted(((r.eventTime, r.taskID, r.nodeID, r.contID, r.vertexName) for r in rows), key=str)


def test_columns_and_types(spark):
    report = task_features(frame(spark, [vertex("v"), start("a"), finish("a", app="x", dag="y", task="z", time=9)]))
    assert report.schema.simpleString() == S.TASK_REPORT.simpleString()
    (row,) = report.collect()
    assert tuple(row)[:8] == (9, "host:1", "c", "x", "v", "y", "z", "SUCCEEDED")
    assert (row.vertexName, row.vertexNumTasks, row.taskDurationMillis) == ("Map 1", 3, 15)


def test_only_attempts_of_llap_vertices(spark):
    df = frame(
        spark,
        [
            vertex("yes"), vertex("no", scheduler="YARN"),
            finish("a", "yes"), finish("b", "no"), finish("c", "unknown"), finish("d", None),
        ],
    )
    assert [r.taskID for r in task_features(df).collect()] == ["task of a"]


def test_the_latest_llap_start_of_a_vertex_counts(spark):
    df = frame(
        spark,
        [
            vertex("v", name="Map old", time=1),
            vertex("v", name="Map new", time=3, file="a", pos=2),
            vertex("v", name="Map same time, earlier", time=3, file="a", pos=1),
            vertex("v", name="Map not on LLAP", scheduler="YARN", time=9),
            finish("a", time=2),
        ],
    )
    assert llap_vertices(df).collect()[0].vertexName == "Map new"
    assert placed(df) == [(2, "task of a", None, None, "Map new")]


def test_a_vertex_that_starts_after_its_attempts(spark):
    assert len(placed(frame(spark, [finish("a", time=1), vertex("v", time=2)]))) == 1


def test_a_vertex_without_name_or_plugin(spark):
    (row,) = vertices(frame(spark, [vertex("v", name=None, tasks=None)])).collect()
    assert (row.vertexName, row.opType, row.numTasks, row.isLlap) == (None, None, None, True)


def test_a_start_is_used_once(spark):
    df = frame(
        spark,
        [
            vertex("v"),
            finish("a", time=7), finish("a", time=5), finish("a", time=6),
            start("a", node="old:1", time=1), start("a", node="new:1", time=2),
            finish("b", time=5), start("c", time=1),
        ],
    )
    assert placed(df) == [
        (5, "task of a", "new:1", "c", "Map 1"),
        (5, "task of b", None, None, "Map 1"),
        (6, "task of a", None, None, "Map 1"),
        (7, "task of a", None, None, "Map 1"),
    ]
    assert attempt_starts(df).where("taskAttemptId = 'a'").collect()[0].nodeId == "new:1"


def test_a_finish_outside_llap_does_not_use_the_start(spark):
    df = frame(
        spark,
        [vertex("v"), vertex("w", scheduler="YARN"), start("a"), finish("a", "w", time=1), finish("a", "v", time=2)],
    )
    assert placed(df) == [(2, "task of a", "host:1", "c", "Map 1")]


def test_finishes_at_the_same_time_are_told_apart(spark):
    df = frame(spark, [vertex("v"), start("a")] + [finish("a", time=5, file=f, pos=1) for f in "ba"])
    assert [r[2] for r in placed(df)].count("host:1") == 1


def test_attempts_without_id(spark):
    starts = [start(None, node="old:1", time=1), start("", node="new:1", time=2)]
    df = frame(spark, [vertex("v"), *starts, finish(None, time=3), finish("", time=4)])
    assert [r[2] for r in placed(df)] == ["new:1", None]


def test_partial_placement(spark):
    df = frame(
        spark, [vertex("v"), finish("a"), event(S.TASK_ATTEMPT_STARTED, {"nodeId": "n:1"}, vertex="v", attempt="a")]
    )
    assert placed(df)[0][2:4] == ("n:1", None)


def big(seed):
    rnd = random.Random(seed)
    hot = lambda i: "v0" if rnd.random() < 0.4 else f"v{i}"
    events = [vertex(f"v{i}", name=f"Map {i}", scheduler=rnd.choice(["LLAP", "LLAP", "YARN"]), time=i) for i in range(9)]
    events += [start(f"a{rnd.randrange(60)}", node=f"h{i}:1", time=rnd.randrange(50)) for i in range(100)]
    events += [finish(f"a{rnd.randrange(60)}", hot(rnd.randrange(9)), time=rnd.randrange(50)) for _ in range(200)]
    return events


def expected_report(events):
    """The same report by brute force over sorted events."""
    order = sorted(events, key=lambda e: (e[1], e[8], e[9]))
    names, starts, used, rows = {}, {}, set(), []
    for e in order:
        data = dict(e[7])
        if e[0] == S.VERTEX_INITIALIZED and "LLAP" in data["servicePlugin"]:
            names[e[5 - 1]] = data["vertexName"]
        elif e[0] == S.TASK_ATTEMPT_STARTED:
            starts[e[6]] = (data["nodeId"], data["containerId"])
    for e in order:
        if e[0] == S.TASK_ATTEMPT_FINISHED and e[4] in names:
            place = starts.get(e[6]) if e[6] not in used else None
            used.add(e[6])
            rows.append((e[1], e[5], *(place or (None, None)), names[e[4]]))
    return sorted(rows, key=str)


@pytest.mark.parametrize("sliced", [False, True])
def test_order_and_partitions_do_not_matter(spark, sliced):
    events = big(7)
    expected = expected_report(events)
    settings = {L.SLICE_ROWS_SETTING: "5"} if sliced else {}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for seed in range(2):
            mixed = random.Random(seed).sample(events, len(events))
            assert placed(frame(spark, mixed).repartition(3 + seed)) == expected
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_lost_counters(spark):
    docs = [counter_doc([("CREATED_FILES", v), ("ROWS_EMITTED", 5), ("OTHER", 1.5)]) for v in (1, 1.5, 10**25, None)]
    events = [finish(f"a{i}", counters=d) for i, d in enumerate(docs)]
    assert [tuple(r) for r in lost_counters(frame(spark, events)).collect()] == [("CREATED_FILES", 2)]
