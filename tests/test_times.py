"""Task times per application and type, and the list behind them."""

import random
import statistics

import pytest

from dagtrail.operators import lookup as L
from dagtrail.operators.times import task_times, time_detail
from dagtrail.operators.vertices import task_finishes
from tests.samples import event, frame, submitted, task, vertex


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def base(*more):
    return [submitted("c"), vertex("v"), *more]


def test_count_extremes_mean_and_deviation(spark):
    df = frame(spark, base(*[task(taken=str(t)) for t in (1, 2, 3, 10)]))
    assert rows(task_times(df)) == [("app", "Map", 4, 1, 10, 4, 3)]


@pytest.mark.parametrize("times", [(0, 0, 2, 2), (3, 3, 3), (10, 20), (7,), (1, 1, 1, 5, 5, 5), (0, 0, 0, 4, 4, 4)])
def test_exact_whole_deviations_are_not_cut_below(spark, times):
    df = frame(spark, base(*[task(taken=str(t)) for t in times])).repartition(3)
    expected = int(round(statistics.pstdev(times), 9))
    assert rows(task_times(df))[0][6] == expected


def test_large_times(spark):
    times = [9_000_000_000_000_000, 9_000_000_000_000_002]
    df = frame(spark, base(*[task(taken=str(t)) for t in times]))
    assert rows(task_times(df)) == [("app", "Map", 2, times[0], times[1], times[0] + 1, 1)]


def test_who_counts(spark):
    df = frame(
        spark,
        base(
            task(taken="1"),
            task(taken="2", status="FAILED"),
            task(taken="3", status="succeeded"),
            task(taken="4", status=None),
            task("unknown", taken="5"),
            task(taken="6", dag="no caller"),
            vertex("yarn", scheduler="YARN"), task("yarn", taken="7"),
            vertex("late", name="Reducer 1", time=99), task("late", taken="8", time=1),
            vertex("uncalled", dag="no caller"), task("uncalled", taken="9"),
            task(taken="10", app=" "),
            task(taken="11", app=None),
        ),
    )
    assert rows(task_times(df)) == [("app", "Map", 1, 1, 1, 1, 0), ("app", "Reducer", 1, 8, 8, 8, 0)]
    assert rows(time_detail(df)) == [("app", "late", "Reducer", "t", 8, 0), ("app", "v", "Map", "t", 1, 0)]


def test_tasks_stay_when_their_vertex_starts_again(spark):
    df = frame(spark, base(task(taken="1", time=1), vertex("v", name="Reducer 2", time=2), task(taken="3", time=3)))
    assert rows(task_times(df)) == [("app", "Reducer", 2, 1, 3, 2, 1)]


def test_vertex_names(spark):
    named = [vertex(v, name=n) for v, n in (("a", "Map"), ("b", " x y"), ("c", None))]
    df = frame(spark, [submitted("c"), *named, *[task(v) for v in "abc"]])
    assert [r[1] for r in rows(task_times(df))] == [" x y", "Map", None]


def test_absent_numbers_are_zero(spark):
    df = frame(spark, base(task(taken=None, failed=None), task(taken="4", failed="2")))
    assert sorted((r.timeTaken, r.failedAttempts) for r in task_finishes(df).collect()) == [(0, 0), (4, 2)]
    assert rows(task_times(df)) == [("app", "Map", 2, 0, 4, 2, 2)]


def test_bad_numbers_fail(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        task_times(frame(spark, base(task(taken="soon")))).collect()


def test_an_application_mismatch_fails(spark):
    df = frame(spark, base(task(taken="1", app="other")))
    for report in (task_times, time_detail):
        with pytest.raises(Exception, match="differs from that of vertex v"):
            report(df).collect()


def test_events_of_other_types_do_not_matter(spark):
    df = frame(spark, base(task(taken="1"), event("OTHER", {"timeTaken": "x"}, vertex="v")))
    assert len(rows(task_times(df))) == 1


@pytest.mark.parametrize("sliced", [False, True])
def test_against_brute_force(spark, sliced):
    rnd = random.Random(3)
    events = [submitted("c", dag=f"d{d}") for d in range(3)]
    events += [vertex(f"v{i}", name=rnd.choice(["Map 1", "Reducer 2"]), dag=f"d{i % 4}", app=f"a{i % 2}") for i in range(12)]
    types = {e[4]: dict(e[7])["vertexName"].split()[0] for e in events[3:] if e[3] != "d3"}
    groups = {}
    for n in range(400):
        i = 0 if rnd.random() < 0.4 else rnd.randrange(12)
        taken, dag = rnd.randrange(1000), f"d{rnd.randrange(4)}"
        events.append(task(f"v{i}", taken=str(taken), dag=dag, app=f"a{i % 2}", task_id=f"t{n}"))
        if dag != "d3" and f"v{i}" in types:
            groups.setdefault((f"a{i % 2}", types[f"v{i}"]), []).append(taken)
    expected = [
        (*k, len(t), min(t), max(t), sum(t) // len(t), int(statistics.pstdev(t))) for k, t in sorted(groups.items())
    ]
    settings = {L.SLICE_ROWS_SETTING: "7"} if sliced else {}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = frame(spark, rnd.sample(events, len(events))).repartition(5)
        assert rows(task_times(df)) == expected
        assert time_detail(df).count() == sum(map(len, groups.values()))
    finally:
        for k in settings:
            spark.conf.unset(k)
