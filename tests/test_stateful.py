"""The report kept by state, against the batch report after every arrival."""

import random

import pytest

from dagtrail.operators.features import task_features
from dagtrail.streaming.features import stream_history
from dagtrail.streaming.stateful import follow, followed_report
from tests.samples import finish, frame, start, vertex

HOUR = 3_600_000


def _append(df, folder):
    df.drop("srcFile", "srcPos").coalesce(1).write.mode("append").parquet(folder)


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=str)


def _rows_in_state(query):
    return sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"])


ARRIVALS = [
    # a finish before its start, one of another scheduler, one of a vertex not known yet
    [vertex("v1", name="Map 1", time=HOUR), vertex("v2", scheduler="YARN", time=HOUR), finish("a2", "v1", time=HOUR + 6)],
    [finish("a1", "v1", time=HOUR + 5), start("a1", "v1", time=HOUR + 1), finish("", "v1", time=HOUR + 5), finish("a9", "v9")],
    # an earlier and a later start of the vertex, a late start of an attempt, an earlier finish
    [vertex("v1", name="Map 9", time=72 * HOUR), vertex("v1", name="Map 0", time=1), start("a2", "v1", node="late:1", time=HOUR)],
    [finish("a1", "v1", time=HOUR + 4), finish("a3", "v2", time=HOUR + 7), start("a3", "v2", time=HOUR + 1)],
    # both vertices turn out to run in LLAP, and an attempt starts again after its finish
    [vertex("v9", name="Reducer 2", time=2), vertex("v2", name="Map 2", time=HOUR), start("a1", "v1", node="again:1", time=99 * HOUR)],
]


def test_state_equals_batch_after_each_arrival(spark, tmp_path):
    folder, so_far = str(tmp_path / "events"), []
    read = []
    for events in ARRIVALS:
        so_far += events
        _append(frame(spark, events), folder)
        done = follow(stream_history(spark, folder), str(tmp_path / "report"))
        assert _sorted(followed_report(spark, str(tmp_path / "report"))) == _sorted(task_features(frame(spark, so_far)))
        read.append([sum(p["numInputRows"] for p in q.recentProgress) for q in done])
    # each run reads its own events alone, starts and finishes apart, and of the changes only the new ones
    assert [r[0] for r in read] == [len(e) for e in ARRIVALS]
    assert all(r[1] <= 2 * len(e) and r[2] <= 2 * len(e) + 1 for r, e in zip(read, ARRIVALS, strict=True)), read
    # nothing new, nothing read
    again = follow(stream_history(spark, folder), str(tmp_path / "report"))
    assert all(p["numInputRows"] == 0 for q in again for p in q.recentProgress)


@pytest.mark.parametrize("seed", range(3))
def test_any_order_of_arrival(spark, tmp_path, seed):
    events = [e for arrival in ARRIVALS for e in arrival]
    events += [f(f"b{i % 5}", f"v{i % 3}", time=i * 7 % 11) for i in range(20) for f in (start, finish)]
    random.Random(seed).shuffle(events)
    folder = str(tmp_path / "events")
    for part in (events[:20], events[20:35], events[35:]):
        _append(frame(spark, part), folder)
        follow(stream_history(spark, folder), str(tmp_path / "report"))
    landed = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "report/landing"))
    assert _sorted(followed_report(spark, str(tmp_path / "report"))) == _sorted(task_features(landed))


def test_starts_are_let_go_when_their_finish_is_met(spark, tmp_path):
    folder, report = str(tmp_path / "events"), str(tmp_path / "report")
    _append(frame(spark, [vertex("v"), *[start(f"a{i}", time=1) for i in range(30)]]), folder)
    before = _rows_in_state(follow(stream_history(spark, folder), report)[2])
    _append(frame(spark, [finish(f"a{i}", time=2) for i in range(30)]), folder)
    done = follow(stream_history(spark, folder), report)
    last = [o for p in done[2].recentProgress for o in p["stateOperators"]]
    assert before == 30 and sum(o["numRowsRemoved"] for o in last) >= 30
    assert followed_report(spark, report).where("nodeID = 'host:1'").count() == 30


def test_finishes_wait_no_longer_than_the_horizon(spark, tmp_path):
    folder, report = str(tmp_path / "events"), str(tmp_path / "report")
    _append(frame(spark, [finish("a1", "never")]), folder)
    follow(stream_history(spark, folder), report, horizon=1)
    _append(frame(spark, [vertex("v"), finish("a2", "v")]), folder)
    for _ in range(2):
        _append(frame(spark, [vertex("other")]), folder)
        follow(stream_history(spark, folder), report, horizon=1)
    changes = spark.read.option("recursiveFileLookup", True).parquet(f"{report}/changes")
    assert [r.taskAttemptId for r in changes.where("kind = 'dropped'").collect()] == ["a1"]
    assert followed_report(spark, report).count() == 1


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    folder, report = str(tmp_path / "events"), str(tmp_path / "report")
    _append(frame(spark, ARRIVALS[0] + ARRIVALS[1]), folder)
    follow(stream_history(spark, folder), report)
    want = _sorted(followed_report(spark, report))
    # as if the last query had died before it was committed
    (tmp_path / "report/checkpoint-attempts/commits/0").unlink()
    for crc in (tmp_path / "report/checkpoint-attempts/commits").glob(".*.crc"):
        crc.unlink()
    follow(stream_history(spark, folder), report)
    assert _sorted(followed_report(spark, report)) == want


def test_keys_of_one_bucket_are_kept_apart(spark, tmp_path):
    folder, report, so_far = str(tmp_path / "events"), str(tmp_path / "report"), []
    crowd = [start(f"c{i % 40}", f"w{i % 13}", time=i * 7 % 31, node=f"h:{i}") for i in range(80)]
    crowd += [finish(f"c{i % 40}", f"w{i % 13}", time=i * 11 % 31) for i in range(120)]
    crowd += [vertex(f"w{i}", name=f"Map {i}", scheduler="LLAP" if i % 3 else "YARN", time=i) for i in range(13)]
    random.Random(3).shuffle(crowd)
    for events in (crowd[:70], ARRIVALS[0] + ARRIVALS[1], crowd[70:150], crowd[150:] + ARRIVALS[2], ARRIVALS[3] + ARRIVALS[4]):
        so_far += events
        _append(frame(spark, events), folder)
        follow(stream_history(spark, folder), report, buckets=3)
    landed = spark.read.option("recursiveFileLookup", True).parquet(f"{report}/landing")
    assert landed.count() == len(so_far)
    assert _sorted(followed_report(spark, report)) == _sorted(task_features(landed))
