"""Sources, reports and jobs on files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from dagtrail import schemas as S
from dagtrail.operators import stats
from dagtrail.operators.callers import filter_event_types, limited_events
from dagtrail.operators.features import task_features
from dagtrail.operators.times import task_times, time_detail
from dagtrail.plans import queries
from dagtrail.plans.jobs import main, run_job
from dagtrail.plans.processors import Processor, find, processors, register, registered
from dagtrail.sources import history as history_module
from dagtrail.sources import report as R
from dagtrail.sources import tables
from dagtrail.sources.entitylog import ats_summary
from dagtrail.sources.events import read_events
from dagtrail.sources.history import file_status, read_history, read_json_history, read_manifest, read_until, write_history
from tests.samples import counter_doc, event, finish, frame, start, submitted, task, vertex
from tests.test_entitylog import as_entity


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def sample():
    return [
        submitted("c"), vertex("v"), start("a"), finish("a", time=3), finish("b", time=4),
        task(taken="5"), task(taken="7"), event("OTHER"),
    ]


@pytest.fixture
def history(spark, tmp_path):
    folder = str(tmp_path / "history")
    write_history(frame(spark, sample()), folder)
    return folder


def test_history_comes_back(spark, history):
    assert rows(read_history(spark, history)) == rows(frame(spark, sample()).limit(0).union(read_events(spark, history)))
    assert read_history(spark, history).count() == len(sample())
    assert read_history(spark, history).dtypes == frame(spark, []).dtypes


def test_nested_folders_are_read(spark, tmp_path):
    for name in ("2024/a", "2024/b"):
        frame(spark, sample()).write.parquet(str(tmp_path / name))
    assert read_history(spark, str(tmp_path)).count() == 2 * len(sample())


def test_positions_are_filled_where_absent(spark, tmp_path):
    bare = frame(spark, sample()).drop("srcFile", "srcPos", "taskId")
    bare.coalesce(1).write.parquet(str(tmp_path / "p"))
    bare.coalesce(1).write.json(str(tmp_path / "j"))
    for name, kind in (("p", "parquet"), ("j", "json")):
        df = read_history(spark, str(tmp_path / name), kind)
        assert [r.srcPos for r in df.orderBy("srcPos").collect()] == list(range(len(sample())))
        assert df.where("srcFile is null or taskId is not null").count() == 0
        assert task_features(df).count() == 2


def test_a_half_written_line_is_left_out(spark, tmp_path):
    lines = [json.dumps({"eventType": "A", "eventTime": i}) for i in range(3)]
    (tmp_path / "events.json").write_text("\n".join(lines)[:-4])
    assert [r.eventTime for r in read_history(spark, str(tmp_path), "json").collect()] == [0, 1]


def _many_files(spark, folder, files=60, rows=10):
    """Files in the order of their names; an event in two passes a filter on `A`."""
    events = [event("A" if i % 2 else "B", time=i, pos=i) for i in range(files * rows)]
    bare = frame(spark, events).drop("srcFile", "srcPos")
    bare.repartitionByRange(files, "eventTime").sortWithinPartitions("eventTime").write.parquet(folder)


def test_reading_until_enough_events_passed(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "many")
    _many_files(spark, folder)
    listed = []
    scan = history_module.read_history
    monkeypatch.setattr(history_module, "read_history", lambda s, files, **kw: listed.append(files) or scan(s, files, **kw))
    keep = lambda df: filter_event_types(df, ["A"])
    order = ["srcFile", "srcPos"]
    for limit, most in ((1, 8), (60, 16), (10_000, 60)):
        listed.clear()
        found = read_until(spark, folder, limit, keep, order)
        assert sum(map(len, listed)) <= most
        assert len(set(sum(listed, []))) == sum(map(len, listed)), "no file is read twice"
        assert rows(found) == rows(limited_events(keep(read_history(spark, folder)), limit, order))


def test_reading_until_enough_where_nothing_passes(spark, tmp_path):
    folder = str(tmp_path / "many [1]")
    _many_files(spark, folder, files=20)
    assert read_until(spark, folder, 5, lambda df: filter_event_types(df, ["C"])).count() == 0
    assert read_until(spark, folder, 5).count() == 5
    (tmp_path / "empty").mkdir()
    assert read_until(spark, str(tmp_path / "empty"), 5).count() == 0
    with pytest.raises(ValueError, match="positive"):
        read_until(spark, folder, 0)


def test_a_failing_job_leaves_the_old_report(spark, tmp_path, history):
    path = str(tmp_path / "reports" / "features")
    run_job(spark, "task_features", history, path)
    old = rows(spark.read.parquet(path))
    assert len(old) == 2
    failing = read_history(spark, history).transform(task_features).withColumn("status", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        R.write_task_report(failing, path)
    assert rows(spark.read.parquet(path)) == old
    R.write_task_report(task_features(read_history(spark, history)).limit(1), path)
    assert spark.read.parquet(path).count() == 1
    assert not [f for f in os.listdir(tmp_path / "reports") if f.startswith("_")]


def test_lost_counters_of_a_job(spark, tmp_path):
    landing = str(tmp_path / "landing")
    doc = counter_doc([("CREATED_FILES", 1.5), ("ROWS_EMITTED", 5)])
    write_history(frame(spark, [vertex("v"), finish("a", counters=doc)]), landing)
    run_job(spark, "task_features", landing, str(tmp_path / "report"), lost_path=str(tmp_path / "lost"))
    assert rows(spark.read.json(str(tmp_path / "lost")).select("counter", "lost")) == [("CREATED_FILES", 1)]


def test_damaged_files(spark, tmp_path, history):
    (tmp_path / "history" / "broken.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception, match="broken"):
        read_history(spark, history).collect()
    assert read_history(spark, history, skip_damaged_files=True).count() == len(sample())


def test_status_of_files(spark, tmp_path):
    landing = tmp_path / "history"
    events = frame(spark, [event("A", {"k": f"{i * 7919}"}, time=i, pos=i) for i in range(2000)]).coalesce(1)
    for name in ("whole", "cut", "flipped"):
        write_history(events, str(landing / name))
    write_history(events.limit(0), str(landing / "none"))
    for name in ("cut", "flipped"):
        (part,) = (landing / name).glob("part-*")
        data = bytearray(part.read_bytes())
        if name == "cut":
            del data[len(data) // 2 :]
        else:
            data[4 : len(data) // 2] = bytes(len(data) // 2 - 4)
        part.write_bytes(data)
        (landing / name / f".{part.name}.crc").unlink()
    found = {r.srcFile.split("/")[-2]: r for r in file_status(spark, str(landing)).collect()}
    assert {name: (r.statedEvents, r.damaged) for name, r in found.items()} == {
        "whole": (2000, False), "cut": (None, True), "flipped": (2000, True), "none": (None, False),
    }
    assert found["whole"].events == 2000 and found["flipped"].events < 2000
    assert sum(r.events for r in found.values()) == read_history(spark, str(landing), skip_damaged_files=True).select(
        F.xxhash64(*S.HISTORY_EVENT).alias("all")
    ).agg(F.count(F.lit(1)), F.max("all")).first()[0]


def test_a_type_filter_reaches_the_files(spark, history):
    plan = read_history(spark, history, has_positions=True).where("eventType = 'TASK_FINISHED'").select("taskId")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(eventType,TASK_FINISHED)" in text
    assert "ReadSchema: struct<eventType:string,taskId:string>" in text


@pytest.mark.parametrize("reader", [read_history, read_manifest, read_events])
def test_a_source_must_be_a_directory(spark, tmp_path, reader):
    file = tmp_path / "file"
    file.write_text("x")
    for path in (file, tmp_path / "absent"):
        with pytest.raises(ValueError, match="not a directory"):
            reader(spark, str(path))


def test_unknown_layouts_and_formats(spark, history):
    with pytest.raises(ValueError, match="layout"):
        read_events(spark, history, "binary")
    with pytest.raises(ValueError, match="format"):
        read_history(spark, history, "orc")


def test_manifest(spark, tmp_path):
    spark.createDataFrame([("c", 1), ("d", 2)], "appId string, other int").write.parquet(str(tmp_path / "m"))
    (tmp_path / "m" / "broken.parquet").write_bytes(b"no parquet at all")
    assert rows(read_manifest(spark, str(tmp_path / "m"))) == [("c",), ("d",)]


def test_text_report(spark, tmp_path):
    events = frame(spark, [*sample(), finish("p|pe", task='q"u|o\\', status="", time=9)])
    expected = task_features(events).replace("", None)  # blank text is unknown when read
    path = str(tmp_path / "report")
    R.write_task_report(expected.coalesce(1), path, "csv")
    (part,) = (tmp_path / "report").glob("part-*")
    title = part.read_text().splitlines()[0].split("|")
    assert (title[0], title[30], len(title)) == ("time", "vertextName", 32)
    assert rows(R.read_task_report(spark, path)) == rows(expected)


def test_text_report_counts_columns_by_position(spark, tmp_path):
    names = [f"any{i}" for i in range(32)]
    values = ["7", "", "", *["x"] * 5, *["1"] * 22, "Map 1", ""]
    (tmp_path / "report.txt").write_text("|".join(names) + "\n" + "|".join(values) + "\n")
    (row,) = R.read_task_report(spark, str(tmp_path)).collect()
    assert (row.eventTime, row.nodeID, row.status, row.specRunningNano) == (7, None, "x", 1)
    assert (row.vertexName, row.vertexNumTasks) == ("Map 1", None)


def test_reports_replace_older_ones(spark, tmp_path):
    report = task_features(frame(spark, sample()))
    path = str(tmp_path / "report")
    for _ in range(2):
        R.write_task_report(report, path)
    assert R.read_task_report(spark, path, "parquet").count() == 2
    with pytest.raises(ValueError, match="format"):
        R.write_task_report(report, path, "xml")


def test_time_reports(spark, tmp_path):
    df = frame(spark, sample())
    R.write_time_report(task_times(df), str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.columns == [*S.TIME_COLUMNS, "generated_at"]
    R.write_time_detail(time_detail(df), str(tmp_path / "d"), "csv")
    assert spark.read.option("sep", "|").option("header", True).csv(str(tmp_path / "d")).columns == S.DETAIL_COLUMNS


def test_tables_of_the_analysis_database(spark):
    report = task_features(frame(spark, sample()))
    for _ in range(2):
        R.create_report_tables(report, "history")
    assert spark.table("history.taskevents").count() == 2
    succ = spark.table("history.succtaskevents")
    assert rows(stats.averages_by_node(succ)) == rows(stats.averages_by_node(stats.succ_task_events(report)))
    detail = spark.sql("DESCRIBE EXTENDED history.taskevents").where("col_name = 'Statistics'").collect()
    assert "2 rows" in detail[0].data_type


def test_jobs(spark, tmp_path, history):
    out = str(tmp_path / "out")
    run_job(spark, "task_features", history, out)
    df = frame(spark, sample())
    assert rows(spark.read.parquet(out).drop("eventTime")) == rows(task_features(df).drop("eventTime"))
    run_job(spark, "task_times", history, out)
    assert rows(spark.read.parquet(out).select(*S.TIME_COLUMNS)) == [("app", "Map", 2, 5, 7, 6, 1)]


def test_job_on_entity_logs(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    wanted = [e for e in sample() if e[0] in S.FEATURE_TYPES]
    (logs / "entitylog-1").write_text("\n".join(json.dumps(as_entity(e)) for e in wanted))
    out = str(tmp_path / "out")
    run_job(spark, "task_features", str(logs), out, ats=True, output_format="csv")
    assert rows(R.read_task_report(spark, out)) == rows(task_features(frame(spark, wanted)))
    with pytest.raises(ValueError, match="callers"):
        run_job(spark, "task_times", str(logs), out, ats=True)


@pytest.mark.parametrize("limit, attempts", [(1, 0), (4, 2), (0, 2)])
def test_limited_feature_job(spark, tmp_path, history, limit, attempts):
    out = str(tmp_path / "out")
    run_job(spark, "task_features", history, out, limit=limit)
    found = spark.read.parquet(out).count()
    assert found <= attempts if limit == 1 else found == attempts


@pytest.mark.parametrize("limit, groups", [(3, 1), (1, 0)])
def test_limited_time_job(spark, tmp_path, history, limit, groups):
    out = str(tmp_path / "out")
    run_job(spark, "task_times", history, out, limit=limit)
    assert spark.read.parquet(out).count() == groups


def test_processors(spark):
    with pytest.raises(ValueError, match="unknown processor 'nothing', known are: .*task_features, task_times"):
        find("nothing")
    own = register(Processor("per_type", ["OTHER", S.TASK_FINISHED], lambda e: e.groupBy("eventType").count()))
    try:
        assert rows(own.apply(frame(spark, sample()))) == [("OTHER", 1), (S.TASK_FINISHED, 2)]
        with pytest.raises(ValueError, match="no writer"):
            run_job(spark, "per_type", "in", "out")
    finally:
        del processors["per_type"]


def test_command_line(spark, tmp_path, history):
    out = str(tmp_path / "out")
    main(["task_features", "-i", history, "-o", out])
    assert R.read_task_report(spark, out).count() == 2
    with pytest.raises(SystemExit):
        main(["nothing", "-i", history, "-o", out])


def test_one_bad_record_loses_only_itself(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    good = [vertex("v1"), *[finish(f"a{i}", "v1", time=i + 1) for i in range(10)]]
    lines = [json.dumps(r.asDict(True)) for r in frame(spark, good).drop("srcFile", "srcPos").collect()]
    broken = json.loads(lines[4]) | {"eventData": "not a list"}
    lines[4] = json.dumps(broken)
    (landing / "a.json").write_text("\n".join(lines))
    assert task_features(read_history(spark, str(landing), "json")).count() == 9
    run_job(spark, "task_features", str(landing), str(tmp_path / "report"), file_format="json", summary_path=str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "report")).count() == 9
    assert spark.read.json(str(tmp_path / "s")).first().totalEvents == 10
    events, rejected = read_json_history(spark, str(landing))
    assert (events.count(), [json.loads(r.rejectedRecord) for r in rejected.collect()]) == (10, [broken])


def test_events_without_identity_are_not_multiplied(spark):
    events = frame(spark, [vertex("v1"), *[finish(None, "v1", time=5) for _ in range(4)]])
    unset = events.withColumn("srcFile", F.lit(None).cast("string")).withColumn("srcPos", F.lit(None).cast("bigint"))
    assert task_features(unset).count() == 4


@pytest.mark.parametrize("order", [None, ["srcPos"]])
@pytest.mark.parametrize("limit", [1, 299, 1000])
def test_limits_over_many_tasks(spark, order, limit):
    events = frame(spark, [finish(f"a{i}", "v1", time=i) for i in range(600)]).repartition(6)
    found = limited_events(events, limit, order, one_task_rows=0)
    rows = [r.srcPos for r in found.collect()]
    assert len(rows) == len(set(rows)) == min(limit, 600)
    if order:
        assert sorted(rows) == sorted(r.srcPos for r in events.collect())[:limit]
    elif limit == 299:
        assert found.rdd.getNumPartitions() > 1


def test_a_processor_that_takes_all_is_handed_each_event_once(spark, tmp_path):
    landing = str(tmp_path / "landing")
    write_history(frame(spark, [submitted("c"), vertex("v1")]), landing)
    own = Processor("all", None, lambda e: e, lambda df, path, _: df.write.parquet(path), needs_callers=True)
    with registered(own):
        run_job(spark, "all", landing, str(tmp_path / "limited"), limit=10)
        run_job(spark, "all", landing, str(tmp_path / "whole"))
    assert spark.read.parquet(str(tmp_path / "limited")).count() == 2
    assert spark.read.parquet(str(tmp_path / "whole")).count() == 2


def test_stored_events_are_removed(spark, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir")
    landing = str(tmp_path / "landing")
    write_history(frame(spark, [vertex("v1"), finish("a", "v1")]), landing)
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    run_job(spark, "task_features", landing, str(tmp_path / "report"), limit=5)
    failing = Processor("failing", None, lambda e: e, lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError), registered(failing):
        run_job(spark, "failing", landing, str(tmp_path / "none"), limit=5)
    assert set(os.listdir(shared)) == before


def test_files_without_events_count(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "entitylog-1").write_text('{"entity":"a","events":[]}')
    (logs / "entitylog-2").write_text("")
    (logs / "other").write_text("{}")
    assert tuple(ats_summary(spark, str(logs)).first()) == (1, 0, 1, 2)


def test_events_are_dealt_before_their_payloads_are_made(spark):
    folder = "/root/testdata/sf0.001"
    dealt = tables.history_from_events(spark, folder, tasks=3)
    below = dealt._jdf.queryExecution().optimizedPlan().toString().split("Repartition", 1)[1]
    assert "named_struct" not in below and "counterGroups" not in below
    assert dealt.groupBy(F.spark_partition_id()).count().count() == 3
    assert sorted(dealt.collect(), key=str) == sorted(tables.history_from_events(spark, folder).collect(), key=str)


def test_whole_files_are_not_gathered_to_be_sorted(spark, monkeypatch):
    monkeypatch.setattr(queries, "write_history", lambda *_: pytest.fail("sorts a quarter of all events in a task"))
    found = queries.queries()["file_status"](spark, "/root/testdata/sf0.001").first()
    assert (found.files, found.damaged, found.stated) == (5, 1, found.events)
