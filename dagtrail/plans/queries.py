"""The registered queries: every operator on whole tables."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagtrail import schemas as S
from dagtrail.functions.payload import counter_values, kv, kv_or_blank, task_duration
from dagtrail.operators import callers as C
from dagtrail.operators import stats
from dagtrail.operators.features import attempt_finishes, lost_counters, task_features
from dagtrail.operators.lookup import SLICE_ROWS_SETTING
from dagtrail.operators.times import task_times, time_detail
from dagtrail.operators.vertices import attempt_starts, llap_vertices, task_finishes
from dagtrail.plans.jobs import run_job
from dagtrail.plans.processors import Processor, registered
from dagtrail.sources import tables
from dagtrail.sources.entitylog import ats_summary
from dagtrail.sources.events import read_events
from dagtrail.sources.history import EVENTS_BELOW, MANIFEST_BELOW, file_status, read_base, read_until, write_history
from dagtrail.sources.paths import shared_folder
from dagtrail.sources.report import create_report_tables, read_task_report, write_task_report
from dagtrail.streaming.features import stream_ats, stream_history, stream_task_features
from dagtrail.streaming.stateful import follow, followed_report

Query = Callable[[SparkSession, str], DataFrame]


def _on_report(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: fn(tables.report_from_lineitem(spark, folder))


def _on_succeeded(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_report(lambda report: fn(stats.succ_task_events(report)))


def _on_averages(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_succeeded(lambda succ: fn(stats.averages_by_node(succ)))


def _on_history(fn: Callable[[DataFrame], DataFrame], *types: str) -> Query:
    return lambda spark, folder: fn(tables.history_from_events(spark, folder, list(types) or None))


def _on_entities(fn: Callable[[DataFrame], DataFrame]) -> Query:
    """Write the events as entity logs, read them back and go on from there."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        logs = shared_folder(spark, "entitylogs")
        tables.entity_lines_from(tables.history_from_events(spark, folder)).write.text(logs)
        return fn(read_events(spark, logs, "ats", file_glob="part-*"))

    return run


def _ids(events: DataFrame) -> DataFrame:
    """Events without payload, to compare."""
    return events.drop("eventData", "srcFile")


def _event_kv(events: DataFrame) -> DataFrame:
    return events.select(
        "srcPos",
        kv("status").alias("status"),
        kv("vertexName").alias("vertexName"),
        kv("nodeId").alias("nodeId"),
        kv("timeTaken").alias("timeTaken"),
        kv_or_blank("callerId").alias("callerId"),
    )


def _counter_values(events: DataFrame) -> DataFrame:
    names = sorted(S.REPORT_COUNTERS.values())
    found = attempt_finishes(events).withColumn("values", counter_values(kv("counters"), names))
    return found.select("srcPos", *[F.get("values", F.lit(i)).alias(n) for i, n in enumerate(names)])


def _task_duration(events: DataFrame) -> DataFrame:
    counter = F.get(counter_values(kv("counters"), [S.DURATION_COUNTER]), F.lit(0))
    return attempt_finishes(events).select("srcPos", task_duration(counter).alias("duration"))


def _task_finishes(events: DataFrame) -> DataFrame:
    return task_finishes(events).drop("srcFile")


def _report_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "report")
    write_task_report(tables.report_from_lineitem(spark, folder), path, "csv")
    return read_task_report(spark, path, "csv")


def _job(processor: str, columns: list[str]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        landing, report = shared_folder(spark, "landing"), shared_folder(spark, "report")
        write_history(tables.history_from_events(spark, folder), f"{landing}/{EVENTS_BELOW}")
        run_job(spark, processor, landing, report, has_positions=True)
        return spark.read.parquet(report).select(*columns)

    return run


def _json_job(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON, with records between them that are none."""
    landing, report = shared_folder(spark, "landing"), shared_folder(spark, "report")
    lines = tables.history_from_events(spark, folder).select(F.to_json(F.struct(*S.HISTORY_EVENT)).alias("line"))
    odd = F.when(F.rand(1) < 0.1, F.lit('{"eventType":"TASK_ATTEMPT_FINISHED","eventData":"not a list"}'))
    lines.select(F.explode(F.array_compact(F.array(odd, "line"))).alias("line")).write.text(landing)
    run_job(spark, "task_features", landing, report, file_format="json")
    return spark.read.parquet(report).select(*S.REPORT_COLUMNS)


_handed = Processor("handed", S.FEATURE_TYPES, _ids, lambda df, path, _format: df.write.parquet(path))


def _limited_job(spark: SparkSession, folder: str) -> DataFrame:
    """How many events a limited job hands on, how many it made up, and whether tasks share them."""
    landing, report = shared_folder(spark, "landing"), shared_folder(spark, "report")
    history = tables.history_from_events(spark, folder)
    write_history(history.repartition(8, "srcPos"), landing)
    wanted = C.filter_event_types(history, S.FEATURE_TYPES).select("srcPos")
    limit = int(wanted.count() * 0.6)
    with registered(_handed):
        run_job(spark, _handed.name, landing, report, limit=limit, has_positions=True, one_task_rows=100)
    handed = spark.read.parquet(report).withColumn("task", F.input_file_name())
    taken = handed.agg(F.count_distinct("srcPos").alias("taken"), (F.count_distinct("task") > 1).alias("several_tasks"))
    unknown = handed.join(wanted, "srcPos", "left_anti").agg(F.count(F.lit(1)).alias("unknown")).scalar()
    return taken.withColumn("unknown", unknown)


def _own_processor(spark: SparkSession, folder: str) -> DataFrame:
    """A processor of one's own that needs callers: what it is handed, by type."""
    kind = F.when((F.col("eventType") == S.DAG_SUBMITTED) & (F.col("appId") == ""), "NAMED").otherwise(F.col("eventType"))

    def by_type(events: DataFrame) -> DataFrame:
        return events.groupBy(kind.alias("eventType")).agg(F.count(F.lit(1)).alias("events"))

    own = Processor("by_type", None, by_type, needs_callers=True)
    return own.apply(tables.history_from_events(spark, folder))


def _lost_counters(events: DataFrame) -> DataFrame:
    """A counter made a fraction in a quarter of the events, another beyond 64 bits in a fifth."""
    names = sorted(S.REPORT_COUNTERS.values())
    for name, prefix, every in ((names[0], "0.5", 4), (names[-1], "9" * 20, 5)):
        behind = f'(?<="counterName":"{name}","counterValue":)'
        put = F.transform(
            "eventData",
            lambda pair: F.struct(
                pair["key"].alias("key"), F.regexp_replace(pair["value"], behind, prefix).alias("value")
            ),
        )
        events = events.withColumn("eventData", F.when(F.col("srcPos") % every == 0, put).otherwise(F.col("eventData")))
    return lost_counters(events)


def _read_until(spark: SparkSession, folder: str) -> DataFrame:
    """The first 100 task finishes by position, of files that each hold a range of positions."""
    landing = shared_folder(spark, "landing")
    events = tables.history_from_events(spark, folder).drop("srcFile")
    events.repartitionByRange(40, "srcPos").write.parquet(landing)
    finishes = read_until(spark, landing, 100, lambda e: C.filter_event_types(e, [S.TASK_FINISHED]), ["srcPos"])
    return _ids(finishes)


def _file_status(spark: SparkSession, folder: str) -> DataFrame:
    """Counts over four whole files and one that is no Parquet.

    A task writes a quarter of all events, so they are not gathered there to be sorted by type, as landing tables are.
    """
    landing = shared_folder(spark, "landing")
    events = tables.history_from_events(spark, folder)
    dealt = tables.history_from_events(spark, folder, tasks=4)
    dealt.select(*S.HISTORY_EVENT).write.parquet(f"{landing}/whole")
    events.select("taskId").coalesce(1).write.text(f"{landing}/broken")
    return file_status(spark, landing).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("damaged").alias("damaged"),
        F.sum("statedEvents").alias("stated"),
        F.sum("events").alias("events"),
    )


def _detail_job(spark: SparkSession, folder: str) -> DataFrame:
    landing, report = shared_folder(spark, "landing"), shared_folder(spark, "report")
    write_history(tables.history_from_events(spark, folder), landing)
    run_job(spark, "task_times", landing, report, has_positions=True, detail_path=f"{report}-detail")
    return spark.read.parquet(f"{report}-detail").select(*S.DETAIL_COLUMNS)


def _report_tables(spark: SparkSession, folder: str) -> DataFrame:
    database = f"dagtrail_{uuid.uuid4().hex}"
    create_report_tables(tables.report_from_lineitem(spark, folder), database)
    return spark.table(f"{database}.averagesbynode")


def _stream_task_features(spark: SparkSession, folder: str) -> DataFrame:
    arriving = shared_folder(spark, "arriving")
    write_history(tables.history_from_events(spark, folder), arriving)
    landing, checkpoint = shared_folder(spark, "landing"), shared_folder(spark, "stream")
    return stream_task_features(stream_history(spark, arriving), landing, checkpoint)


def _stream_followed_features(spark: SparkSession, folder: str) -> DataFrame:
    """Events arrive in two parts, finishes of even positions first; the state keeps what the report needs."""
    arriving, report = shared_folder(spark, "arriving"), shared_folder(spark, "followed")
    events = tables.history_from_events(spark, folder)
    early = (F.col("eventType") == S.TASK_ATTEMPT_FINISHED) & (F.col("srcPos") % 2 == 0)
    for part, which in (("early", early), ("late", ~early)):
        write_history(events.where(which), f"{arriving}/{part}")
        follow(stream_history(spark, arriving), report)
    return followed_report(spark, report)


def _stream_ats_features(spark: SparkSession, folder: str) -> DataFrame:
    logs = shared_folder(spark, "entitylogs")
    tables.entity_lines_from(tables.history_from_events(spark, folder)).write.text(logs)
    landing, checkpoint = shared_folder(spark, "landing"), shared_folder(spark, "stream")
    return stream_task_features(stream_ats(spark, logs, "part-*"), landing, checkpoint)


def _entity_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Three files with entities, an empty one, and one of another name."""
    logs = shared_folder(spark, "entitylogs")
    lines = tables.entity_lines_from(tables.history_from_events(spark, folder))
    tables.entity_lines_from(tables.history_from_events(spark, folder, tasks=3)).write.text(logs)
    spark.range(1, numPartitions=1).where("id < 0").selectExpr("string(id)").write.text(f"{logs}/nothing")
    lines.limit(1).write.option("compression", "gzip").text(f"{logs}/other")
    return ats_summary(spark, logs, "part-*.txt")


def _hot(fn: Callable[[DataFrame], DataFrame], column: str, value: str) -> Query:
    """One key with a third of all events, cut into slices."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        events = tables.history_from_events(spark, folder)
        hot = F.when(F.col("srcPos") % 3 == 0, F.lit(value)).otherwise(F.col(column))
        before = spark.conf.get(SLICE_ROWS_SETTING, None)
        spark.conf.set(SLICE_ROWS_SETTING, "100")
        try:
            return fn(events.withColumn(column, hot))
        finally:
            if before is None:
                spark.conf.unset(SLICE_ROWS_SETTING)
            else:
                spark.conf.set(SLICE_ROWS_SETTING, before)

    return run


def _base(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Events and manifest, written and read as they lie below a base directory."""
    base = shared_folder(spark, "base")
    write_history(tables.history_from_events(spark, folder), f"{base}/{EVENTS_BELOW}")
    tables.manifest_from_events(spark, folder).write.parquet(f"{base}/{MANIFEST_BELOW}")
    return read_base(spark, base)


def _manifest_by_app(spark: SparkSession, folder: str) -> DataFrame:
    return _base(spark, folder)[1].groupBy("appId").agg(F.count(F.lit(1)).alias("entries"))


def _events_for_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(C.events_for_manifest(*_base(spark, folder)))


def queries() -> dict[str, Query]:
    return {
        "status_distribution": _on_report(stats.status_distribution),
        "node_restarts": _on_report(stats.node_restarts),
        "succ_task_events": _on_report(stats.succ_task_events),
        "duration_by_type": _on_succeeded(stats.duration_by_type),
        "top_tasks": _on_succeeded(stats.top_tasks),
        "averages_by_node": _on_succeeded(stats.averages_by_node),
        "node_averages_ranked": _on_averages(stats.node_averages_ranked),
        "node_distance": _on_averages(stats.node_distance),
        "cluster_skew": _on_succeeded(stats.cluster_skew),
        "task_report_roundtrip": _report_roundtrip,
        "filter_event_types": _on_history(lambda e: _ids(C.filter_event_types(e, S.TIME_TYPES))),
        "event_kv": _on_history(_event_kv),
        "dag_callers": _on_history(C.dag_callers, S.DAG_SUBMITTED),
        "events_with_caller": _on_history(lambda e: _ids(C.with_caller(e))),
        "caller_ids": _on_history(lambda e: C.caller_ids(e, S.TIME_TYPES), S.DAG_SUBMITTED, *S.TIME_TYPES),
        "events_for_caller": _on_history(lambda e: _ids(C.events_for_caller(e, "caller_3"))),
        "app_ids": _on_history(lambda e: C.app_ids(e, S.TIME_TYPES), S.DAG_SUBMITTED, *S.TIME_TYPES),
        "events_for_app": _on_history(lambda e: _ids(C.events_for_app(e, "app_3"))),
        "manifest_by_app": _manifest_by_app,
        "events_for_manifest": _events_for_manifest,
        "ingest_summary": _on_history(lambda e: C.ingest_summary(e, S.TIME_TYPES)),
        "llap_vertices": _on_history(llap_vertices, S.VERTEX_INITIALIZED),
        "task_finishes": _on_history(_task_finishes, S.TASK_FINISHED),
        "task_times": _on_history(task_times, S.DAG_SUBMITTED, *S.TIME_TYPES),
        "time_detail": _on_history(time_detail, S.DAG_SUBMITTED, *S.TIME_TYPES),
        "attempt_placement": _on_history(attempt_starts, S.TASK_ATTEMPT_STARTED),
        "counter_values": _on_history(_counter_values, S.TASK_ATTEMPT_FINISHED),
        "task_duration": _on_history(_task_duration, S.TASK_ATTEMPT_FINISHED),
        "task_features": _on_history(task_features, *S.FEATURE_TYPES),
        "ats_events": _on_entities(lambda e: e.drop("srcFile", "srcPos", "eventData")),
        "ats_event_data": _on_entities(_ats_event_data),
        "ats_task_features": _on_entities(task_features),
        "limited_events": _on_history(lambda e: _ids(C.limited_events(e, 100, ["srcPos"], one_task_rows=50))),
        "read_until": _read_until,
        "file_status": _file_status,
        "lost_counters": _on_history(_lost_counters, S.TASK_ATTEMPT_FINISHED),
        "run_job_features": _job("task_features", S.REPORT_COLUMNS),
        "run_job_times": _job("task_times", S.TIME_COLUMNS),
        "run_job_features_json": _json_job,
        "run_job_limited": _limited_job,
        "own_processor": _own_processor,
        "time_detail_job": _detail_job,
        "report_tables": _report_tables,
        "entity_summary": _entity_summary,
        "task_features_hot": _hot(task_features, "vertexId", "vertex_1"),
        "events_with_caller_hot": _hot(lambda e: _ids(C.with_caller(e)), "dagId", "dag_1"),
        "stream_task_features": _stream_task_features,
        "stream_ats_features": _stream_ats_features,
        "stream_followed_features": _stream_followed_features,
    }


def _ats_event_data(events: DataFrame) -> DataFrame:
    pairs = events.select("taskAttemptId", "vertexId", "eventTime", F.explode("eventData").alias("pair"))
    return pairs.select("taskAttemptId", "vertexId", "eventTime", "pair.key", "pair.value")
