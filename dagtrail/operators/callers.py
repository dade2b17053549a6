"""Filters on events, and the caller that submitted their DAG."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dagtrail import schemas as S
from dagtrail.functions.payload import blank, kv
from dagtrail.operators.lookup import lookup_join
from dagtrail.sources.paths import store_rows

# At most this many events are gathered in one task where a number of them is asked for.
ONE_TASK_ROWS = 1_000_000


def order_key(columns: list[str] = S.ORDER):
    return F.struct(*columns)


def filter_event_types(events: DataFrame, types: list[str] | None) -> DataFrame:
    """Keep the listed event types; None keeps all."""
    if types is None:
        return events
    for name in types:
        if name is None or not name.strip():
            raise ValueError("event types must not be null or blank")
    return events.where(F.col("eventType").isin(list(types)))


def dag_callers(events: DataFrame) -> DataFrame:
    """The first caller of each DAG."""
    submitted = events.where(F.col("eventType") == S.DAG_SUBMITTED)
    named = submitted.select("dagId", kv("callerId").alias("callerId"), *S.ORDER)
    return (
        named.where(F.col("callerId").isNotNull())
        .groupBy("dagId")
        .agg(F.min_by("callerId", order_key()).alias("callerId"))
    )


def with_caller(events: DataFrame, types: list[str] | None = None, callers: DataFrame | None = None) -> DataFrame:
    """Tag events with the caller of their DAG; events of DAGs without one are dropped.

    The callers come from all events, also if only some types are kept.
    """
    callers = dag_callers(events) if callers is None else callers
    return lookup_join(filter_event_types(events, types), callers, "dagId", S.IDENTITY)


def delivered(events: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Events as a collecting job delivers them: caller known, application not blank."""
    return with_caller(events.where(~blank(F.col("appId"))), types, dag_callers(events))


def caller_ids(events: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Callers that own at least one event of the wanted types."""
    dags = filter_event_types(events, types).select("dagId").distinct()
    return dags.join(dag_callers(events), "dagId").select("callerId").distinct()


def app_ids(events: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Applications with at least one event of the wanted types and a known caller.

    Events are reduced to distinct ids before the join.
    """
    dags = filter_event_types(events, types).select("dagId", "appId").where(~blank(F.col("appId"))).distinct()
    return dags.join(dag_callers(events), "dagId").select("appId").distinct()


def events_for_caller(events: DataFrame, caller_id: str, types: list[str] | None = None) -> DataFrame:
    """All events of the DAGs a caller submitted."""
    return with_caller(events, types, dag_callers(events).where(F.col("callerId") == caller_id))


def events_for_app(events: DataFrame, app_id: str, types: list[str] | None = None) -> DataFrame:
    """All events of an application that have a known caller."""
    of_app = events.where((F.col("appId") == app_id) & ~blank(F.col("appId")))
    return with_caller(of_app, types, dag_callers(events))


def manifest_for_app(manifest: DataFrame, app_id: str) -> DataFrame:
    return manifest.where(F.col("appId") == app_id)


def manifest_app_ids(manifest: DataFrame) -> DataFrame:
    return manifest.select("appId").distinct()


def events_for_manifest(events: DataFrame, manifest: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Events whose caller is the application of a manifest entry.

    The manifest is reduced to its applications and matched against the callers, one row
    per DAG, not against events; a caller of very many DAGs is sliced like any hot key.
    """
    wanted = manifest_app_ids(manifest).select(F.col("appId").alias("callerId"))
    callers = lookup_join(dag_callers(events), wanted, "callerId", ["dagId"]).select("dagId", "callerId")
    return with_caller(events, types, callers)


def ingest_summary(
    events: DataFrame, types: list[str] | None = None, files: int | None = None
) -> DataFrame:
    """Counts of one ingest: read, without caller, rejected by type, passed, files.

    Events are read once and reduced to a row per DAG and file; whether the DAG has a caller
    is summed over its files, so no event is joined. `files` is the number of files read, empty
    ones too; without it the files that gave events count.
    """
    wanted = F.lit(True) if types is None else F.col("eventType").isin(list(types))
    names_caller = (F.col("eventType") == S.DAG_SUBMITTED) & kv("callerId").isNotNull()
    keys = ["dagId", "srcFile"] if files is None else ["dagId"]
    per_dag = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(wanted).alias("wanted"),
        F.count_if(names_caller).alias("named"),
    )
    found = F.lit(files).cast("bigint")
    if files is None:
        found = F.count_distinct("srcFile")
        per_dag = per_dag.withColumn("named", F.sum("named").over(Window.partitionBy("dagId")))
    # events without a DAG id share no caller
    has_caller = F.col("dagId").isNotNull() & (F.col("named") > 0)

    def over(value, condition):
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))

    counts = per_dag.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("totalEvents"),
        over(F.col("total"), ~has_caller).alias("eventsWithoutCaller"),
        over(F.col("total") - F.col("wanted"), has_caller).alias("rejectedEvents"),
        over(F.col("wanted"), has_caller).alias("passedEvents"),
        found.alias("foundFiles"),
    )
    surviving = F.col("totalEvents") - F.col("rejectedEvents")
    return counts.withColumn("survivingEvents", surviving).withColumn(
        "survivingPercent", F.expr("survivingEvents * 100 div nullif(totalEvents, 0)")
    )


def limited_events(
    events: DataFrame, limit: int | None, order: list[str] | None = None, one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """At most `limit` events, the first ones if an order is given; 0 or less is no limit.

    Up to `one_task_rows` of them are gathered in one task. More of them stay in their tasks,
    each of which is told how many of its events count: a running total over the tasks, or
    over ranges of the order, tells that.
    """
    if limit is None or limit <= 0:
        return events
    if limit <= one_task_rows:
        return (events.orderBy(*order) if order else events).limit(limit)
    parted = (events.repartitionByRange(*order) if order else events).withColumn("_part", F.spark_partition_id())
    # numbers and totals must come from the same tasks, so both read one stored table
    stored, columns = store_rows(parted, "limited"), events.columns
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    # a row per task; all events of most tasks count or none do, and one task at most is cut
    quota = sizes.select("_part", "_size", (F.lit(limit) - before).alias("_quota")).where("_quota > 0")
    whole = stored.join(F.broadcast(quota.where("_quota >= _size").select("_part")), "_part")
    cut = stored.join(F.broadcast(quota.where("_quota < _size").select("_part", "_quota")), "_part")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*(order or ["_part"])))
    cut = cut.withColumn("_nth", nth).where("_nth <= _quota")
    return whole.select(*columns).unionByName(cut.select(*columns))
