"""Task-time statistics per application and operation type."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagtrail import schemas as S
from dagtrail.functions.moments import collect_moments, mean, merge_moments, stddev_pop
from dagtrail.functions.payload import blank
from dagtrail.operators.callers import dag_callers
from dagtrail.operators.lookup import lookup_join
from dagtrail.operators.vertices import latest_llap, task_finishes, vertices


def _ids(events: DataFrame, event_type: str) -> DataFrame:
    """Ids of all events of a type: enough to weigh join keys without reading payloads."""
    return events.where(F.col("eventType") == event_type).select("dagId", "vertexId")


def _known_vertices(events: DataFrame) -> DataFrame:
    """Vertices as a collecting job sees them; `vertexAppId` is their application."""
    inits = vertices(events).where(F.col("isLlap") & ~blank(F.col("appId")))
    ids = _ids(events, S.VERTEX_INITIALIZED)
    seen = latest_llap(lookup_join(inits, dag_callers(events), "dagId", S.IDENTITY, weigh=ids))
    return seen.select("vertexId", F.col("appId").alias("vertexAppId"), F.col("opType").alias("type"))


def _successes(events: DataFrame) -> DataFrame:
    return task_finishes(events).where(F.col("wasSuccessful") & ~blank(F.col("appId")))


def _same_application():
    """The application of task and vertex; the job fails if they differ."""
    message = F.concat(F.lit("application of a task differs from that of vertex "), F.col("vertexId"))
    return F.when(F.col("appId") == F.col("vertexAppId"), F.col("appId")).otherwise(F.raise_error(message))


def task_times(events: DataFrame) -> DataFrame:
    """Count, extremes, mean and deviation of task times per application and type.

    Tasks are reduced to moments per vertex before either join, and the moments merge
    exactly afterwards. The join on the vertex sees one row of each; on the DAG, one
    row per vertex remains, so that join is still sliced.
    """
    per_vertex = (
        _successes(events)
        .groupBy("dagId", "vertexId", "appId")
        .agg(*collect_moments("timeTaken"), F.min("timeTaken").alias("lo"), F.max("timeTaken").alias("hi"))
    )
    ids = _ids(events, S.TASK_FINISHED)
    called = lookup_join(per_vertex, dag_callers(events), "dagId", ["vertexId", "appId"], weigh=ids)
    typed = called.join(_known_vertices(events), "vertexId")
    groups = (
        typed.select(_same_application().alias("applicationID"), "type", "n", "s", "q", "lo", "hi")
        .groupBy("applicationID", "type")
        .agg(*merge_moments(), F.min("lo").alias("minTime"), F.max("hi").alias("maxTime"))
    )
    return groups.select(
        "applicationID",
        "type",
        F.col("n").alias("count"),
        "minTime",
        "maxTime",
        mean().cast("bigint").alias("avgTime"),
        stddev_pop().cast("bigint").alias("stdDevTime"),
    )


def time_detail(events: DataFrame) -> DataFrame:
    """One row per task that the time report counts."""
    ids = _ids(events, S.TASK_FINISHED)
    called = lookup_join(_successes(events), dag_callers(events), "dagId", S.IDENTITY, weigh=ids)
    typed = lookup_join(called, _known_vertices(events), "vertexId", S.IDENTITY, weigh=ids)
    return typed.select(
        _same_application().alias("applicationID"),
        F.col("vertexId").alias("vertexID"),
        "type",
        F.col("taskId").alias("taskID"),
        "timeTaken",
        "failedAttempts",
    )
