"""Questions asked of the task report: status, nodes, durations, skew."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagtrail import schemas as S
from dagtrail.functions.moments import collect_moments, mean, stddev_pop
from dagtrail.functions.payload import host_name, task_type

WHOLE = "decimal(10,0)"
PERCENT = "decimal(4,1)"


def succeeded(report: DataFrame) -> DataFrame:
    return report.where(F.col("status") == S.SUCCEEDED)


def succ_task_events(report: DataFrame) -> DataFrame:
    """Succeeded attempts with host name and task type instead of the ids."""
    return succeeded(report).select(
        "eventTime",
        host_name(F.col("nodeID")).alias("hostname"),
        task_type(F.col("vertexName")).alias("taskType"),
        "contID",
        "taskID",
        *S.MEASURES,
        "vertexName",
        "vertexNumTasks",
    )


def status_distribution(report: DataFrame) -> DataFrame:
    """Attempts per final status."""
    return report.groupBy(F.col("status").alias("taskFinishStatus")).agg(
        F.count(F.lit(1)).alias("eventCount")
    )


def node_restarts(report: DataFrame) -> DataFrame:
    """Node ids seen per host beyond the first; a restarted node comes back on another port."""
    hosts = succeeded(report).select(host_name(F.col("nodeID")).alias("hostname"), "nodeID")
    restarts = F.count_distinct("nodeID") - 1
    return (
        hosts.groupBy("hostname")
        .agg(restarts.alias("restartsAfterCrash"))
        .orderBy(F.col("hostname").asc_nulls_last())
    )


def _durations(rows: DataFrame, *keys: str) -> DataFrame:
    """Attempts, mean and deviation of the duration per group."""
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"), *collect_moments(S.DURATION_COLUMN))
    return groups.select(*keys, "attempts", mean().cast(WHOLE).alias("avg"), stddev_pop().cast(WHOLE).alias("stddev"))


def duration_by_type(succ: DataFrame) -> DataFrame:
    """Durations per task type."""
    return _durations(succ, "taskType").select(
        "taskType",
        F.col("attempts").alias("numTasksByType"),
        F.col("avg").alias("avgDurationMS"),
        F.col("stddev").alias("stdDevDurationMS"),
    )


def averages_by_node(succ: DataFrame) -> DataFrame:
    """Durations per host and task type."""
    return _durations(succ, "hostname", "taskType").withColumnRenamed("attempts", "tasksInType")


def node_averages_ranked(averages: DataFrame) -> DataFrame:
    """Node averages by task type, busiest nodes first."""
    return averages.select(
        F.col("hostname").alias("hostName"),
        "taskType",
        F.col("tasksInType").alias("numTasksByType"),
        F.col("avg").alias("avgForType"),
        F.col("stddev").alias("stdDevPop"),
    ).orderBy(F.col("taskType").asc_nulls_last(), F.col("numTasksByType").desc_nulls_first())


def node_distance(averages: DataFrame) -> DataFrame:
    """How far single nodes are from the mean of the node averages.

    Deliberately works on the rounded averages, every node weighing the same.
    """
    groups = averages.groupBy("taskType").agg(
        *collect_moments("avg"),
        F.min("avg").cast("double").alias("lo"),
        F.max("avg").cast("double").alias("hi"),
    )
    distance = F.greatest(mean() - F.col("lo"), F.col("hi") - mean())
    return groups.select(
        "taskType",
        mean().cast(WHOLE).alias("avgAllNodes"),
        stddev_pop().cast(WHOLE).alias("stdDevAllNodes"),
        distance.cast(WHOLE).alias("maxDiff"),
        (distance * 100 / mean()).cast(PERCENT).alias("maxDiffPercent"),
    )


def cluster_skew(succ: DataFrame) -> DataFrame:
    """Total map time per host and its share of the busiest host.

    The busiest host is looked for in the same totals, columns included, so that they
    are computed once."""
    maps = succ.where(F.col("taskType") == "Map")
    totals = maps.groupBy("hostname").agg(
        F.sum(S.DURATION_COLUMN).alias("totalTimeMS"), F.count(F.lit(1)).alias("numTasks")
    )
    top = totals.agg(F.max(F.struct("totalTimeMS", "numTasks")).alias("top"))
    busiest = top.select("top.totalTimeMS").scalar().cast("decimal(19,0)")
    share = F.col("totalTimeMS").cast("decimal(19,0)") * 100 / busiest
    return totals.select(
        F.col("hostname").alias("hostName"),
        "totalTimeMS",
        share.cast(PERCENT).alias("totalTimePercent"),
        "numTasks",
    )


def top_tasks(succ: DataFrame, n: int = 30) -> DataFrame:
    """The n longest attempts; an unknown duration sorts first, as in the report database."""
    shown = succ.select(
        (F.col(S.DURATION_COLUMN) * 1_000_000).alias("taskDurationNano"),
        "specQueueNano",
        F.col("specRunningNano").alias("specRunNano"),
        "consumerTimeNano",
        "decodeTimeNano",
        "hdfsTimeNano",
        F.col("totalIONano").alias("total I/O Nano"),
        "inputRecords",
        "inputSplitLengthBytes",
        "decodeBatches",
        "vectorBatches",
        "rowsEmitted",
        "selRowGroups",
        "vertexNumTasks",
    )
    first, *rest = [F.col(f"`{c}`").desc_nulls_first() for c in shown.columns]
    return shown.orderBy(first, *rest).limit(n)
