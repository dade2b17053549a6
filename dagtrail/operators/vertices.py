"""Views of single event types: vertices, attempt starts, task finishes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagtrail import schemas as S
from dagtrail.functions.payload import is_llap, kv, op_type
from dagtrail.operators.callers import order_key


def vertices(events: DataFrame) -> DataFrame:
    """Vertex initializations with name, operation type, task count and LLAP flag."""
    inits = events.where(F.col("eventType") == S.VERTEX_INITIALIZED)
    name = kv("vertexName")
    return inits.select(
        "appId",
        "dagId",
        "vertexId",
        name.alias("vertexName"),
        op_type(name).alias("opType"),
        kv("numTasks").try_cast("bigint").alias("numTasks"),
        is_llap().alias("isLlap"),
        *S.ORDER,
    )


def latest_llap(inits: DataFrame) -> DataFrame:
    """The latest LLAP initialization of each vertex; later ones without LLAP do not count."""
    attributes = ["appId", "vertexName", "opType", "numTasks"]
    llap = inits.where(F.col("isLlap") & F.col("vertexId").isNotNull())
    latest = llap.groupBy("vertexId").agg(F.max_by(F.struct(*attributes), order_key()).alias("v"))
    return latest.select("vertexId", "v.*")


def llap_vertices(events: DataFrame) -> DataFrame:
    """LLAP vertices, one row each."""
    return latest_llap(vertices(events))


def attempt_starts(events: DataFrame) -> DataFrame:
    """The latest placement (node and container) of each attempt; an id not set is blank."""
    starts = events.where(F.col("eventType") == S.TASK_ATTEMPT_STARTED)
    attempt = F.coalesce("taskAttemptId", F.lit("")).alias("taskAttemptId")
    placed = starts.select(
        attempt, kv("nodeId").alias("nodeId"), kv("containerId").alias("containerId"), *S.ORDER
    )
    latest = placed.groupBy("taskAttemptId").agg(
        F.max_by(F.struct("nodeId", "containerId"), order_key()).alias("p")
    )
    return latest.select("taskAttemptId", "p.*")


def task_finishes(events: DataFrame) -> DataFrame:
    """Task finishes with duration, failed attempts and success flag.

    Text that is not a number fails the job, an absent value is 0.
    """
    finishes = events.where(F.col("eventType") == S.TASK_FINISHED)

    def number(name: str, kind: str):
        return F.coalesce(kv(name).cast(kind), F.lit(0).cast(kind)).alias(name)

    return finishes.select(
        "appId",
        "dagId",
        "vertexId",
        "taskId",
        number("timeTaken", "bigint"),
        number("numFailedTaskAttempts", "int").alias("failedAttempts"),
        kv("status").eqNullSafe(F.lit(S.SUCCEEDED)).alias("wasSuccessful"),
        *S.ORDER,
    )
