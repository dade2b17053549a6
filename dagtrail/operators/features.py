"""The wide report: one row of counters per finished LLAP task attempt."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagtrail import schemas as S
from dagtrail.functions.payload import counter_texts, kv, with_counters
from dagtrail.operators.lookup import hot_keys, lookup_join
from dagtrail.operators.vertices import attempt_starts, llap_vertices


# What tells two finishes apart: the attempt, and the place in the order of events.
FINISH = ["taskAttemptId", *S.ORDER]


def attempt_finishes(events: DataFrame) -> DataFrame:
    """Attempt finishes; what tells them apart is never NULL, an id not set is blank."""
    unset = {"taskAttemptId": "", "eventTime": 0, "srcFile": "", "srcPos": -1}
    finishes = events.where(F.col("eventType") == S.TASK_ATTEMPT_FINISHED)
    return finishes.withColumns({c: F.coalesce(c, F.lit(unset[c])) for c in FINISH})


def _ids(events: DataFrame) -> DataFrame:
    """Vertex ids of all attempt finishes: enough to weigh the join without reading payloads."""
    return events.where(F.col("eventType") == S.TASK_ATTEMPT_FINISHED).select("vertexId")


def placements(events: DataFrame, names: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Node and container of the first finish of each LLAP attempt, one row per attempt.

    A start belongs to the first finish of its attempt only. That finish is found by an
    aggregate: no window is needed, and an attempt id with very many finishes is no hot key.
    """
    keys = attempt_finishes(events).select("vertexId", *FINISH)
    llap = lookup_join(keys, names.select("vertexId"), "vertexId", FINISH, _ids(events), hot)
    first = llap.groupBy("taskAttemptId").agg(F.min(F.struct(*S.ORDER)).alias("first"))
    return first.join(attempt_starts(events), "taskAttemptId").select(
        "taskAttemptId",
        *[F.col(f"first.{c}").alias(c) for c in S.ORDER],
        F.col("nodeId").alias("nodeID"),
        F.col("containerId").alias("contID"),
    )


def task_features(events: DataFrame) -> DataFrame:
    """The task report, one row per finished LLAP attempt.

    Counters are read before the joins, so that a row moves as 22 numbers rather than
    as a JSON text. Both joins meet relations of one row per key, so no row is ever
    multiplied, not even where nothing tells finishes apart; such finishes of one attempt
    share its placement.
    """
    finishes = attempt_finishes(events).select(
        *FINISH,
        "vertexId",
        F.col("appId").alias("applID"),
        F.col("dagId").alias("dagID"),
        F.col("taskId").alias("taskID"),
        kv("status").alias("status"),
        "eventData",
    )
    names = llap_vertices(events).select("vertexId", "vertexName", F.col("numTasks").alias("vertexNumTasks"))
    hot = hot_keys(_ids(events), "vertexId")
    named = lookup_join(with_counters(finishes), names, "vertexId", FINISH, hot=hot)
    rows = named.withColumnRenamed("vertexId", "vertexID").join(placements(events, names, hot), FINISH, "left")
    return rows.select(*S.REPORT_COLUMNS)


def lost_counters(events: DataFrame) -> DataFrame:
    """Counter and number of its values that the report has as NULL though they are there:
    fractions, and numbers beyond 64 bits."""
    names = [S.DURATION_COUNTER, *S.REPORT_COUNTERS.values()]
    texts = counter_texts(kv("counters"), names)
    wanted = F.array(*[F.lit(n) for n in names])
    finishes = events.where(F.col("eventType") == S.TASK_ATTEMPT_FINISHED)
    values = finishes.select(F.explode(F.map_from_arrays(wanted, texts)).alias("counter", "value"))
    lost = values.where(F.col("value").isNotNull() & F.col("value").try_cast("bigint").isNull())
    return lost.groupBy("counter").agg(F.count(F.lit(1)).alias("lost"))
