"""JSON entity logs: text lines to the history-event schema."""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagtrail import schemas as S
from dagtrail.functions import entity as E
from dagtrail.sources.paths import count_files, require_directory, store_rows

FILE_GLOB = "entitylog-*"


def _candidate():
    """Cheap text test that every line with a wanted entity passes.

    The type is spelled out, or the line holds a \\u escape and could spell it that way.
    """
    spelled = [F.col("line").contains(text) for text in [*S.FEATURE_TYPES, "\\u"]]
    return reduce(or_, spelled)


def read_entity_lines(spark: SparkSession, path: str, file_glob: str = FILE_GLOB) -> DataFrame:
    """All lines of the entity logs below a directory, other files are left out."""
    require_directory(spark, path)
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_glob).text(path)
    )
    return lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("srcFile"))


def entities(lines: DataFrame) -> DataFrame:
    """One row per top-level JSON object: `entity` and its source file.

    `srcPos` numbers the objects in reading order, before anything is filtered out.
    A stream has no such order, there it stays NULL.
    """
    objects = lines.select("srcFile", F.explode(E.entities(F.col("line"))).alias("entity"))
    position = F.lit(None).cast("bigint") if lines.isStreaming else F.monotonically_increasing_id()
    return objects.withColumn("srcPos", position)


def to_events(lines: DataFrame) -> DataFrame:
    """Vertex starts, attempt starts and attempt finishes as history events."""
    typed = entities(lines.where(_candidate())).withColumn("eventType", E.event_type("entity"))
    wanted = typed.where(F.col("eventType").isin(S.FEATURE_TYPES))
    kind, name = F.col("entity.entitytype"), F.col("entity.entity")
    vertex = F.coalesce(F.when(kind == "TEZ_VERTEX_ID", name), E.single_filter("entity", "TEZ_VERTEX_ID"))
    return wanted.select(
        "eventType",
        E.event_time("entity").alias("eventTime"),
        E.single_filter("entity", "applicationId").alias("appId"),
        E.single_filter("entity", "TEZ_DAG_ID").alias("dagId"),
        vertex.alias("vertexId"),
        E.single_filter("entity", "TEZ_TASK_ID").alias("taskId"),
        F.when(kind == "TEZ_TASK_ATTEMPT_ID", name).alias("taskAttemptId"),
        E.pairs("entity").alias("eventData"),
        "srcFile",
        "srcPos",
    )


def read_ats(spark: SparkSession, path: str, file_glob: str = FILE_GLOB) -> DataFrame:
    """Entity logs below a directory as history events.

    The lines are parsed once, into a stored table: parsing is what costs, and positions are
    counted as lines are read, which two scans may do differently.
    """
    return store_rows(to_events(read_entity_lines(spark, path, file_glob)), "entity-events")


def entity_summary(lines: DataFrame, files: int | None = None) -> DataFrame:
    """Objects read, objects that are wanted events, and files they came from.

    `files` is the number of files read, empty ones too; without it the files that gave objects
    count.
    """
    rows = entities(lines).select("srcFile", E.event_type("entity").isin(S.FEATURE_TYPES).alias("wanted"))
    per_file = rows.groupBy("srcFile").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("wanted").alias("passed")
    )
    total, passed = F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("passed"), F.lit(0))
    found = F.count("srcFile") if files is None else F.lit(files).cast("bigint")
    return per_file.agg(
        total.alias("totalEvents"),
        passed.alias("passedEvents"),
        (total - passed).alias("rejectedEvents"),
        found.alias("foundFiles"),
    )


def ats_summary(spark: SparkSession, path: str, file_glob: str = FILE_GLOB) -> DataFrame:
    """The counts of the entity logs below a directory."""
    return entity_summary(read_entity_lines(spark, path, file_glob), count_files(spark, path, file_glob))
