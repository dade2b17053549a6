"""The task report on a growing input.

A vertex may start again and an attempt's start may arrive after its finish, so no row of
the report is final while events can follow. The stream therefore parses every event once
and appends it to a landing table, and the report is made from that table by the operator
that the batch uses: after each run it is what the batch would say of all that has arrived,
with no horizon beyond which events are forgotten and no state that grows in memory.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dagtrail import schemas as S
from dagtrail.operators.features import task_features
from dagtrail.sources.entitylog import FILE_GLOB, to_events
from dagtrail.sources.history import REJECTED, positioned, read_history, write_history
from dagtrail.sources.paths import require_directory


def stream_history(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Events of a growing directory of event tables, in the batch schema.

    JSON records that do not fit carry their text in a column more; see `write_stream`.
    """
    require_directory(spark, path)
    reader = spark.readStream.option("recursiveFileLookup", True)
    if file_format == "parquet":
        return positioned(reader.schema(S.ddl(S.HISTORY_EVENT)).parquet(path))
    if file_format == "json":
        schema = S.ddl({**S.HISTORY_EVENT, REJECTED: "string"})
        events = reader.schema(schema).option("columnNameOfCorruptRecord", REJECTED).json(path)
        return events.withColumn("srcFile", F.coalesce("srcFile", F.col("_metadata.file_path")))
    raise ValueError(f"unknown file format {file_format!r}, expected parquet or json")


def stream_ats(spark: SparkSession, path: str, file_glob: str = FILE_GLOB) -> DataFrame:
    """Events of a growing directory of entity logs."""
    require_directory(spark, path)
    lines = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", file_glob).text(path)
    return to_events(lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("srcFile")))


def write_stream(
    events: DataFrame, landing: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Append events to a landing table, each batch of them in a folder of its own.

    A batch that is run again replaces what it wrote. A file arrives in one batch as a whole,
    so positions counted there rise along it. Records that do not fit are kept beside the
    table, in the folder with `-rejected` at its end.

    Without an interval the query takes what is there and ends; started again with the same
    checkpoint it goes on where it stopped.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        counted = batch.withColumn("srcPos", F.coalesce("srcPos", F.monotonically_increasing_id()))
        if REJECTED in batch.columns:
            odd = counted.where(F.col(REJECTED).isNotNull()).select("srcFile", "srcPos", REJECTED)
            odd.write.mode("overwrite").parquet(f"{landing}-rejected/batch-{batch_id}")
            counted = counted.where(F.col(REJECTED).isNull())
        write_history(counted, f"{landing}/batch-{batch_id}")

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = events.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def landed_events(spark: SparkSession, landing: str) -> DataFrame:
    """All events that have arrived."""
    return read_history(spark, landing, has_positions=True)


def stream_task_features(events: DataFrame, landing: str, checkpoint: str) -> DataFrame:
    """Take what has arrived, and the task report of all events so far."""
    write_stream(events, landing, checkpoint).awaitTermination()
    return task_features(landed_events(events.sparkSession, landing))
