"""History events and manifest entries as tables."""

import math
import re
from collections.abc import Callable
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagtrail import schemas as S
from dagtrail.operators.callers import ONE_TASK_ROWS, limited_events
from dagtrail.sources.paths import is_directory, require_directory, shared_folder, store_rows

FORMATS = ("parquet", "json")
# At most this many files are listed to one scan that reads until enough events are found.
MOST_FILES = 10_000
# A Parquet file without rows is smaller than this; only such files are looked into for their end.
EMPTY_BYTES = 1 << 16
# The text of a JSON record that does not fit the schema.
REJECTED = "rejectedRecord"


def _reader(spark: SparkSession, file_format: str, skip_damaged_files: bool):
    if file_format not in FORMATS:
        raise ValueError(f"unknown file format {file_format!r}, expected one of {', '.join(FORMATS)}")
    reader = spark.read.option("recursiveFileLookup", True)
    if skip_damaged_files:
        reader = reader.option("ignoreCorruptFiles", True)
    if file_format == "json":
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECTED)
    return reader


def positioned(events: DataFrame) -> DataFrame:
    """Fill `srcFile` and `srcPos` of Parquet events that do not carry them: file and row index."""
    filled = {
        "srcFile": F.coalesce("srcFile", F.col("_metadata.file_path")),
        "srcPos": F.coalesce("srcPos", F.col("_metadata.row_index")),
    }
    return events.select(*[filled.get(c, F.col(c)).alias(c) for c in S.HISTORY_EVENT])


def _require(spark: SparkSession, path: str | list[str]) -> None:
    """One path must be a directory; listed files are taken as they are."""
    if isinstance(path, str):
        require_directory(spark, path)


def _json_records(spark: SparkSession, path: str | list[str], columns: dict[str, str], skip_damaged_files: bool) -> DataFrame:
    """All records of JSON files with their positions, those that do not fit too, parsed once.

    Positions count records as they are read. That must happen once: two scans may split files
    differently. So the records are stored, and everything goes on from the stored table.
    """
    _require(spark, path)
    reader = _reader(spark, "json", skip_damaged_files).schema(S.ddl({**columns, REJECTED: "string"}))
    return reader.json(path)


def read_json_history(
    spark: SparkSession, path: str | list[str], skip_damaged_files: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Events of JSON files, and the records that are none: file, position and text.

    A record whose parts have other types than events have is rejected as a whole, as is the
    half line of a writer that died; the records around it count.
    """
    raw = _json_records(spark, path, S.HISTORY_EVENT, skip_damaged_files)
    filled = {
        "srcFile": F.coalesce("srcFile", F.col("_metadata.file_path")),
        "srcPos": F.coalesce("srcPos", F.monotonically_increasing_id()),
    }
    columns = [filled.get(c, F.col(c)).alias(c) for c in S.HISTORY_EVENT]
    stored = store_rows(raw.select(*columns, REJECTED), "json-history")
    events = stored.where(F.col(REJECTED).isNull()).select(*S.HISTORY_EVENT)
    return events, stored.where(F.col(REJECTED).isNotNull()).select("srcFile", "srcPos", REJECTED)


def read_history(
    spark: SparkSession,
    path: str | list[str],
    file_format: str = "parquet",
    skip_damaged_files: bool = False,
    has_positions: bool = False,
) -> DataFrame:
    """Scan all history events below a directory, or of listed files; absent columns are NULL.

    `skip_damaged_files` keeps what was read of a file that ends early instead of
    failing the job. `has_positions` says that every event carries `srcFile` and
    `srcPos`, as in tables written here, so that none have to be made up. JSON is parsed
    once, into a stored table; see `read_json_history` for what it rejects.
    """
    if file_format == "json":
        return read_json_history(spark, path, skip_damaged_files)[0]
    reader = _reader(spark, file_format, skip_damaged_files).schema(S.ddl(S.HISTORY_EVENT))
    _require(spark, path)
    events = reader.parquet(*([path] if isinstance(path, str) else path))
    return events if has_positions else positioned(events)


def file_status(spark: SparkSession, path: str) -> DataFrame:
    """Each Parquet file of a history: bytes, events stated and readable, whether it is damaged.

    What a file states is in its footer; a scan of no columns reads that alone. What is readable
    is what `skip_damaged_files` keeps of all columns, with a checksum of it that does not depend on
    order. A file is damaged if it has no footer, as after a writer that died, or fewer events than it
    states. Files without events are told apart by their end.
    """
    require_directory(spark, path)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_literal(path))
    file = F.col("_metadata.file_path").alias("srcFile")
    listed = listing.select(file, F.col("length").alias("bytes"))
    small = listing.where(F.col("length") <= EMPTY_BYTES)
    ended = small.select(file, F.expr("substring(content, -4) = X'50415231'").alias("ended"))
    scan = _reader(spark, "parquet", True).schema(S.ddl(S.HISTORY_EVENT)).parquet(_literal(path))
    stated = scan.groupBy(file).agg(F.count(F.lit(1)).alias("statedEvents"))
    readable = scan.groupBy(file).agg(
        F.count(F.lit(1)).alias("events"), F.bit_xor(F.xxhash64(*S.HISTORY_EVENT)).alias("checksum")
    )
    all_files = listed.join(stated, "srcFile", "left").join(readable, "srcFile", "left").join(ended, "srcFile", "left")
    events = F.coalesce("events", F.lit(0))
    return all_files.select(
        "srcFile",
        "bytes",
        "statedEvents",
        events.alias("events"),
        "checksum",
        F.when(F.col("statedEvents").isNull(), ~F.coalesce("ended", F.lit(False)))
        .otherwise(events < F.col("statedEvents"))
        .alias("damaged"),
    )


def _literal(path: str) -> str:
    """A path that scans don't take for a pattern."""
    return re.sub(r"([][{}*?\\])", r"\\\1", path)


def read_until(
    spark: SparkSession,
    path: str,
    limit: int,
    keep: Callable[[DataFrame], DataFrame] = lambda events: events,
    order: list[str] | None = None,
    one_task_rows: int = ONE_TASK_ROWS,
    **source_options,
) -> DataFrame:
    """At most `limit` of the events that `keep` lets through, opening no more files than it takes.

    Files are read in the order of their names, in batches: the first has a file for each task
    slot, each later one as many as the files so far let expect. What passed is stored, so no file
    is read twice. `order` is that among the events of the files read; by `srcFile` and `srcPos`, where
    both were made up, these are the same events as in a scan of all files. Fewer events than `limit`
    take all files; a directory without files gives none.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    require_directory(spark, path)
    # paths alone: nothing of a file is read
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_literal(path))
    names = (_literal(row.path) for row in listed.select("path").sort("path").toLocalIterator())
    stored, opened, found = [], 0, 0
    size = spark.sparkContext.defaultParallelism
    while found < limit and (files := list(islice(names, size))):
        stored.append(store_rows(keep(read_history(spark, files, **source_options)), "until"))
        opened, found = opened + len(files), found + stored[-1].count()
        # a quarter more than expected, or twice what gave nothing
        expected = math.ceil(1.25 * (limit - found) * opened / found) if found else 2 * opened
        size = min(max(expected, 1), MOST_FILES)
    if not stored:
        return keep(read_history(spark, [_literal(path)], **source_options))
    return limited_events(reduce(DataFrame.unionByName, stored), limit, order, one_task_rows)


def write_history(events: DataFrame, path: str) -> None:
    """Write events as a Parquet landing table.

    Rows are clustered by event type inside each file, without a shuffle, so the row
    groups a type filter does not need are skipped by their statistics.
    """
    rows = events.select(*S.HISTORY_EVENT)
    rows.sortWithinPartitions("eventType").write.mode("overwrite").parquet(path)


def stage_events(events: DataFrame, label: str = "events") -> DataFrame:
    """Store events once in the shared folder and go on from the stored table."""
    spark = events.sparkSession
    path = shared_folder(spark, label)
    write_history(events, path)
    return read_history(spark, path, has_positions=True)


# Events and manifest below a base directory.
EVENTS_BELOW, MANIFEST_BELOW = "dag_data", "query_data"


def event_folder(spark: SparkSession, path: str) -> str:
    """Where the events of a base directory lie; the directory itself, if it is none."""
    below = f"{path.rstrip('/')}/{EVENTS_BELOW}"
    return below if is_directory(spark, below) else path


def read_base(spark: SparkSession, path: str, file_format: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Events and manifest entries below a base directory."""
    events = read_history(spark, event_folder(spark, path), file_format)
    return events, read_manifest(spark, f"{path.rstrip('/')}/{MANIFEST_BELOW}", file_format)


def read_manifest(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Scan manifest entries; damaged files are skipped, as this input is optional.

    JSON records that do not fit are left out.
    """
    if file_format == "json":
        records = store_rows(_json_records(spark, path, S.MANIFEST, True), "json-manifest")
        return records.where(F.col(REJECTED).isNull()).select(*S.MANIFEST)
    reader = _reader(spark, file_format, skip_damaged_files=True)
    require_directory(spark, path)
    return reader.schema(S.ddl(S.MANIFEST)).parquet(path)
