"""Reading and writing the reports."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagtrail import schemas as S
from dagtrail.operators.stats import WHOLE, succ_task_events
from dagtrail.sources.paths import replaced_folder, require_directory


# Text as the report database loads it: quotes are doubled, blank is unknown.
TEXT_OPTIONS = {"sep": "|", "header": True, "escape": '"', "emptyValue": ""}


def _write(df: DataFrame, path: str, file_format: str) -> None:
    if file_format not in ("csv", "parquet"):
        raise ValueError(f"unknown report format {file_format!r}, expected parquet or csv")
    options = TEXT_OPTIONS if file_format == "csv" else {}
    with replaced_folder(df.sparkSession, path) as written:
        df.write.format(file_format).options(**options).save(written)


def write_task_report(report: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write the 32 report columns; text reports are pipe-separated with a title line.

    Values that hold a pipe are quoted. Unknown values are blank in text.
    """
    rows = report.select(*S.REPORT_COLUMNS)
    if file_format == "csv":
        rows = rows.withColumnsRenamed(S.REPORT_TITLES)
    _write(rows, path, file_format)


def read_task_report(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    """Load a task report. In text, columns count by position and blanks are NULL."""
    require_directory(spark, path)
    reader = spark.read.schema(S.TASK_REPORT)
    if file_format == "csv":
        return reader.options(**TEXT_OPTIONS).csv(path)
    return reader.parquet(path)


def write_time_report(times: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write the time report; the date of the report is a column."""
    rows = times.select(*S.TIME_COLUMNS, F.current_timestamp().alias("generated_at"))
    _write(rows, path, file_format)


def write_time_detail(detail: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write the optional list of counted tasks."""
    _write(detail.select(*S.DETAIL_COLUMNS), path, file_format)


def create_report_tables(report: DataFrame, database: str) -> None:
    """Recreate the analysis tables of a database and collect their statistics.

    `taskevents` holds the report, `succtaskevents` the succeeded attempts, kept as a
    table because most questions start from them. `averagesbynode` is a view of mean and
    deviation of their durations for each node and task type.

    New tables are written and measured beside the old ones and renamed once all are complete,
    so a job that fails before leaves the old ones.
    """
    spark = report.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    mark = uuid.uuid4().hex
    names = ("taskevents", "succtaskevents")
    try:
        report.write.format("parquet").saveAsTable(f"{database}.taskevents_{mark}")
        stored = spark.table(f"{database}.taskevents_{mark}")
        succ_task_events(stored).write.format("parquet").saveAsTable(f"{database}.succtaskevents_{mark}")
        for name in names:
            spark.sql(f"ANALYZE TABLE {database}.{name}_{mark} COMPUTE STATISTICS FOR ALL COLUMNS")
    except BaseException:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}_{mark}")
        raise
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(f"ALTER TABLE {database}.{name}_{mark} RENAME TO {database}.{name}")
    # as in functions.moments: doubles only where 38 digits do not hold the exact numbers
    n, value = "cast(count(taskDurationMillis) as decimal(19,0))", "cast(taskDurationMillis as decimal(19,0))"
    total, squares = "cast(sum(taskDurationMillis) as decimal(19,0))", f"sum({value} * {value})"
    exact = f"cast(try_subtract(try_multiply({n}, {squares}), {total} * {total}) AS double)"
    rough = f"cast({n} AS double) * cast({squares} AS double) - power(cast({total} AS double), 2)"
    spark.sql(
        f"""CREATE OR REPLACE VIEW {database}.averagesbynode AS
            SELECT hostname, taskType, count(*) AS tasksInType,
                   cast(avg(taskDurationMillis) AS {WHOLE}) AS avg,
                   cast(sqrt(coalesce({exact}, greatest({rough}, 0))) / count(taskDurationMillis) AS {WHOLE}) AS stddev
              FROM {database}.succtaskevents
             GROUP BY hostname, taskType"""
    )
