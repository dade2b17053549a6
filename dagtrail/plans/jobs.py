"""Jobs: from an input directory to a written report."""

import argparse
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from dagtrail import schemas as S
from dagtrail.operators.callers import ONE_TASK_ROWS, delivered, filter_event_types, ingest_summary, limited_events
from dagtrail.operators.features import lost_counters
from dagtrail.operators.times import time_detail
from dagtrail.plans.processors import Processor, find, processors
from dagtrail.sources.entitylog import ats_summary, read_ats
from dagtrail.sources.history import event_folder, read_history, read_until, stage_events
from dagtrail.sources.paths import count_files, removed_afterwards
from dagtrail.sources.report import write_time_detail


def _limited(processor: Processor, events: DataFrame, limit: int, one_task_rows: int) -> DataFrame:
    """At most `limit` of the events the processor is handed.

    Where callers count, the limit is on events with a known caller, and the events
    that name the callers come on top, unless they have been handed already. That takes
    all files, as any of them may name a caller.
    """
    if not processor.needs_callers:
        return limited_events(filter_event_types(events, processor.event_types), limit, one_task_rows=one_task_rows)
    handed = delivered(events, processor.event_types).drop("callerId")
    handed = stage_events(limited_events(handed, limit, one_task_rows=one_task_rows))
    naming = filter_event_types(events, [S.DAG_SUBMITTED])
    if processor.names_delivered():
        naming = naming.join(handed.select(*S.IDENTITY), S.IDENTITY, "left_anti")
    return handed.unionByName(naming)


def run_job(
    spark: SparkSession,
    processor: str,
    input_path: str,
    output_path: str,
    ats: bool = False,
    limit: int | None = None,
    output_format: str = "parquet",
    summary_path: str | None = None,
    detail_path: str | None = None,
    lost_path: str | None = None,
    one_task_rows: int = ONE_TASK_ROWS,
    **source_options,
) -> None:
    """Read events, apply a processor and write its report.

    Events lie in the input directory or, beside a manifest, in `dag_data` below it. A
    limited input is stored, so that every side of a report sees the same events. What is
    stored on the way is removed once the report is written, or the job has failed.

    `summary_path` gets the counts of all that was read, `detail_path` the tasks that the time
    report counts, `lost_path` the counters whose values the task report cannot hold. Without a
    summary, a limit opens only as many event files as it takes.
    """
    chosen = find(processor)
    if chosen.write is None:
        raise ValueError(f"processor {processor!r} has no writer")
    if ats and chosen.needs_callers:
        raise ValueError(f"processor {processor!r} needs callers, which entity logs do not hold")
    limited = limit is not None and limit > 0
    with removed_afterwards(spark):
        if ats:
            events = read_ats(spark, input_path, **source_options)
        else:
            input_path = event_folder(spark, input_path)
            if limited and not (chosen.needs_callers or summary_path):
                wanted = partial(filter_event_types, types=chosen.event_types)
                events = read_until(
                    spark, input_path, limit, wanted, one_task_rows=one_task_rows, **source_options
                )
            else:
                events = read_history(spark, input_path, **source_options)
        if summary_path:
            summary = (
                ats_summary(spark, input_path, **source_options)
                if ats
                else ingest_summary(events, chosen.event_types, count_files(spark, input_path))
            )
            summary.write.mode("overwrite").json(summary_path)
        if limited:
            # a second limit of the same number takes nothing away
            events = stage_events(_limited(chosen, events, limit, one_task_rows))
        chosen.write(chosen.apply(events), output_path, output_format)
        if lost_path:
            lost_counters(events).write.mode("overwrite").json(lost_path)
        if detail_path:
            write_time_detail(time_detail(events), detail_path, output_format)


def main(arguments: list[str] | None = None) -> None:
    """Entry point for spark-submit."""
    parser = argparse.ArgumentParser(prog="dagtrail", description="reports on task history events")
    parser.add_argument("processor", choices=sorted(processors))
    parser.add_argument("-i", "--input", required=True, help="directory with the events")
    parser.add_argument("-o", "--output", required=True, help="directory of the report")
    parser.add_argument("-a", "--ats", action="store_true", help="the input is JSON entity logs")
    parser.add_argument("-l", "--limit", type=int, default=0, help="at most this many events, 0 for all")
    parser.add_argument("-f", "--format", choices=("parquet", "csv"), default="csv")
    parser.add_argument("-j", "--json", action="store_true", help="event tables are JSON rather than Parquet")
    parser.add_argument("-s", "--summary", help="directory of the run's counts")
    parser.add_argument("-d", "--detail", help="directory of the tasks that the time report counts")
    parser.add_argument("-c", "--lost", help="directory of the counters that the task report cannot hold")
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"dagtrail {args.processor}").getOrCreate()
    source = {"file_format": "json"} if args.json else {}
    run_job(
        spark, args.processor, args.input, args.output, args.ats, args.limit, args.format,
        summary_path=args.summary, detail_path=args.detail, lost_path=args.lost, **source,
    )
