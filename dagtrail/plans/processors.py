"""Named processors: which events a report needs, and the report as a function of them."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagtrail import schemas as S
from dagtrail.functions.payload import blank
from dagtrail.operators.callers import delivered, filter_event_types
from dagtrail.operators.features import task_features
from dagtrail.operators.times import task_times
from dagtrail.sources.report import write_task_report, write_time_report


@dataclass(frozen=True)
class Processor:
    """A consumer of events.

    `event_types` are the events the report is made of, None for all. With
    `needs_callers` only events with a known caller are delivered, and with them the
    events that name the callers; entity logs have none, so such a processor refuses
    them. `joins_callers` says that the report drops events without a caller itself.
    """

    name: str
    event_types: list[str] | None
    fn: Callable[[DataFrame], DataFrame]
    write: Callable[[DataFrame, str, str], None] | None = None
    needs_callers: bool = False
    joins_callers: bool = False

    def names_delivered(self) -> bool:
        """Whether events that name callers are among those the report is made of."""
        return self.event_types is None or S.DAG_SUBMITTED in self.event_types

    def deliver(self, events: DataFrame) -> DataFrame:
        """The events the report is handed."""
        if not self.needs_callers:
            return filter_event_types(events, self.event_types)
        if self.joins_callers:
            return filter_event_types(events, [S.DAG_SUBMITTED, *self.event_types])
        handed = delivered(events, self.event_types).drop("callerId")
        naming = filter_event_types(events, [S.DAG_SUBMITTED])
        # of those only the ones without an application are not handed yet
        return handed.unionByName(naming.where(blank(F.col("appId"))) if self.names_delivered() else naming)

    def apply(self, events: DataFrame) -> DataFrame:
        return self.deliver(events).transform(self.fn)


processors: dict[str, Processor] = {}


def register(processor: Processor) -> Processor:
    processors[processor.name] = processor
    return processor


@contextmanager
def registered(processor: Processor) -> Iterator[Processor]:
    """Register a processor for the time being."""
    try:
        yield register(processor)
    finally:
        del processors[processor.name]


def find(name: str) -> Processor:
    if name not in processors:
        raise ValueError(f"unknown processor {name!r}, known are: {', '.join(sorted(processors))}")
    return processors[name]


register(Processor("task_features", S.FEATURE_TYPES, task_features, write_task_report))
register(Processor("task_times", S.TIME_TYPES, task_times, write_time_report, needs_callers=True, joins_callers=True))
