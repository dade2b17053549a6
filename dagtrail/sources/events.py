"""Choice of the source layout."""

from pyspark.sql import DataFrame, SparkSession

from dagtrail.sources.entitylog import read_ats
from dagtrail.sources.history import read_history

LAYOUTS = ("history", "ats")


def read_events(spark: SparkSession, path: str, layout: str = "history", **options) -> DataFrame:
    """Events of either layout, in the same schema."""
    if layout == "history":
        return read_history(spark, path, **options)
    if layout == "ats":
        return read_ats(spark, path, **options)
    raise ValueError(f"unknown source layout {layout!r}, expected one of {', '.join(LAYOUTS)}")
