"""Joins with a lookup relation that stay balanced when one key owns most rows."""

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from dagtrail.sources.paths import store_rows

# A key with more rows than this is cut into slices of about this many rows.
SLICE_ROWS = 1_000_000
SLICE_ROWS_SETTING = "spark.dagtrail.sliceRows"

# A slice is no smaller than this part of all rows, so that fewer keys than this can need
# slices. That bounds what is broadcast, and no key has to be left out.
SLICES_OF_ALL = 100_000


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys with too many rows for one task, and the number of slices each needs.

    Rows are counted at once, in one pass that also gives their total; only keys of more than a
    slice are stored, so that joins on the key can share them without counting again.
    """
    slice_rows = int(rows.sparkSession.conf.get(SLICE_ROWS_SETTING, str(SLICE_ROWS)))
    counted = Observation()
    weights = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).observe(counted, F.sum("_rows").alias("total"))
    large = store_rows(weights.where(F.col(key).isNotNull() & (F.col("_rows") > slice_rows)), "hot-keys")
    width = max(slice_rows, math.ceil((counted.get["total"] or 0) / SLICES_OF_ALL))
    return large.where(F.col("_rows") > width).select(key, F.ceil(F.col("_rows") / width).cast("int").alias("_slices"))


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    identity: list[str],
    weigh: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Inner join of rows with a relation that has at most one row per key.

    Rows of a hot key are spread over slices by a hash of their identity, and only the
    lookup rows of hot keys are repeated, once per slice. All other keys join as usual.
    The plan is the same at every size, and whether the lookup is broadcast is left to
    Spark, which measures it at run time.

    Keys are counted in `weigh` where that is cheaper to scan than `rows`; it must
    hold all of them. Joins of one report on the same key share what `hot_keys` gives, in `hot`.
    """
    if hot is None:
        hot = hot_keys(rows if weigh is None else weigh, key)
    # fewer than SLICES_OF_ALL keys
    hot = F.broadcast(hot)
    slices = F.coalesce("_slices", F.lit(1))
    sliced_rows = rows.join(hot, key, "left").withColumn(
        "_slice", F.when(slices > 1, F.pmod(F.xxhash64(*identity), slices).cast("int")).otherwise(0)
    )
    sliced_lookup = lookup.join(hot, key, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), slices - 1))
    )
    return sliced_rows.drop("_slices").join(sliced_lookup.drop("_slices"), [key, "_slice"]).drop("_slice")
