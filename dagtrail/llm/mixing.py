"""Mixing sources to target weights by Poisson replication.

A source whose share of the text should change by the factor r is repeated r times on average:
each document draws its number of copies from the Poisson distribution of mean r, by
inverting it at a number that a hash of seed and document gives. So every document decides
for itself, again the same way in each run, and no counts per source have to be met.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dagtrail.sources.paths import store_rows

ALPHA = 0.5
SEED = 42
# A mean beyond this is the sum of several draws, so that exp(-mean) stays a normal number.
MEAN_OF_A_DRAW = 400
# Sources whose rates are sent to all tasks; more of them are joined in slices.
MAX_SENT_SOURCES = 10_000
SLICES = 64


def _hashed(digits: int, *parts: Column) -> Column:
    """The first hexadecimal digits of the parts' MD5, as a number."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1, neither included, by hash of the parts."""
    return (_hashed(13, *parts) + F.lit(0.5)) / F.lit(float(1 << 52))


def temperature_weights(sizes: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """source and weight: its size to the power of alpha, which lifts small sources."""
    return sizes.select("source", F.pow(F.col("size").cast("double"), F.lit(alpha)).alias("weight"))


def source_sizes(documents: DataFrame) -> DataFrame:
    """source and size in code points of its texts; a null source is a source of its own."""
    return documents.groupBy("source").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("size"))


def repetition_rates(sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """source and rate: target share by present share, so that the size of the whole stays.

    A source without a weight gets none and is left out; one without text keeps its rows once
    on average.
    """
    known = sizes.join(weights.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    known = known.select("source", "size", "weight")
    with_text = known.where("size > 0")
    weights_in_all = with_text.agg(F.sum("weight").alias("weights")).scalar()
    size_in_all = with_text.agg(F.sum("size").alias("sizes")).scalar()
    share = (F.col("weight") / weights_in_all) / (F.col("size") / size_in_all)
    return known.select("source", F.when(F.col("size") > 0, share).otherwise(F.lit(1.0)).alias("rate"))


def _tables(rates: DataFrame) -> DataFrame:
    """With each rate the number of draws, and the distribution function of one."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_OF_A_DRAW)).cast("int")
    mean = F.col("rate") / F.col("draws")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    state = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("upto"))

    def step(so_far: Column, k: Column) -> Column:
        p = so_far["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.array_append(so_far["upto"], F.element_at(so_far["upto"], -1) + p).alias("upto"))

    table = F.aggregate(F.sequence(F.lit(1), F.col("last")), state, step, lambda s: s["upto"])
    known = rates.withColumn("draws", draws).withColumn("mean", mean).withColumn("last", last)
    return known.select(F.col("source").alias("_source"), "draws", table.alias("upto"))


def copies(key: Column, seed: int, draws: Column, upto: Column) -> Column:
    """How many copies: the distribution inverted at the hash of each draw."""

    def drawn(number: Column) -> Column:
        at = uniform(F.lit(seed), key, number)
        return F.size(F.filter(upto, lambda below: below < at))

    return F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda total, number: total + drawn(number))


def content_key(columns: list[str]) -> Column:
    """A hash of all columns; rows share it only if they are alike."""
    own = [F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("", *own))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with _key, the hash of their columns, and _nth, their number among those that are alike.

    Where no two rows are alike, which keys alone tell, rows stay where they are. Else they are
    stored and counted by key and task, so that copies of one row are dealt over tasks.
    """
    keyed = rows.withColumn("_key", content_key(rows.columns))
    if keyed.groupBy("_key").count().where("count > 1").isEmpty():
        return keyed.withColumn("_nth", F.lit(1).cast("long"))
    stored = store_rows(keyed.withColumn("_task", F.spark_partition_id()), "keyed")
    # a row for each key and task
    sizes = stored.groupBy("_key", "_task").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy("_key").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_key", "_task", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_key", "_task").orderBy("_key"))
    found = stored.withColumn("_own", own).join(before, ["_key", "_task"])
    return found.select(*rows.columns, "_key", (F.col("_own") + F.col("_before")).alias("_nth"))


def mix(
    documents: DataFrame,
    weights: DataFrame | None = None,
    alpha: float = ALPHA,
    seed: int = SEED,
) -> DataFrame:
    """Documents repeated to the target weights, in an order shuffled globally.

    All columns of documents, then copy (from 1) and place (what the order is by). `weights` has
    source and weight, any positive numbers; without it they are the sizes to the power of `alpha`.
    Rows draw by the hash of all their columns and, where some are alike, by their number among
    these: an id or a text that many rows share is no hot key, and meets its weight. A null text
    counts as empty. Very long texts move whole. An empty table gives none.
    """
    rows = documents.drop("copy", "place")
    sizes = store_rows(source_sizes(rows), "sizes")
    rates = repetition_rates(sizes, temperature_weights(sizes, alpha) if weights is None else weights)
    tables = store_rows(_tables(rates), "rates")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if tables.count() <= MAX_SENT_SOURCES:
        known = numbered(rows).join(F.broadcast(tables), same)
    else:
        sliced = tables.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
        own = numbered(rows).withColumn("_slice", F.pmod(F.xxhash64("_key", "_nth"), F.lit(SLICES)).cast("int"))
        known = own.join(sliced, same & (F.col("_slice") == F.col("_part")))
    key = F.concat_ws(":", "_key", F.col("_nth").cast("string"))
    number = copies(key, seed, F.col("draws"), F.col("upto"))
    repeated = known.withColumn("copy", F.explode(F.sequence(F.lit(0), number))).where("copy > 0")
    placed = repeated.withColumn("place", _hashed(15, F.lit(seed), key, F.col("copy")))
    shuffled = placed.select(*[F.col(c) for c in rows.columns], "copy", "place").repartition("place")
    return shuffled.sortWithinPartitions("place")
