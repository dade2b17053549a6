"""Helpers the corpus operators share."""

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagtrail.operators.lookup import SLICE_ROWS, SLICE_ROWS_SETTING, SLICES_OF_ALL
from dagtrail.sources.paths import shared_folder

# Rows an Arrow function works on before it hands them on.
BATCH_ROWS = 2000
BLOCK_BYTES = 2 << 20
# Spark's own limit.
MAX_BUCKETS = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, whatever others there are."""
    return df.select(*[F.col(n) for n in names])


def sliced_join(rows: DataFrame, lookup: DataFrame, keys: list[str], identity: list[str], count: str) -> DataFrame:
    """Inner join of rows with a relation of one row per key that knows, in `count`, how many rows each key has.

    Rows of a key with more than a task should take are dealt over slices by a hash of their
    identity, and its lookup row is repeated for each slice.
    """
    least = int(rows.sparkSession.conf.get(SLICE_ROWS_SETTING, str(SLICE_ROWS)))
    total = F.coalesce(lookup.agg(F.sum(count).alias(count)).scalar(), F.lit(0))
    width = F.greatest(F.lit(least), F.ceil(total / F.lit(SLICES_OF_ALL)))
    slices = F.ceil(F.col(count) / width).cast("int").alias("_slices")
    # fewer than SLICES_OF_ALL keys
    hot = F.broadcast(lookup.where(F.col(count) > width).select(*keys, slices))
    dealt = F.when(F.col("_slices") > 1, F.pmod(F.xxhash64(*identity), F.col("_slices")).cast("int")).otherwise(0)
    sliced = rows.join(hot, keys, "left").withColumn("_slice", dealt).drop("_slices")
    again = F.explode(F.sequence(F.lit(0), F.greatest(slices, F.lit(1)) - 1))
    return sliced.join(lookup.withColumn("_slice", again), [*keys, "_slice"]).drop("_slice")


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Write rows to a new table in the shared folder, dealt over buckets by the key, and go on from that table.

    Later joins and groups on the key leave these rows where they are, however often, and only move the other side.
    The catalog names the table only while it is made; its files stay.
    """
    spark = df.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS)
    name = f"dagtrail_{label}_{uuid.uuid4().hex}"
    path = shared_folder(spark, label)
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"drop table {name}")
    return found


# What each operator's functions remember in this worker process, by the operator's name.
_remembered: dict[str, list[Callable[[], None]]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """Note how to drop what an operator remembers between tasks."""
    _remembered.setdefault(owner, []).append(forget)


def only(owner: str) -> None:
    """Called where a task begins: workers serve many stages, and remember for one operator at a time."""
    for name in [n for n in _remembered if n != owner]:
        for forget in _remembered.pop(name):
            forget()


def blocks(batches: Iterator[pa.RecordBatch], column: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about so many bytes of a column of strings or bytes, a single long one apart."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            for at in range(low, high, BATCH_ROWS):
                yield batch.slice(at, min(BATCH_ROWS, high - at))
