"""Token ids in ORC files, in ascending document order.

ORC stores integers run-length encoded in stripes that tasks read independently, with
minima, maxima and Bloom filters of document ids for each stripe and row group: a look-up
of some documents skips all other stripes. Beside the ids each row holds the number of the
task that wrote it and how many ids that task wrote before, so that a document's place in
the whole corpus follows from one total per task.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from dagtrail.llm.common import first_columns
from dagtrail.llm.encoding import ID_BYTES, encoder

STORED = "part int, doc_id long, before long, token_ids array<int>"
# Rows of a row group: fewer than ORC's default, as a row is a whole document.
ROW_INDEX_STRIDE = 1000
# Of texts that share an id, so many characters decide their order: bounds of ranges are kept on the driver.
TIE_CHARACTERS = 64


def encode_documents(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Token ids of each document, one id `end_id` after it, in ascending `doc_id` order.

    A null or empty text has the end alone; equal documents and equal ids stay; null ids
    come first; ties are in order of the first characters of the text, then of its hash. Very long
    texts are encoded whole; an empty table gives none. An id, and a text of it, that owns many rows
    is dealt over as many tasks as its share is worth.
    """
    rows = first_columns(documents, "doc_id", "text").withColumn("spread", F.monotonically_increasing_id())
    order = [F.col("doc_id"), F.substring("text", 1, TIE_CHARACTERS), F.xxhash64("text"), F.col("spread")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread")
    end = end_id.to_bytes(ID_BYTES, "little")

    def run(batches):
        encode = encoder(tokenizer)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.columns[0].to_pylist(), batch.columns[1]
            at = 0
            while at < len(ids):
                packed, first, size = [], at, 0
                while at < len(ids) and size < 4 << 20:
                    packed.append(encode.packed(texts[at].as_py()) + end)
                    size += len(packed[-1])
                    at += 1
                lengths = np.array([len(p) // ID_BYTES for p in packed], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                values = np.frombuffer(b"".join(packed), dtype="<i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(packed), part, dtype=np.int32)),
                        pa.array(ids[first:at], pa.int64()),
                        pa.array(before + offsets[:-1]),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)),
                    ],
                    names=["part", "doc_id", "before", "token_ids"],
                )
                before += int(offsets[-1])

    return ordered.mapInArrow(run, STORED)


def write_token_table(documents: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode documents and write them as ORC files."""
    encoded = encode_documents(documents, tokenizer, end_id)
    writer = encoded.write.option("orc.create.index", True).option("orc.row.index.stride", ROW_INDEX_STRIDE)
    writer = writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01)
    writer.orc(path)


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and token_ids of each document."""
    stored = spark.read.schema(STORED).orc(path)
    totals = stored.groupBy("part").agg(F.max(F.col("before") + F.size("token_ids")).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    # one row for each writing task, whose number the shuffle partitions set
    placed = stored.join(F.broadcast(starts), "part")
    return placed.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "token_ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids as little-endian unsigned 32-bit integers."""
    def run(batches):
        for batch in batches:
            ids = batch.column(2)
            offsets = ids.offsets.to_numpy()
            values = np.ascontiguousarray(ids.values.to_numpy(), dtype="<i4")
            data = memoryview(values).cast("B")
            crcs = [
                zlib.crc32(data[ID_BYTES * a : ID_BYTES * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
