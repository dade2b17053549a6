"""Token counts of flat token files that have no index: a scan for separators in blocks.

A file is a sequence of unsigned 16-bit little-endian identifiers and nothing else; the
identifier 0 ends a document, all others are vocabulary ids plus one. Files are cut into
blocks that tasks read independently. Each block is searched for separators at once; its
first document may have begun in any block before, which a prefix maximum over the last
separators of the blocks tells, as a prefix sum of their numbers gives the document's number.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagtrail.llm.common import first_columns
from dagtrail.llm.encoding import encoder
from dagtrail.sources.paths import store_rows

ID = np.dtype("<u2")
SEPARATOR = 0
BLOCK_BYTES = 8 * 1024 * 1024
_ENDS = "file string, block int, nth int, began long, ended long"


def write_token_files(documents: DataFrame, path: str, tokenizer: str) -> None:
    """Write the ids of each text and a separator after it, a file for each task.

    A null or empty text is a separator alone. Spark's text writer puts the bytes of a row and the
    separator's two bytes, which are a valid line end, so files are committed like any others. Very long
    texts are encoded whole and repeated rows written each; an empty table gives no tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        if encode.tokenizer.get_vocab_size() >= 1 << 16:
            raise ValueError("the vocabulary does not fit into 16 bits")
        for batch in batches:
            packed, size = [], 0
            for text in batch.column(0):
                ids = np.frombuffer(encode.packed(text.as_py()), dtype="<u4")
                packed.append((ids + 1).astype(ID).tobytes())
                size += len(packed[-1])
                if size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["packed"])
                    packed, size = [], 0
            if packed:
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["packed"])

    rows = first_columns(documents, "text").mapInArrow(run, "packed binary")
    rows.select(F.col("packed").cast("string").alias("value")).write.option("lineSep", "\0\0").text(path)


def _blocks(spark: SparkSession, path: str, block_bytes: int) -> DataFrame:
    """file, block, offset and length in bytes of each block; contents are not read here."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    whole = files.select("file", (F.col("length") - F.col("length") % ID.itemsize).alias("length")).where("length > 0")
    last = F.floor((F.col("length") - 1) / block_bytes).cast("int")
    blocks = whole.withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    offset = F.col("block").cast("long") * block_bytes
    size = F.least(F.lit(block_bytes), F.col("length") - offset)
    return blocks.select("file", "block", offset.alias("offset"), size.alias("size")).repartition("file", "block")


def _open(uri: str):
    """The file of a URI as Spark gives it."""
    scheme, _, rest = uri.partition(":")
    known = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    system, path = fs.FileSystem.from_uri(f"{known}:{rest}" if rest.startswith("//") else f"{known}://{rest}")
    return system.open_input_file(path)


def document_ends(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each separator: file, block, number in the block, where its document began
    (null for the block's first) and where it ended, as places in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(file) as source:
                    ids = np.frombuffer(source.read_at(size, offset), dtype=ID)
                ended = np.flatnonzero(ids == SEPARATOR) + offset // ID.itemsize
                if not len(ended):
                    continue
                n = len(ended)
                first = np.zeros(n, dtype=bool)
                first[0] = True
                began = np.concatenate([[0], ended[:-1] + 1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * n),
                        pa.array(np.full(n, block, dtype=np.int32)),
                        pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(began, mask=first),
                        pa.array(ended),
                    ],
                    names=[c.split()[0] for c in _ENDS.split(", ")],
                )

    return _blocks(spark, path, block_bytes).mapInArrow(run, _ENDS)


def token_counts(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, document (its number in the file, from 0), start, n_tokens and complete of each document.

    Tokens after a file's last separator are a last, incomplete document. Empty files have none; a
    last odd byte is left out.
    """
    ends = store_rows(document_ends(spark, path, block_bytes), "ends")
    per_block = ends.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"), (F.max("ended") + 1).alias("next_start")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = per_block.select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"),
        F.coalesce(F.max("next_start").over(before), F.lit(0)).alias("carried"),
    )
    start = F.coalesce("began", "carried")
    whole = ends.join(stitched, ["file", "block"]).select(
        "file",
        (F.col("earlier") + F.col("nth")).alias("document"),
        start.alias("start"),
        (F.col("ended") - start).alias("n_tokens"),
        F.lit(True).alias("complete"),
    )
    sizes = (F.sum("size") / ID.itemsize).cast("long")
    files = _blocks(spark, path, block_bytes).groupBy("file").agg(sizes.alias("size"))
    ended = per_block.groupBy("file").agg(F.sum("n").alias("n"), F.max("next_start").alias("next_start"))
    start = F.coalesce("next_start", F.lit(0))
    rest = files.join(ended, "file", "left").where(F.col("size") > start)
    rest = rest.select(
        "file",
        F.coalesce("n", F.lit(0)).alias("document"),
        start.alias("start"),
        (F.col("size") - start).alias("n_tokens"),
        F.lit(False).alias("complete"),
    )
    return whole.unionByName(rest)
