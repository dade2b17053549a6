"""Best-fit packing of documents into sequences, planned on the counts of lengths.

Pieces are no longer than a sequence, so the plan needs no more than how many pieces there
are of each length: at most `capacity` numbers, whatever the number of documents. From the
longest length down, the gap beside it is filled exactly by one, two or three other
lengths where their sums allow that, each such combination as often as the counts last;
where none fits exactly, the longest length that fits goes in and the rest of the gap is
tried again. The plan says for each length which of its pieces, counted in the order of
tasks and rows, go to which sequence and place, in a few runs that each piece finds its own in.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from dagtrail.llm.common import blocks, first_columns
from dagtrail.llm.encoding import ID_BYTES, encoder
from dagtrail.sources.paths import store_rows

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, turn long"
_RUN = pa.struct([(c, pa.int64()) for c in ("first", "sequence", "offset", "uses")])
RUNS = pa.schema([("length", pa.int64()), ("runs", pa.list_(_RUN))])
# The pieces' ids themselves, after the other columns where they are asked for.
IDS = ", token_ids array<int>"
# Beyond any number of pieces of one length; separates the lengths in the plan's search key.
SPAN = 1 << 50


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _id_lists(pieces: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(ids) // ID_BYTES for ids in pieces)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(pieces), "<i4")))


def cut_pieces(
    documents: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Pieces of at most `capacity` ids of each document's ids and one end id, with their crc32, and with
    the ids themselves if they are asked for.

    `part` is the writing task and `turn` counts its pieces of the same length. A null or
    empty text is the end id alone; equal rows are packed as often as they occur.
    """
    end = end_id.to_bytes(ID_BYTES, "little")
    schema = PIECES + (IDS if with_ids else "")
    names = _names(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        turns: dict[int, int] = {}
        for batch in blocks(batches, 1):
            made, cut = [], []
            for doc_id, text in zip(batch.columns[0].to_pylist(), batch.columns[1], strict=True):
                packed = encode.packed(text.as_py()) + end
                for piece, at in enumerate(range(0, len(packed), ID_BYTES * capacity)):
                    ids = packed[at : at + ID_BYTES * capacity]
                    length = len(ids) // ID_BYTES
                    turn = turns[length] = turns.get(length, -1) + 1
                    made.append((doc_id, piece, at // ID_BYTES, length, zlib.crc32(ids), part, turn))
                    cut.append(ids)
            columns = zip(*made, strict=True) if made else [[]] * len(names)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            arrays += [_id_lists(cut)] if with_ids else []
            yield pa.RecordBatch.from_arrays(arrays, names=_names(schema))

    return first_columns(documents, "doc_id", "text").mapInArrow(run, schema)


class _Counts:
    """How many pieces of each length are left, and which sums of lengths they can make."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def longest(self, at_most: int) -> int:
        """The longest length left that is no longer than this, or 0."""
        there = np.flatnonzero(self.left[1 : at_most + 1])
        return int(there[-1]) + 1 if len(there) else 0

    def pair(self, total: int, at_most: int) -> tuple[int, int] | None:
        """Two lengths left of this sum, the longer as long as may be."""
        low = np.arange(max(1, total - at_most), total // 2 + 1)
        low = low[(self.left[low] > 0) & (self.left[total - low] > 0)] if len(low) else low
        if len(low) and 2 * low[-1] == total and self.left[low[-1]] < 2:
            low = low[:-1]
        return (total - int(low[0]), int(low[0])) if len(low) else None

    def exact(self, gap: int) -> list[int]:
        """One, two or three lengths left that sum up to the gap, or none."""
        if self.left[gap]:
            return [gap]
        if two := self.pair(gap, gap - 1):
            return list(two)
        there = np.flatnonzero(self.left[: gap - 1])
        for first in there[there * 3 >= gap][::-1].tolist():
            self.left[first] -= 1
            two = self.pair(gap - first, min(first, gap - first - 1))
            self.left[first] += 1
            if two:
                return [first, *two]
        return []


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Combinations of lengths that fill a sequence each, and how many sequences take each."""
    index = _Counts(counts, capacity)
    plan = []
    while longest := index.longest(capacity):
        chosen = [longest]
        index.left[longest] -= 1
        gap = capacity - longest
        while gap:
            fitting = index.exact(gap) or [index.longest(gap)]
            if not fitting[0]:
                break
            for length in fitting:
                index.left[length] -= 1
                gap -= length
            chosen += fitting
        lengths, uses = np.unique(chosen, return_counts=True)
        more = int((index.left[lengths] // uses).min())
        index.left[lengths] -= more * uses
        plan.append((chosen, more + 1))
    return plan


class _Places:
    """Where the n-th piece of a length goes."""

    def __init__(self, plan: list[tuple[list[int], int]]):
        taken: dict[int, int] = {}
        keys, sequences, offsets, uses = [], [], [], []
        first = 0
        for chosen, times in plan:
            lengths, counts = np.unique(chosen, return_counts=True)
            offset = 0
            for length, use in zip(lengths.tolist()[::-1], counts.tolist()[::-1], strict=True):
                keys.append(length * SPAN + taken.get(length, 0))
                sequences.append(first)
                offsets.append(offset)
                uses.append(use)
                taken[length] = taken.get(length, 0) + use * times
                offset += length * use
            first += times
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.sequences, self.offsets, self.uses = (
            np.array(x, dtype=np.int64)[order] for x in (keys, sequences, offsets, uses)
        )

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length * SPAN + rank
        at = np.searchsorted(self.keys, key, "right") - 1
        nth = key - self.keys[at]
        return self.sequences[at] + nth // self.uses[at], self.offsets[at] + nth % self.uses[at] * length

    def runs(self) -> pa.Table:
        """For each length its runs in order: the first piece, its sequence and offset, and pieces in each sequence."""
        found: dict[int, list[dict[str, int]]] = {}
        rows = (x.tolist() for x in (self.keys // SPAN, self.keys % SPAN, self.sequences, self.offsets, self.uses))
        for length, *run in zip(*rows, strict=True):
            found.setdefault(length, []).append(dict(zip(_RUN.names, run, strict=True)))
        return pa.table([list(found), list(found.values())], schema=RUNS)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Put stored pieces into sequences of at most `capacity` tokens without gaps between them.

    Sequences are numbered from 0. Pieces that hold their ids keep them, so a sequence is its pieces' ids by
    offset. An empty table has none.
    """
    ids = ["token_ids"] if "token_ids" in pieces.columns else []
    per_task = pieces.groupBy("part", "length").agg((F.max("turn") + 1).alias("n"))
    per_task = store_rows(per_task, "lengths")
    # at most `capacity` rows
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = _Places(plan_sequences(counts, capacity)).runs()
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("turn"))
    # a row for each of at most `capacity` lengths, with a few runs
    ranked = ranked.join(F.broadcast(pieces.sparkSession.createDataFrame(runs)), "length")
    own = F.element_at(F.filter("runs", lambda run: run["first"] <= F.col("rank")), -1)
    placed = ranked.withColumn("run", own).withColumn("nth", F.expr("rank - run.first"))
    sequence = F.expr("run.sequence + nth div run.uses").alias("sequence_id")
    offset = F.expr("run.offset + nth % run.uses * length").alias("offset")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence, offset, *ids)


def pack_documents(
    documents: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Encode, cut and pack documents; see `cut_pieces` and `pack`."""
    return pack(store_rows(cut_pieces(documents, tokenizer, end_id, capacity, with_ids), "pieces"), capacity)
