"""Passages that occur again: maximal repeats by the common-prefix interval tree of a sparse suffix array.

Sparse means that suffixes start at anchors only. The windows of a given length, one at each
byte of a text, choose the least of their grams' hashes, and its place is their anchor; windows
that choose the same place form a segment. Equal windows choose equal grams at equal
offsets, so all occurrences of a window meet in the bucket of their anchor's gram, whatever
surrounds them, and only about one suffix in 150 bytes is ever moved.

Segments that are equal as a whole are counted before they are moved. In a bucket with unlike ones,
the suffixes at the anchors are sorted with their common prefixes, and a stack scan visits the
intervals of the tree, each a set of suffixes with a common prefix. What precedes the
anchors is sorted too, and tells where the members' left extensions part: members that agree far
enough to the left are the occurrences of one repeat, which no byte more on either side has in
common. A bucket of very many unlike segments is not gathered: segments are cut into pieces
that have more in common, which meet in smaller buckets.
"""

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from dagtrail.llm.common import first_columns, sliced_join
from dagtrail.sources.paths import store_rows

LENGTH = 400
# Bytes that a gram has at most; a window must hold many grams for anchors to be rare.
GRAM = 100
# Windows of a text that are worked on at once.
CHUNK = 1 << 19
# Unlike segments of a bucket that one task sorts; larger ones are divided by so much each time.
BUCKET = 256
DIVISION = 8
# Bytes a task reads or makes before it hands rows on.
BATCH_BYTES = 4 << 20

_PLACE = (1 << 20) - 1
_SEGMENT = ["seg_a", "seg_b"]
_HELD = (
    "row long, doc_id long, n_bytes long, digest string, packed binary, own array<struct<start:bigint,stop:bigint>>, "
    "start array<long>, size array<int>, lead array<int>, anchor array<long>, seg_a array<long>, seg_b array<long>"
)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and powers of an odd number and of its inverse, all modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    numbers = np.random.default_rng(42).integers(1, 1 << 64, 256, dtype=np.uint64)
    inverse = pow(base, -1, 1 << 64)
    made = []
    for factor in (base, inverse):
        line = np.full(n, factor, dtype=np.uint64)
        line[0] = 1
        made.append(np.cumprod(line, dtype=np.uint64))
    return numbers, *made


def _grams(data: np.ndarray, gram: int, longest: int) -> np.ndarray:
    """A hash of the bytes from each place on."""
    numbers, powers, inverse = _powers(longest)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(numbers[data] * powers[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of so many keys: by minima from the ends of blocks of that size."""
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    lines = padded.reshape(blocks, width)
    before = np.minimum.accumulate(lines, axis=1).ravel()
    after = np.minimum.accumulate(lines[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(keys) - width + 1
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def segments(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, size, place of the anchor in it, and hash of the anchor's gram of each segment of a text."""
    gram = min(GRAM, max(1, length // 4))
    whole = np.frombuffer(text, dtype=np.uint8)
    found = [np.empty((4, 0), dtype=np.int64)]
    for at in range(0, len(whole) - length + 1, CHUNK):
        data = whole[at : at + CHUNK + length - 1]
        hashes = _grams(data, gram, CHUNK + length)
        keys = hashes & ~np.uint64(_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        place = (_least(keys, length - gram + 1) & np.uint64(_PLACE)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        anchor = place[first]
        found.append(np.stack([first + at, last - first + length, anchor - first, hashes[anchor].view(np.int64)]))
    return tuple(np.concatenate(found, axis=1))


def _held(documents: DataFrame, length: int) -> DataFrame:
    """The stored documents, each with a number, its text packed, and its segments with a hash of each."""
    names = ["start", "size", "lead", "anchor", *_SEGMENT]
    ints = {"size": pa.int32(), "lead": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, pack = TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(level=1)
        digest = xxhash.xxh3_128_intdigest
        made, ids, size = [], [], 0

        def given() -> pa.RecordBatch:
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary(), spans))]
            columns.insert(1, pa.array(ids, pa.int64()))
            offsets = pa.array(np.cumsum([0, *(len(m[5][0]) for m in made)]).astype(np.int32))
            for i, n in enumerate(names):
                flat = np.concatenate([m[5][i] for m in made])
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat, ints.get(n, pa.int64()))))
            batch = pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_bytes", "digest", "packed", "own", *names])
            made.clear()
            ids.clear()
            return batch

        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for i in range(batch.num_rows):
                text = (batch.column(1)[i].as_py() or "").encode()
                start, sizes, lead, anchor = segments(text, length)
                parts = zip(start.tolist(), (start + sizes).tolist(), strict=True)
                hashes = b"".join(digest(text[a:b]).to_bytes(16, "little") for a, b in parts)
                halves = np.frombuffer(hashes, dtype="<i8").reshape(-1, 2)
                # of a long run of equal segments, as in a text that repeats itself, the ends tell all
                same = (halves[1:] == halves[:-1]).all(axis=1)
                inner = np.append(same, False) & np.insert(same, 0, False)[: len(halves)] if len(halves) else same
                own = []
                if inner.any():
                    begins = np.flatnonzero(inner & ~np.insert(inner[:-1], 0, False))
                    ends = np.flatnonzero(inner & ~np.append(inner[1:], False))
                    own = [{"start": int(start[a]), "stop": int(start[b] + sizes[b])} for a, b in zip(begins, ends, strict=True)]
                keep = ~inner
                columns = [c[keep] for c in (start, sizes, lead, anchor, halves[:, 0], halves[:, 1])]
                made.append((row, len(text), hashlib.sha256(text).hexdigest(), pack.compress(text), own, columns))
                ids.append(batch.column(0)[i].as_py())
                row, size = row + 1, size + len(text)
                if size > BATCH_BYTES:
                    yield given()
                    size = 0
        if made:
            yield given()

    rows = first_columns(documents, "doc_id", "text")
    return store_rows(rows.mapInArrow(run, _HELD), "held")


def _common(one: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes that each line has in common with the one before, from its beginning on."""
    unlike = one[1:] != one[:-1]
    n = np.where(unlike.any(axis=1), unlike.argmax(axis=1), one.shape[1])
    return np.concatenate([[0], np.minimum(n, np.minimum(lengths[1:], lengths[:-1]))])


def _sorted(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings, and what each has in common with the one before it in that order."""
    order = np.array(sorted(range(len(parts)), key=parts.__getitem__))
    lengths = np.array([len(parts[i]) for i in order])
    lines = np.zeros((len(parts), max(1, int(lengths.max()))), dtype=np.uint8)
    lines[np.arange(lines.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(parts[i] for i in order), dtype=np.uint8)
    return order, _common(lines, lengths)


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """Common prefix, first and last of every inner node of the tree, children before their parents."""
    stack = [(0, 0)]
    for i in range(1, len(common) + 1):
        here, first = (common[i] if i < len(common) else -1), i - 1
        while stack and stack[-1][0] > here:
            prefix, first = stack.pop()
            yield prefix, first, i - 1
        if not stack or stack[-1][0] < here:
            stack.append((here, first))


def bucket_repeats(parts: list[bytes], leads: list[int], length: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Members, and bytes before and after the anchor, of each maximal repeat of unlike segments of an anchor."""
    suffixes, common = _sorted([p[n:] for p, n in zip(parts, leads, strict=True)])
    prefixes, common_left = _sorted([p[:n][::-1] for p, n in zip(parts, leads, strict=True)])
    rank = np.empty(len(parts), dtype=np.int64)
    rank[prefixes] = np.arange(len(parts))
    place = np.empty(len(parts), dtype=np.int64)
    place[suffixes] = np.arange(len(parts))
    longest = int(common_left.max())
    for right, first, last in intervals(common.tolist()):
        if right + longest < length or right <= 0:
            continue
        ranks = np.sort(rank[suffixes[first : last + 1]])
        # what neighbours among the members have in common to the left: the least of all between them
        bounds = np.append(ranks + 1, len(parts))
        left = np.minimum.reduceat(np.append(common_left, 0), bounds)[: len(ranks) - 1]
        left = np.where(np.diff(ranks) > 0, left, 0)
        # where left extensions part, a group of occurrences ends; a group may part again further left
        for low in sorted({int(v) for v in left if v >= length - right}):
            joined = left >= low
            begins = np.flatnonzero(joined & ~np.insert(joined[:-1], 0, False))
            ends = np.flatnonzero(joined & ~np.append(joined[1:], False)) + 1
            for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                members = prefixes[ranks[a : b + 1]]
                at = place[members]
                # more in common on either side would make it part of a longer one
                if int(left[a:b].min()) == low and int(common[at.min() + 1 : at.max() + 1].min()) == right:
                    yield members, low, right


def _reach(parts: list[bytes], leads: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the repeats of each segment reach before and after its anchor; nothing is -1."""
    left, right = np.full(len(parts), -1), np.full(len(parts), -1)
    for members, before, after in bucket_repeats(parts, leads, length):
        left[members] = np.maximum(left[members], before)
        right[members] = np.maximum(right[members], after)
    return left, right


def _contents(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """The wanted segments with their bytes, each cut from one document that has it."""
    columns = ["anchor", *_SEGMENT, "n", "lead", "hot"]
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("start", "size", *columns)).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                text, found = unpack.decompress(batch.column(0)[i].as_py()), batch.column(1)[i].values
                starts, sizes = (found.field(c).to_pylist() for c in ("start", "size"))
                parts = pa.array([text[a : a + n] for a, n in zip(starts, sizes, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(found.field(c) for c in columns), parts], names=[*columns, "content"])

    schema = "anchor long, seg_a long, seg_b long, n long, lead int, hot boolean, content binary"
    return store_rows(held.select("row", "packed").join(lists, "row").select("packed", "wanted").mapInArrow(run, schema), "contents")


def _buckets(
    contents: DataFrame, schema: str, work: Callable[[list[bytes], pa.Table], Iterator[pa.RecordBatch]]
) -> DataFrame:
    """Give each anchor's segments to `work`, one bucket after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            anchors = batch.column("anchor").to_numpy()
            cuts = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            if held and len(anchors) and held[-1].column("anchor")[0].as_py() != anchors[0]:
                yield from whole(held)
                held = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(anchors)], strict=True):
                if a == b:
                    continue
                if a:
                    yield from whole(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from whole(held)

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        yield from work(table["content"].to_pylist(), table)

    return contents.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, schema)


_FOUND = "seg_a long, seg_b long, low long, high long"


def _sorted_out(contents: DataFrame, length: int) -> DataFrame:
    """seg_a, seg_b, and from where to where the segment repeats, for buckets that a task sorts."""

    def work(parts: list[bytes], table: pa.Table) -> Iterator[pa.RecordBatch]:
        leads = table["lead"].to_numpy().astype(np.int64)
        left, right = _reach(parts, leads.tolist(), length)
        has = left >= 0
        columns = [table[c].to_numpy()[has] for c in _SEGMENT] + [(leads - left)[has], (leads + right)[has]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*_SEGMENT, "low", "high"])

    return _buckets(contents.where("not hot"), _FOUND, work)


def _groups(contents: DataFrame, length: int) -> DataFrame:
    """anchor, nth, seg_a, seg_b, low, high: the segments, and their part, of each maximal repeat of a bucket."""

    def work(parts: list[bytes], table: pa.Table) -> Iterator[pa.RecordBatch]:
        leads, names = table["lead"].to_numpy().astype(np.int64), ["anchor", "nth", *_SEGMENT, "low", "high"]
        for nth, (members, before, after) in enumerate(bucket_repeats(parts, leads.tolist(), length)):
            anchor, seg_a, seg_b = (table[c].to_numpy()[members] for c in ("anchor", *_SEGMENT))
            columns = [anchor, np.full(len(members), nth), seg_a, seg_b, leads[members] - before, leads[members] + after]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return _buckets(contents.where("not hot"), "anchor long, nth long, " + _FOUND, work)


def _pieces(hot: DataFrame, length: int, width: int) -> DataFrame:
    """Segments cut into the windows whose anchors lie from i * width bytes on, each with a new bucket.

    All windows of a piece have the bytes in common that lie around the anchor, a core nearly as long as a
    window, so pieces that repeat anything of each other have equal cores, which name the bucket.
    """
    names = ["seg_a", "seg_b", "shift", "n", "anchor", "piece_a", "piece_b", "lead", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            made: list[tuple] = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("anchor", "seg_a", "seg_b", "n", "lead", "content")), strict=True)
            for anchor, seg_a, seg_b, n, lead, content in rows:
                nearest = length - (len(content) - lead)
                for i in range(nearest // width, lead // width + 1):
                    low, high = max(nearest, i * width), min(lead, (i + 1) * width - 1)
                    core = content[lead - i * width : lead + length - (i + 1) * width + 1]
                    part = content[lead - high : lead + length - low]
                    name = f"{anchor} {i} {width} ".encode()
                    key = np.frombuffer(digest(name + core), dtype="<i8")[0]
                    halves = np.frombuffer(digest(name + part), dtype="<i8")
                    made.append((seg_a, seg_b, lead - high, n, key, *halves, high, part))
            types = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], names=names)

    schema = ", ".join(f"{c} long" for c in names[:7]) + ", lead int, content binary"
    return store_rows(hot.mapInArrow(run, schema), "pieces")


def _found(contents: DataFrame, length: int, width: int) -> DataFrame:
    """seg_a, seg_b, low and high of segments that repeat in part, for buckets of any size.

    A bucket of too many segments is divided: its segments are cut into pieces with narrower ranges of
    windows, which meet in more buckets, and most of which are equal as a whole. That goes on until a
    piece is a single window, and all of a bucket's are equal.
    """
    few = _sorted_out(contents.where("not hot"), length)
    hot = contents.where("hot")
    if hot.isEmpty():
        return few
    width = -(-width // DIVISION)
    pieces = _pieces(hot, length, width)
    named = ["piece_a", "piece_b"]
    unlike = pieces.groupBy("anchor", *named).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.any_value("lead").alias("lead"), F.any_value("content").alias("content")
    )
    unlike = store_rows(unlike.withColumnsRenamed(dict(zip(named, _SEGMENT, strict=True))), "unlike")
    sizes = unlike.groupBy("anchor").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least"))
    sizes = store_rows(sizes.where("members > 1 and least = 1"), "buckets")
    again = sliced_join(unlike.select("anchor", *_SEGMENT, "n", "lead", "content"), sizes, ["anchor"], _SEGMENT, "members")
    again = store_rows(again.withColumn("hot", F.col("members") > BUCKET).drop("members", "least"), "contents")
    found = _found(again, length, width)
    # a piece of one segment repeats where it was found to, others as a whole
    once = unlike.where("n = 1").select(*_SEGMENT, "rows").join(found, _SEGMENT)
    often = unlike.where("n > 1").select(*_SEGMENT, "rows", F.lit(0).cast("long").alias("low"), F.length("content").cast("long").alias("high"))
    parts = once.unionByName(often).withColumnsRenamed(dict(zip(_SEGMENT, named, strict=True)))
    spans = sliced_join(pieces.drop("n", "anchor", "lead", "content"), store_rows(parts, "parts"), named, _SEGMENT, "rows")
    # all of them hold the anchor, so they leave no gap
    low, high = F.min(F.col("shift") + F.col("low")).alias("low"), F.max(F.col("shift") + F.col("high")).alias("high")
    return few.unionByName(spans.groupBy(*_SEGMENT).agg(low, high))


class _Repeats(NamedTuple):
    """The stored documents; occurrences of segments that are alike in their bucket, and of those that are not; the
    unlike segments, each once; and the contents of buckets that must be compared."""

    held: DataFrame
    alike: DataFrame
    mixed: DataFrame
    unlike: DataFrame
    contents: DataFrame


def _met(documents: DataFrame, length: int) -> _Repeats:
    held = _held(documents, length)
    zipped = F.arrays_zip("start", "size", "lead", "anchor", *_SEGMENT)
    occurrences = held.select("row", F.inline(zipped))
    anchors = occurrences.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("times"),
        # half of the hash will do: unlike segments would all have to agree on it
        (F.min("seg_a") < F.max("seg_a")).alias("mixed"),
    )
    anchors = store_rows(anchors.where("times > 1"), "anchors")
    again = store_rows(sliced_join(occurrences, anchors, ["anchor"], ["row", "start"], "times").drop("times"), "repeated")
    mixed = again.where("mixed")
    # unlike segments of an anchor, each with one place where it occurs
    place = F.min(F.struct("row", "start")).alias("place")
    unlike = mixed.groupBy("anchor", *_SEGMENT, "lead", "size").agg(F.count(F.lit(1)).alias("n"), place)
    unlike = store_rows(unlike.select("anchor", *_SEGMENT, "lead", "size", "n", "place.row", "place.start"), "segments")
    sizes = unlike.groupBy("anchor").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least"))
    sizes = store_rows(sizes.where("least = 1"), "buckets")
    wanted = sliced_join(unlike, sizes, ["anchor"], _SEGMENT, "members")
    contents = _contents(wanted.withColumn("hot", F.col("members") > BUCKET), held)
    return _Repeats(held, again.where("not mixed"), mixed, unlike, contents)


def repeated_spans(documents: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """The stored documents, and spans of them (row, start, stop) that hold every byte of every
    string of `length` bytes that starts anywhere else too."""
    met = _met(documents, length)
    found = store_rows(_found(met.contents, length, length), "found")
    stop = (F.col("start") + F.col("size")).alias("stop")
    # a segment that occurs once is met where it is; others repeat as a whole
    once = met.unlike.where("n = 1").join(found, _SEGMENT)
    once = once.select("row", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("stop"))
    often = met.unlike.where("n > 1").select(*_SEGMENT, "n")
    often = sliced_join(met.mixed, often, _SEGMENT, ["row", "start"], "n").select("row", "start", stop)
    own = met.held.where(F.size("own") > 0).select("row", F.inline("own"))
    alike = met.alike.select("row", "start", stop)
    return met.held, alike.unionByName(once).unionByName(often).unionByName(own)


def repeat_groups(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """anchor, nth, doc_id, row, start and stop: all occurrences of each repeat (anchor, nth) of `length` bytes or more.

    Repeats are maximal within the segments of their anchor. `nth` is -1 for segments that are all
    alike, and for segments that occur more than once among unlike ones it is negative too.
    Buckets of more than `BUCKET` unlike segments give no groups but for their equal segments, though
    `repeated_spans` holds their bytes. Documents are as in `remove_repeats`.
    """
    met = _met(documents, length)
    stop = (F.col("start") + F.col("size")).alias("stop")
    alike = met.alike.select("anchor", F.lit(-1).cast("long").alias("nth"), "row", "start", stop)
    often = met.unlike.where("n > 1").select(*_SEGMENT, "n")
    equal = sliced_join(met.mixed, often, _SEGMENT, ["row", "start"], "n")
    number = (-2 - F.pmod("seg_a", F.lit((1 << 62) - 1))).alias("nth")
    equal = equal.select("anchor", number, "row", "start", stop)
    groups = met.mixed.join(_groups(met.contents, length), ["anchor", *_SEGMENT])
    groups = groups.select(
        "anchor", "nth", "row", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("stop")
    )
    found = alike.unionByName(equal).unionByName(groups)
    return found.join(met.held.select("row", "doc_id"), "row").select("anchor", "nth", "doc_id", "row", "start", "stop")


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (lines of start and stop) united where they overlap or touch."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def remove_repeats(documents: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document, and `kept`, the bytes left, if wanted.

    Every byte is removed that lies in a string of `length` bytes which also starts at any other place of any
    document, the same one too, so no occurrence is spared. Null texts are empty; texts shorter than
    `length` stay; repeated rows lose all their bytes if they are long enough; very long texts are
    worked on in pieces that overlap, which changes nothing; an empty table gives no rows; other columns are ignored.
    """
    held, spans = repeated_spans(documents, length)
    lists = spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, names = zstandard.ZstdDecompressor(), [c.strip().split()[0] for c in schema.split(",")]
        for batch in batches:
            made: list[tuple] = []
            for i in range(batch.num_rows):
                doc_id, n_bytes, digest = (batch.column(c)[i].as_py() for c in range(3))
                given, kept = batch.column(4)[i], None
                if given.is_valid:
                    fields = [given.values.field(c).to_numpy(zero_copy_only=False) for c in range(2)]
                    parts = merged(np.stack(fields, axis=1).astype(np.int64))
                    removed = int((parts[:, 1] - parts[:, 0]).sum())
                    text = unpack.decompress(batch.column(3)[i].as_py()) if removed < n_bytes else b""
                    ends = [0, *parts.ravel().tolist(), n_bytes]
                    kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) if removed < n_bytes else b""
                    made.append((doc_id, n_bytes, removed, len(parts), hashlib.sha256(kept).hexdigest()))
                else:
                    made.append((doc_id, n_bytes, 0, 0, digest))
                if texts:
                    kept = unpack.decompress(batch.column(3)[i].as_py()) if kept is None else kept
                    made[-1] += (kept,)
            types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * texts
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], names=names)

    columns = held.select("row", "doc_id", "n_bytes", "digest", "packed").join(lists, "row", "left").drop("row")
    return columns.mapInArrow(run, schema)
