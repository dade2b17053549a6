"""Near duplicates by SimHash fingerprints of word shingles.

Two fingerprints are cut into segments of two bits and each segment is replaced by its bit
count. The Manhattan distance of two such vectors is never more than the number of
differing bits, so it bounds the search. The vectors lie on a grid whose axes are split
into groups; links of at most d bits leave all but d groups without any distance, so a
vector is filed once in the cell of every combination of that many groups, and linked
pairs share a cell. Cells are sorted together, and inside a cell the bound and then the
exact distance decide.

A cell that holds many fingerprints gives no pairs: it is searched breadth first, which
gives a spanning forest of its links, and a cell too large for one task is searched by
pairs of blocks. Only fingerprints that differ are ever compared.
"""

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagtrail.llm.common import first_columns
from dagtrail.llm.components import components
from dagtrail.sources.paths import store_rows

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
BITS = 64
SEGMENT_BITS = 2
# With seven groups of axes, three are free of distance: about 20 bits of counts in a key.
GROUPS = 7
# Cells up to this size are compared pair by pair, larger ones breadth first.
SMALL_CELL = 24
# A cell beyond this size is searched by pairs of blocks.
LARGE_CELL = 20_000

_HALF = 0x5555555555555555
_EDGES = "combo int, cell long, one long, other long"


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The SimHash of a text's shingles, repeats included, as a signed 64-bit integer.

    Words are separated by ASCII white space, A-Z are lower-cased. Fewer words than a shingle
    are one shingle; no word at all, as in null and empty texts, gives zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle_words, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    shingles = len(words) - size + 1
    for low in range(0, shingles, 1 << 16):
        spans = zip(
            begins[low : min(low + (1 << 16), shingles)].tolist(), ends[low + size - 1 :].tolist(), strict=False
        )
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > shingles, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(documents: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint and a hash of the text of each row; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py(), shingle_words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made, pa.int64()), batch.column(2)],
                names=["doc_id", "fingerprint", "text_hash"],
            )

    rows = first_columns(documents, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long, text_hash long")


def _masks() -> list[int]:
    """For each combination of groups of segments, the bits of their counts, as signed integers."""
    segments = np.array_split(np.arange(BITS // SEGMENT_BITS), GROUPS)
    bits = [sum(3 << (SEGMENT_BITS * int(s)) for s in group) for group in segments]
    free = combinations(bits, GROUPS - MAX_DISTANCE)
    return [int(np.uint64(reduce(int.__or__, chosen)).astype(np.int64)) for chosen in free]


def _embedded(fingerprint: Column) -> Column:
    """Bit counts of all segments, each written in unary, so that unlike bits are the Manhattan distance."""
    upper, half = F.shiftrightunsigned(fingerprint, 1), F.lit(_HALF)
    some = upper.bitwiseOR(fingerprint).bitwiseAND(half)
    both = upper.bitwiseAND(fingerprint).bitwiseAND(half)
    return some.bitwiseOR(F.shiftleft(both, 1))


def _embed(values: np.ndarray) -> np.ndarray:
    upper, half = values >> np.uint64(1), np.uint64(_HALF)
    return ((upper | values) & half) | ((upper & values & half) << np.uint64(1))


def _cells(distinct: DataFrame) -> DataFrame:
    """Each fingerprint in the cell of every combination of groups."""
    embedded = _embedded(F.col("fingerprint"))
    cells = F.array(*[embedded.bitwiseAND(F.lit(m)) for m in _masks()])
    return distinct.select("fingerprint", F.posexplode(cells).alias("combo", "cell"))


def _near(value: np.uint64, others: np.ndarray, embedded: np.ndarray, at: np.uint64) -> np.ndarray:
    """Which of the others are linked: first by the bound, then exactly."""
    close = np.flatnonzero(np.bitwise_count(embedded ^ at) <= MAX_DISTANCE)
    return close[np.bitwise_count(others[close] ^ value) <= MAX_DISTANCE]


def _forest(values: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span each connected part of a cell, found breadth first."""
    ones, others = [], []
    left, embedded = values, _embed(values)
    while len(left) > 1:
        queue, left, embedded = [left[0]], left[1:], embedded[1:]
        while queue and len(left):
            value = queue.pop()
            found = _near(value, left, embedded, _embed(value[None])[0])
            if len(found):
                ones.append(np.full(len(found), value))
                others.append(left[found])
                queue.extend(left[found])
                left, embedded = np.delete(left, found), np.delete(embedded, found)
    return ones, others


def _pairs(values: np.ndarray, run: np.ndarray, longest: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Linked pairs inside runs of equal cells."""
    ones, others, embedded = [], [], _embed(values)
    for step in range(1, longest):
        at = np.flatnonzero(run[step:] == run[:-step])
        at = at[np.bitwise_count(embedded[at] ^ embedded[at + step]) <= MAX_DISTANCE]
        at = at[np.bitwise_count(values[at] ^ values[at + step]) <= MAX_DISTANCE]
        ones.append(values[at])
        others.append(values[at + step])
    return ones, others


def _linked(rows: DataFrame, keys: list[str], largest: int | None) -> DataFrame:
    """Links inside cells; the members of a cell larger than `largest` come out alone, for later."""
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys)
    ordered = ordered.select("combo", "cell", "fingerprint", F.xxhash64(*keys).alias("key"))

    def links(combo, cell, value, key):
        """Links of whole cells, given in order."""
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
        size = np.diff(np.append(first, len(key)))
        run = np.repeat(np.arange(len(first)), size)
        shared = (size > 1) & (size <= SMALL_CELL)
        there = shared[run]
        ones, others = _pairs(value[there], run[there], int(size[shared].max(initial=0)))
        for start, n in zip(first[size > SMALL_CELL], size[size > SMALL_CELL], strict=True):
            x, y = _forest(value[start : start + n])
            ones += x
            others += y
        one = np.concatenate([np.empty(0, dtype=np.uint64), *ones]).view(np.int64)
        other = np.concatenate([np.empty(0, dtype=np.uint64), *others]).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(one), pa.int32()),
                pa.nulls(len(one), pa.int64()),
                pa.array(one),
                pa.array(other),
            ],
            names=["combo", "cell", "one", "other"],
        )

    def later(combo, cell, value):
        return pa.RecordBatch.from_arrays(
            [pa.array(combo), pa.array(cell), pa.array(value.view(np.int64)), pa.nulls(len(value), pa.int64())],
            names=["combo", "cell", "one", "other"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, t) for t in (np.int32, np.int64, np.uint64, np.int64)]
        passing = None  # the key of a cell whose members are all passed on
        for batch in batches:
            combo, cell, value, key = (c.to_numpy() for c in batch.columns)
            value = value.view(np.uint64)
            if passing is not None:
                n = int((np.cumsum(key != passing) == 0).sum())
                if n:
                    yield later(combo[:n], cell[:n], value[:n])
                if n == len(key):
                    continue
                passing, combo, cell, value, key = None, combo[n:], cell[n:], value[n:], key[n:]
            held = [np.concatenate(x) for x in zip(held, (combo, cell, value, key), strict=True)]
            last = len(held[3]) - int((np.cumsum((held[3] != held[3][-1])[::-1]) == 0).sum())
            if last:
                yield links(*[h[:last] for h in held])
                held = [h[last:] for h in held]
            if largest and len(held[3]) > largest:
                passing = held[3][0]
                yield later(*held[:3])
                held = [h[:0] for h in held]
        if len(held[3]):
            yield links(*held)

    return ordered.mapInArrow(run, _EDGES)


def _blocks(members: DataFrame) -> DataFrame:
    """Members of large cells, once for each pair of blocks that theirs is in."""
    sizes = members.groupBy("combo", "cell").agg(F.ceil(2 * F.count("one") / F.lit(LARGE_CELL)).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("one"), F.col("n"))
    blocked = members.join(sizes, ["combo", "cell"]).withColumn("own", own)
    paired = blocked.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return paired.select(
        "combo",
        "cell",
        F.col("one").alias("fingerprint"),
        F.least("own", F.col("with").cast("long")).alias("low"),
        F.greatest("own", F.col("with").cast("long")).alias("high"),
    )


def near_links(distinct: DataFrame) -> DataFrame:
    """Links between unlike fingerprints, enough to connect all that links of at most
    `MAX_DISTANCE` differing bits connect: columns one and other, stored."""
    found = store_rows(_linked(_cells(distinct), ["combo", "cell"], LARGE_CELL), "links")
    links, members = found.where("other is not null"), found.where("other is null")
    if not members.isEmpty():
        more = _linked(_blocks(members), ["combo", "cell", "low", "high"], None)
        links = links.unionByName(store_rows(more, "links"))
    return links.select("one", "other")


def near_duplicates(documents: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (signed) and component_id, the smallest doc_id that links reach; then
    the component's root fingerprint and a hash of the row's text.

    Every row is answered, repeated ids too. Null ids are answered but name no component;
    where all ids of a component are null, so is its name. Very long texts count whole; an empty table gives none.
    """
    rows = store_rows(fingerprints(documents, shingle_words), "fingerprints")
    distinct = store_rows(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(near_links(distinct.select("fingerprint")))
    named = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    named = named.withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(smallest, "root").select("fingerprint", "component_id", "root")
    return rows.join(labels, "fingerprint").select("doc_id", "fingerprint", "component_id", "root", "text_hash")


def representatives(found: DataFrame) -> DataFrame:
    """doc_id and text_hash of the row that stands for each component: its smallest id, nulls
    last, then the smallest hash."""
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    chosen = found.groupBy("root").agg(F.min(order).alias("chosen"))
    return chosen.select("chosen.doc_id", "chosen.text_hash")


def hexadecimal(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), BITS // 4, "0")
