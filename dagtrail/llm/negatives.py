"""Hard negatives from blocks of candidates along a Hilbert curve.

Candidates are written to Parquet in the order of a Hilbert curve, a row per block of near
ones, with a zone map: for each label in the block the least and the greatest value of every
dimension. Interval arithmetic on a zone map bounds the scores that an anchor can have with
the block's candidates, and an anchor reads a block only where these bounds leave it a place
among the best that are known.

Each anchor first reads its own block, which gives it near candidates to begin with. Bounds
then choose the blocks that can still hold one of its positives, and when these are known, the
blocks that can hold one of the first negatives of a positive's window. Anchors and blocks
meet in tiles, so no task holds more than a tile of each.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dagtrail.llm import hilbert
from dagtrail.sources.paths import store_rows

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
# Of a positive's score, in hundredths: the window of its negatives.
LOW, HIGH = 50, 95
BLOCK_ROWS = 512
# Anchors and blocks whose bounds are worked out at once.
TILE_ANCHORS = 512
TILE_BLOCKS = 256
# Sums of products up to this are exact as 64-bit floats.
EXACT = float(1 << 53)
_BOUND = np.iinfo(np.int64).max


def integer_rows(vectors: DataFrame, label: Column) -> DataFrame:
    """row, vec_id, label and the vector of floor(256 * x), x as double, stored.

    Rows without id or label, and vectors that are null or hold a null or non-finite component,
    are left out. Shorter vectors are filled with zeros.
    """
    values = F.col("embedding").cast("array<double>")
    usable = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(values, lambda v: F.floor(v * SCALE))
    rows = vectors.where(usable & F.col("vec_id").isNotNull() & label.isNotNull())
    rows = rows.select("vec_id", label.cast("long").alias("label"), whole.alias("vector"))
    return store_rows(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _matrix(column, width: int) -> np.ndarray:
    """Vectors as lines, filled with zeros up to the width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    made = np.zeros((len(column), width), dtype=np.int64)
    made[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return made


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def bounds(anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest inner product of each anchor with vectors inside each box."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return _products(up, least) + _products(down, most), _products(up, most) + _products(down, least)


def _down(score: Column, part: int) -> Column:
    """The greatest whole x with 100 x <= part * score."""
    product = score * part
    return F.call_function("div", product - F.pmod(product, F.lit(100)), F.lit(100))


def _up(score: Column, part: int) -> Column:
    """The least whole x with 100 x >= part * score."""
    return -_down(-score, part)


def _along_curve(rows: DataFrame, width: int) -> DataFrame:
    """Rows with their place on the curve through the dimensions that spread the most."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column("vector"), width)
                columns = [np.arange(width), vectors.min(axis=0), vectors.max(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["axis", "least", "most"])

    found = rows.select("vector").mapInArrow(ends, "axis long, least long, most long").groupBy("axis")
    # a row per dimension
    spread = found.agg(F.min("least").alias("least"), F.max("most").alias("most")).orderBy("axis").toPandas()
    least, most = (spread[c].to_numpy(np.float64) if len(spread) else np.zeros(width) for c in ("least", "most"))
    axes = np.argsort(least - most, kind="stable")[: min(width, hilbert.KEY_BITS // 4)]
    bits = min(hilbert.KEY_BITS // len(axes), 16)
    low, scale = least[axes], ((1 << bits) - 1) / np.maximum(most[axes] - least[axes], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = (_matrix(batch.column("vector"), width)[:, axes] - low) * scale
            yield batch.append_column("place", pa.array(hilbert.positions(points.astype(np.int64), bits)))

    return rows.mapInArrow(run, "vec_id long, label long, vector array<long>, row long, place long")


def write_blocks(rows: DataFrame, width: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The stored blocks in the order of the curve, with their zone maps.

    block; rows, ids, labels and vectors (end to end) of its candidates; zone_labels, and least
    and most of each zone (end to end). Equal vectors are told apart by their row, so a vector that
    is repeated very often fills many blocks on many tasks.
    """
    types = [("block", pa.int64())] + [(n, pa.list_(pa.int64())) for n in _BLOCK_COLUMNS]

    def block(number: int, table: pa.Table) -> pa.RecordBatch:
        vectors, labels = _matrix(table["vector"], width), table["label"].to_numpy()
        order = np.argsort(labels, kind="stable")
        zones, first = np.unique(labels[order], return_index=True)
        least = np.minimum.reduceat(vectors[order], first, axis=0)
        most = np.maximum.reduceat(vectors[order], first, axis=0)
        lists = [table["row"].to_numpy(), table["vec_id"].to_numpy(), labels, vectors.ravel(), zones, least.ravel(), most.ravel()]
        columns = [pa.array([number], pa.int64())] + [pa.array([v], pa.list_(pa.int64())) for v in lists]
        return pa.RecordBatch.from_arrays(columns, schema=pa.schema(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= block_rows:
                table = pa.Table.from_batches(held)
                yield block(number, table.slice(0, block_rows))
                number, n = number + 1, n - block_rows
                held = table.slice(block_rows).to_batches()
        if n:
            yield block(number, pa.Table.from_batches(held))

    placed = store_rows(_along_curve(rows, width), "placed")
    ordered = placed.repartitionByRange("place", "row").sortWithinPartitions("place", "row")
    schema = "block long, " + ", ".join(f"{n} array<long>" for n in _BLOCK_COLUMNS)
    return store_rows(ordered.mapInArrow(run, schema), "blocks")


_BLOCK_COLUMNS = ("rows", "ids", "labels", "vectors", "zone_labels", "least", "most")


def _lists(column) -> list[np.ndarray]:
    return [np.array(v, dtype=np.int64) for v in column.to_pylist()]


def _chosen(wanted: DataFrame, blocks: DataFrame, width: int, own_label: bool) -> DataFrame:
    """tile, anchor and block where the bounds of the block's zones reach what the anchor looks for."""
    zones = blocks.select("block", F.col("zone_labels").alias("zones"), "least", "most")
    n = blocks.count()
    chunks = max(1, -(-n // TILE_BLOCKS))
    tiles = wanted.select("tile").distinct()
    chunk = F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")
    all_chunks = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    spread = wanted.withColumn("chunk", all_chunks)
    # zone maps are repeated for each tile of anchors, the anchors for each chunk of zone maps
    meeting = tiles.withColumn("chunk", all_chunks).withColumnsRenamed({"tile": "in_tile", "chunk": "in_chunk"})
    boxes = zones.withColumn("in_chunk", chunk).join(meeting, "in_chunk")

    def choose(asked: pa.Table, found: pa.Table) -> pa.Table:
        made = {c: [np.empty(0, np.int64)] for c in ("tile", "anchor", "block")}
        if len(asked) and len(found):
            vectors, label = _matrix(asked["vector"], width), asked["label"].to_numpy()
            labels = [np.array(v, dtype=np.int64) for v in found["zones"].to_pylist()]
            of_block = np.repeat(found["block"].to_numpy(), [len(v) for v in labels])
            labels = np.concatenate(labels)
            least, most = (found[c].combine_chunks().flatten().to_numpy().reshape(-1, width) for c in ("least", "most"))
            low, high = bounds(vectors, least, most)
            fits = np.zeros(low.shape, dtype=bool)
            at_least, at_most = (_lists(asked[c]) for c in ("at_least", "at_most"))
            for window in range(max(map(len, at_least), default=0)):
                has = [i for i, v in enumerate(at_least) if len(v) > window]
                a, b = (np.array([v[i][window] for i in has])[:, None] for v in (at_least, at_most))
                fits[has] |= (high[has] >= a) & (low[has] <= b) & (a <= b)
            same = label[:, None] == labels
            i, j = np.nonzero(fits & (same if own_label else ~same))
            pairs = np.unique(np.stack([i, of_block[j]]), axis=1)
            made = {"tile": [asked["tile"].to_numpy()[pairs[0]]], "anchor": [asked["anchor"].to_numpy()[pairs[0]]], "block": [pairs[1]]}
        return pa.table({c: pa.array(np.concatenate(v), pa.int64()) for c, v in made.items()})

    asked = spread.groupBy("tile", "chunk")
    return asked.cogroup(boxes.groupBy("in_tile", "in_chunk")).applyInArrow(choose, "tile long, anchor long, block long")


def _read(requests: DataFrame, wanted: DataFrame, blocks: DataFrame, width: int, own_label: bool, k: int) -> DataFrame:
    """anchor, window, score and vec_id: of each block read, the first k candidates in each window of the anchor."""
    asked = requests.join(wanted.drop("tile"), "anchor")
    needed = requests.select("tile", "block").distinct()
    columns = {"block": "in_block", "tile": "in_tile"}
    content = blocks.select("block", "rows", "ids", "labels", "vectors").join(needed, "block").withColumnsRenamed(columns)
    names = ("anchor", "window", "score", "vec_id")

    def score(asked: pa.Table, found: pa.Table) -> pa.Table:
        made = []
        if len(asked) and len(found):
            rows, ids, labels, flat = (found[c].combine_chunks().flatten().to_numpy() for c in ("rows", "ids", "labels", "vectors"))
            order = np.argsort(ids, kind="stable")
            rows, ids, labels, vectors = rows[order], ids[order], labels[order], flat.reshape(-1, width)[order]
            scores = _products(_matrix(asked["vector"], width), vectors)
            at_least, at_most = (_lists(asked[c]) for c in ("at_least", "at_most"))
            for i, (anchor, label) in enumerate(zip(asked["anchor"].to_numpy(), asked["label"].to_numpy(), strict=True)):
                usable = (labels == label) & (rows != anchor) if own_label else labels != label
                for window, (a, b) in enumerate(zip(at_least[i], at_most[i], strict=True)):
                    at = np.flatnonzero(usable & (scores[i] >= a) & (scores[i] <= b))
                    at = at[np.argsort(-scores[i][at], kind="stable")[:k]]
                    made.append(np.stack([np.full(len(at), anchor), np.full(len(at), window), scores[i][at], ids[at]]))
        whole = np.concatenate([np.empty((4, 0), np.int64), *made], axis=1)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, whole, strict=True)})

    groups = asked.groupBy("tile", "block").cogroup(content.groupBy("in_tile", "in_block"))
    found = groups.applyInArrow(score, ", ".join(f"{c} long" for c in names))
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return store_rows(ranked, "hits")


def _search(wanted: DataFrame, own: DataFrame, blocks: DataFrame, width: int, own_label: bool, k: int) -> DataFrame:
    """The first k in each window of each anchor: its own block first, then all that can hold better ones."""
    near = _read(own, wanted, blocks, width, own_label, k)
    # a window that is full already looks for nothing below its last
    full = near.where(F.col("rank") == k).groupBy("anchor").agg(F.collect_list(F.struct("window", "score")).alias("full"))
    reached = F.map_from_entries(F.coalesce("full", F.expr("array()").cast("array<struct<window:bigint,score:bigint>>")))
    raised = F.transform("at_least", lambda v, i: F.greatest(v, F.element_at("reached", i.cast("long"))))
    narrowed = wanted.join(full, "anchor", "left").withColumn("reached", reached).withColumn("at_least", raised)
    narrowed = store_rows(narrowed.drop("reached", "full"), "narrowed")
    chosen = _chosen(narrowed, blocks, width, own_label)
    more = store_rows(chosen.join(own, ["anchor", "block"], "left_anti").select("tile", "anchor", "block"), "chosen")
    both = near.drop("rank").unionByName(_read(more, narrowed, blocks, width, own_label, k).drop("rank"))
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return store_rows(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "found")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `rows` as `integer_rows` gives them. Rows are told apart, so repeated ids and repeated vectors are
    searched for and found as often as they occur; ties go to smaller ids. An anchor without
    other rows of its label, and a positive without rows in its window, give nothing, nor does an empty table.
    """
    spark = rows.sparkSession
    width = max(rows.agg(F.max(F.size("vector"))).first()[0] or 0, 1)
    cores = spark.sparkContext.defaultParallelism
    blocks = write_blocks(rows, width, block_rows)
    # anchors know their blocks; near anchors of a tile share most of the blocks they read
    place = blocks.select("block", F.explode("rows").alias("anchor"))
    anchors = rows.where(is_anchor).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vector")
    anchors = anchors.join(place, "anchor")
    n = anchors.count()
    tiles = max(1, -(-n // TILE_ANCHORS), min(cores, n // 64))
    anchors = store_rows(anchors.withColumn("tile", F.pmod(F.xxhash64("anchor"), F.lit(tiles))), "anchors")
    own = anchors.select("tile", "anchor", "block")
    columns = ["tile", "anchor", "anchor_id", "label", "vector"]
    whole = [F.array(F.lit(v).cast("long")).alias(c) for c, v in (("at_least", -_BOUND), ("at_most", _BOUND))]
    found = _search(anchors.select(*columns, *whole), own, blocks, width, True, positives)

    score = F.col("score")
    windows = found.select("anchor", "vec_id", "score", (F.col("rank") - 1).cast("long").alias("window"))
    by_rank = F.sort_array(F.collect_list(F.struct("window", _up(score, low).alias("a"), _down(score, high).alias("b"))))
    ranges = windows.groupBy("anchor").agg(by_rank.alias("ranges"))
    ranges = ranges.select("anchor", F.col("ranges.a").alias("at_least"), F.col("ranges.b").alias("at_most"))
    wanted = store_rows(anchors.select(*columns).join(ranges, "anchor"), "windows")
    hits = _search(wanted, own.join(wanted.select("anchor"), "anchor", "left_semi"), blocks, width, False, negatives)
    positive = windows.select("anchor", "window", F.col("vec_id").alias("positive_id"), score.alias("positive_score"))
    named = hits.join(positive, ["anchor", "window"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return named.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
