"""Exact top-k search by inner product, in tiles.

Vectors and queries are dealt over a grid: a vector belongs to one row of tiles and is sent to
each of its columns, a query belongs to one column and is sent to each row, so every pair
meets in one tile. A tile is one matrix product and a partial selection for each query; the
tiles' short lists are merged up a tree. A tile holds a bounded number of vectors and queries,
whatever their number.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagtrail.sources.paths import store_rows

K = 20
SCALE = 64
# Vectors and queries of a full tile; smaller ones are made where they leave cores idle.
TILE_VECTORS = 4096
TILE_QUERIES = 1024
TILES_PER_CORE = 4
LEAST_VECTORS = 256
# Lists that one merge of the tree takes.
FAN = 16
# Inner products up to this are exact as 64-bit floats.
EXACT = float(1 << 53)

_HITS = "array<struct<minus_score:bigint,vec_id:bigint>>"


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and the vector of floor(64 * x), x as double, as longs.

    Vectors that are null, or hold a null or non-finite component, are left out; so are null ids.
    """
    x = F.transform(F.col(embedding).cast("array<double>"), lambda v: F.floor(v * SCALE))
    usable = F.forall(
        F.col(embedding).cast("array<double>"),
        lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))),
    )
    return vectors.where(usable & F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("vec_id"), x.alias("vector"))


def _tiles(vectors: int, queries: int, cores: int) -> tuple[int, int]:
    """Rows and columns of the grid."""
    rows, columns = -(-vectors // TILE_VECTORS), -(-queries // TILE_QUERIES)
    wanted = TILES_PER_CORE * cores
    while rows * columns < wanted and vectors > LEAST_VECTORS * rows:
        rows += 1
    return max(rows, 1), max(columns, 1)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, width)


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as integers."""
    a, b = np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0)
    if float(a) * float(b) * queries.shape[1] < EXACT:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    return queries @ vectors.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores, ties to smaller ids; `ids` ascends."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores > least)
        at = np.concatenate([at, np.flatnonzero(scores == least)[: k - len(at)]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors of each query among all other rows.

    `vectors` has vec_id and vector (array of longs; shorter ones are filled with zeros). Rows are told
    apart, so a repeated id is searched for and found as often as it occurs. An empty table gives none.
    """
    rows = store_rows(vectors.select("vec_id", "vector").withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("vector")).alias("w"))
    n, q, longest = sizes.first()
    width = max(longest or 0, 1)
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vector"))
    rows = rows.withColumn("vector", F.concat("vector", zeros))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    grid_rows, grid_columns = _tiles(n, q, cores)
    # running numbers would fall into few tiles; their hash does not
    of_row = F.pmod(F.xxhash64("row"), F.lit(grid_rows)).alias("down")
    of_column = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(grid_columns)).alias("across")
    all_rows = F.explode(F.sequence(F.lit(0), F.lit(grid_rows - 1)).cast("array<bigint>")).alias("down")
    all_columns = F.explode(F.sequence(F.lit(0), F.lit(grid_columns - 1)).cast("array<bigint>")).alias("across")
    # the two sides of a cogroup must not share columns
    spread = rows.select(*[F.col(c).alias(c) for c in ("vec_id", "row", "vector")], of_row, all_columns)
    names = {"vec_id": "query_id", "row": "query_row", "vector": "query"}
    asked = rows.where(is_query).select(*[F.col(c).alias(n) for c, n in names.items()], all_rows, of_column)

    def tile(asked: pa.Table, found: pa.Table) -> pa.Table:
        made: dict[str, list] = {c: [] for c in types}
        if len(asked) and len(found):
            found = found.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            ids, row = (found[c].to_numpy() for c in ("vec_id", "row"))
            scores = _scores(_matrix(asked["query"], width), _matrix(found["vector"], width))
            names = ("query_row", "query_id", "down")
            for own, query_id, down, line in zip(*(asked[c].to_pylist() for c in names), scores, strict=True):
                at = _best(line, ids, k + 1)
                at = at[row[at] != own][:k]
                hits = zip((-line[at]).tolist(), ids[at].tolist(), strict=True)
                made["query_row"].append(own)
                made["query_id"].append(query_id)
                made["down"].append(down)
                made["hits"].append([{"minus_score": s, "vec_id": v} for s, v in hits])
        return pa.table({c: pa.array(v, types[c]) for c, v in made.items()})

    hit = pa.list_(pa.struct([("minus_score", pa.int64()), ("vec_id", pa.int64())]))
    types = {"query_row": pa.int64(), "query_id": pa.int64(), "down": pa.int64(), "hits": hit}
    cells = ["down", "across"]
    lists = (
        asked.groupBy(*cells)
        .cogroup(spread.groupBy(*cells))
        .applyInArrow(tile, f"query_row long, query_id long, down long, hits {_HITS}")
    )
    while grid_rows > 1:
        grid_rows = -(-grid_rows // FAN)
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k)
        lists = (
            lists.withColumn("down", F.floor(F.col("down") / FAN))
            .groupBy("query_row", "query_id", "down")
            .agg(merged.alias("hits"))
        )
    hits = lists.select("query_id", F.posexplode("hits").alias("at", "hit"))
    return hits.select(
        "query_id",
        (F.col("at") + 1).alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.minus_score")).alias("score"),
    )
