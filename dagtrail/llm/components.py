"""Connected components by alternating stars.

Each round first ties every node's larger neighbours to the smallest node it knows, then its
smaller ones. Rounds shorten paths by a factor, so few are needed, and what is left at the
end is a star around the smallest node of each component. A round is stored before the
next one reads it. Nothing is gathered: a node with very many neighbours is met by joins that
Spark can split and by a minimum that is combined before the shuffle.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagtrail.sources.paths import store_rows


def _to_smallest(edges: DataFrame) -> DataFrame:
    """Edges with the smallest neighbour of their first node, itself included."""
    smallest = edges.groupBy("node").agg(F.min("near").alias("low"))
    return edges.join(smallest, "node").withColumn("low", F.least("node", "low"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("near").alias("node"), F.col("node").alias("near")))
    large = _to_smallest(both).where("near > node").select(F.col("near").alias("node"), F.col("low").alias("near"))
    known = _to_smallest(large.distinct())
    down = known.select(F.col("near").alias("node"), F.col("low").alias("near")).where("node <> near")
    own = known.select("node", F.col("low").alias("near"))
    return down.unionByName(own).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Changes whenever the set of edges does."""
    total = F.sum(F.xxhash64("node", "near").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), total).first())


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for every node that is not a root.

    `links` has two columns of nodes; order, repeats and links of a node to itself do not matter.
    """
    one, other = links.columns
    edges = links.where(F.col(one) != F.col(other)).select(
        F.greatest(one, other).alias("node"), F.least(one, other).alias("near")
    )
    edges = store_rows(edges.distinct(), "stars")
    mark = _mark(edges)
    while mark[0]:
        edges = store_rows(_round(edges), "stars")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select("node", F.col("near").alias("root"))
