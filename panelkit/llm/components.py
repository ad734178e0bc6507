"""Connected components of a link table, by alternating large and small stars; nothing leaves the executors."""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelkit.session import drop_scratch, scratch_path


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, "links")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest one around."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .filter("a != b").distinct())


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to its smallest neighbour. Edges have b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(least.select("a", F.col("low").alias("b"))).filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for the linked nodes of ``links (a, b)``; the root is the smallest node reachable.

    Each round is written to the shared folder, which cuts the lineage, and the one before is removed. Hot nodes are
    aggregated before they are shuffled and joined in a join that adaptive execution can split. Self-links and repeated
    links change nothing; an empty table gives an empty result.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    edges, path = _write(ordered)
    mark = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(seen) or not seen[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = tuple(seen)
        edges, after = _write(_small(_large(edges)))
        drop_scratch(edges.sparkSession, path)
        path = after


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 with links ``i`` to ``j``: the smallest node reachable."""
    root = np.arange(n)
    while len(i):
        above, below = root[i], root[j]
        low = np.minimum(above, below)
        np.minimum.at(root, above, low)   # a tree is hung up at its top, so all below follow
        np.minimum.at(root, below, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root
