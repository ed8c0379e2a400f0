"""Connected components of links between numbers, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, join_spread


def tidy(links: DataFrame) -> DataFrame:
    """Each link once, the smaller number as ``a``, without those of a number to itself."""
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for each number in ``links`` (columns a, b), where root is the smallest number reached.

    Each round hangs every node below its smallest neighbour, follows that up to the
    root by doubling, and puts roots in place of nodes in the links; links inside a tree go.
    At least half of the nodes that have links go with every round, a chain of any length in one.
    What is left is stored, so no round depends on more than the one before, and what no later round
    reads is deleted. Minimums are worked out before rows are shuffled, and nodes with many rows are
    joined where their rows are, so a node with many links and a root of many nodes are no hot spots.
    No links give an empty result. Links to null are left out.
    """
    store = Stored(links.sparkSession)
    rest, labels = store.keep(tidy(links), "rest"), None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        below = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        tree = to_roots(store.keep(below, "tree"), store)
        up = tree.select(F.col("node").alias("old"), F.col("up").alias("new"))
        if labels is None:
            labels = store.keep(tree.select("node", F.col("up").alias("root")), "labels")
        else:
            labels = store.keep(join_spread(labels, up, "root", "old", "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
        half = store.keep(join_spread(rest, up, "a", "old").select(F.col("new").alias("a"), "b"), "half")
        rest = store.keep(tidy(join_spread(half, up, "b", "old").select("a", F.col("new").alias("b"))), "rest")
    for name in ("tree", "half"):
        store.drop(name)
    return rest.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels


def to_roots(tree: DataFrame, store: Stored) -> DataFrame:
    """Each node below its root; the steps are the logarithm of the tree's height."""
    while True:
        above = tree.select(F.col("node").alias("parent"), F.col("up").alias("higher"))
        moved = join_spread(tree.select("node", "up"), above, "up", "parent").select("node", F.col("higher").alias("up"), (F.col("higher") != F.col("up")).alias("moved"))
        tree = store.keep(moved, "tree")
        if tree.where("moved").isEmpty():
            return tree.select("node", "up")
