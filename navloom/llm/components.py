"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from navloom.session import cut_lineage

#: rows of a label table that go into one file
FILE_ROWS = 100_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every id in a link the smallest id reachable; nodes without links are not in it.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, and is
    written as a table; rounds grow with the logarithm of the longest shortest path. Joins are equi-joins that
    adaptive execution may split at hubs; the minima are taken before the shuffle.
    """
    pairs = F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("near")),
                    F.struct(F.col(b).alias("node"), F.col(a).alias("near")))
    edges = cut_lineage(links.where(F.col(a) != F.col(b)).select(F.inline(pairs)).distinct())
    files = edges.count() // FILE_ROWS + 4
    labels = cut_lineage(edges.groupBy("node").agg(F.least("node", F.min("near")).alias("root")).coalesce(files))
    while True:
        seen = edges.join(labels.select(F.col("node").alias("near"), "root"), "near").groupBy("node").agg(
            F.min("root").alias("least"))
        lower = labels.join(seen, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "least").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = cut_lineage(lower.join(up, "root").select(
            "node", "old", F.least("root", "above").alias("root")).coalesce(files))
        labels = new.select("node", "root")
        if not new.agg(F.count_if(F.col("root") < F.col("old"))).first()[0]:
            return labels


def with_more_links(roots: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The components once further links are known: only the graph of the old components is solved anew."""
    ends = links.select(F.explode(F.array(a, b)).alias("node")).distinct()
    known = cut_lineage(ends.join(roots, "node", "full_outer").select("node", F.coalesce("root", "node").alias("root")))
    side = lambda c, to: known.select(F.col("node").alias(c), F.col("root").alias(to))
    between = links.join(side(a, "_a"), a).join(side(b, "_b"), b).where("_a <> _b").select("_a", "_b")
    above = components(between, "_a", "_b").select(F.col("node").alias("root"), F.col("root").alias("above"))
    return cut_lineage(known.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
