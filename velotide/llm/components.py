"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velotide.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """Label the nodes of ``links`` (``a``, ``b``; any orderable type) by their smallest reachable node.

    Returns ``node``, ``label`` for every node with a link to another one; a node without links is
    its own component and has no row. Nulls are no nodes. Repeated links and links of a node to
    itself change nothing. Every round hangs the neighbours of a node below its smallest one, first
    the larger neighbours, then the smaller ones, so that chains shorten geometrically; rounds go on
    until no link changes. Each round is one aggregation with a map-side step and one join, and is
    written to the shared folder.
    """
    edges = stage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .distinct(),
        "links",
    )
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # Larger neighbours go to the smallest of the node and its neighbours.
        raised = (
            edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
            .join(least, "u")
            .select(F.col("w").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        raised = stage(raised, "large-star")
        # Smaller neighbours, and the node, go to the smallest neighbour.
        low = raised.groupBy("u").agg(F.min("v").alias("m"))
        hung = raised.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").where("u <> v").distinct()
        edges = stage(hung, "small-star")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(after) == before:
            break
        before = tuple(after)
    labels = edges.groupBy("u").agg(F.min("v").alias("label"))
    roots = edges.select(F.col("v").alias("node")).distinct()
    return labels.select(F.col("u").alias("node"), "label").union(
        roots.select("node", F.col("node").alias("label"))
    )
