"""Connected components of a graph held in DataFrames, by contraction.

Every round maps each node to the smallest node among itself and its neighbours and replaces the
edges by those between the images. The number of nodes that still have edges at least halves, so
the rounds are few; nothing but a row count reaches the driver. Each round is written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.session import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of any type that orders -> ``(node, root)``: root is the smallest node reachable.

    Self loops and repeated edges do no harm; no edges give no rows. Null ends are dropped.
    """
    edges = edges.select("u", "v").where(F.col("u") < F.col("v")).unionByName(
        edges.select(F.col("v").alias("u"), F.col("u").alias("v")).where(F.col("u") < F.col("v"))
    )
    edges = stored(edges.distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        # the larger end of an edge can go down to the smaller; the smallest stay where they are
        down = stored(edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("to")), "down")
        # two steps at once where the image itself goes further down
        far = down.select(F.col("node").alias("to"), F.col("to").alias("further"))
        down = stored(down.join(far, "to", "left").select("node", F.coalesce("further", "to").alias("to")), "down")
        maps.append(down)
        a = edges.join(down.select(F.col("node").alias("u"), F.col("to").alias("x")), "u", "left")
        b = a.join(down.select(F.col("node").alias("v"), F.col("to").alias("y")), "v", "left")
        moved = b.select(F.coalesce("x", "u").alias("x"), F.coalesce("y", "v").alias("y")).where("x <> y")
        edges = stored(moved.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("root"))
    # from the last round back: a root of a later round may stand for nodes of an earlier one
    found = maps[-1].select("node", F.col("to").alias("root"))
    for down in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("to"), F.col("root").alias("later"))
        first = down.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("root"))
        found = first.unionByName(found.join(down.select("node"), "node", "left_anti"))
        found = stored(found, "roots")
    return found
