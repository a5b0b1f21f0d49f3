"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.tables import release, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) -> (node, component): every node that has an edge to another, with the smallest node reachable.

    Contraction under a new random order each round: every node points to the first of itself and its neighbours, the
    pointers are followed twice, and the edges move to where they end. The last node of a component is never pointed
    to, and of a path about a third of the nodes are, so the rounds are logarithmic in the number of nodes for paths of
    rising ids as for stars. The pointers are then composed, and the smallest node of each component becomes its name.
    Nothing but the end of the rounds reaches the driver. Repeated edges do no harm; self-loops and edges with a null
    end are dropped.
    """
    plain = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    live = stage(plain.select(F.col("u").cast("long"), F.col("v").cast("long")), "edges")
    levels: list[DataFrame] = []
    while True:
        turn = F.lit(len(levels))
        both = live.select("u", "v").union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = F.xxhash64("v", turn)
        first = both.groupBy("u").agg(F.min_by("v", order).alias("v"), F.min(order).alias("h"))
        pointers = stage(first.select("u", F.when(F.xxhash64("u", turn) < F.col("h"), F.col("u")).otherwise(F.col("v")).alias("v")), "pointers")
        if levels and pointers.isEmpty():
            release(pointers, live)
            break
        onward = pointers.select(F.col("u").alias("v"), F.col("v").alias("label"))
        labels = stage(pointers.join(onward, "v").select("u", "label"), "labels")
        levels.append(labels)
        left = labels.select(F.col("u"), F.col("label").alias("a"))
        right = labels.select(F.col("u").alias("v"), F.col("label").alias("b"))
        moved = live.join(left, "u").join(right, "v").where("a <> b")
        used, live = live, stage(moved.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "contracted")
        release(used, pointers)
    # From the last level down, which are small: where each label of the level above ends up.
    ends = levels.pop()
    while levels:
        last, above = ends, levels.pop()
        onward = last.select(F.col("u").alias("label"), F.col("label").alias("end"))
        ends = stage(above.join(onward, "label", "left").select("u", F.coalesce("end", "label").alias("label")), "ends")
        release(last, above)
    least = ends.groupBy("label").agg(F.min("u").alias("component"))
    out = stage(ends.join(least, "label").select(F.col("u").alias("node"), "component"), "components")
    release(ends)
    return out
