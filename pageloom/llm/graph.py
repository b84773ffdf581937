"""Connected components by repeated contraction, with joins and partial aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import stored


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an undirected edge table of longs; root is a node of the component.

    Each round hangs a node on its smallest neighbour (a min aggregate, so a hub with many edges is combined
    on the map side), jumps pointers twice and relabels the edges by parent. The remaining edges shrink until
    none is left; the per-round parent tables are then composed. Every table of a round is written and read again, so
    that plans (and what the optimizer takes tables to weigh, a product over joins) don't grow from round to round.
    """
    e = stored(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct(), "edges")
    levels: list[DataFrame] = []
    while not e.isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        for _ in range(2):
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("u", F.col("pp").alias("p"))
        parent = stored(parent, "parents")
        levels.append(parent)
        e = e.join(parent.select("u", F.col("p").alias("pu")), "u").join(parent.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        e = stored(e.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).where("u < v").distinct(), "edges")
    if not levels:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = levels[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for level in levels[1:]:
        out = out.join(level.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    return out
