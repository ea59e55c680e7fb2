"""Connected components and the groups built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.plans.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge list of longs; component is the smallest node id.

    Random-mate contraction: in each round every node adopts its neighbour (or itself) of least hashed
    priority, the edges are rewritten to the adopted nodes, and loops and repeats go. The expected number of
    edges falls by a constant factor, so long chains need a logarithmic number of rounds, and a star's hub is
    only ever the key of a partial aggregate or of a join AQE can split. The maps of all rounds are then
    composed from the last to the first. Null ends and self loops are ignored.
    """
    live = edges.select(F.least(F.col(a), F.col(b)).alias("a"), F.greatest(F.col(a), F.col(b)).alias("b"))
    live = cut(live.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct())
    maps: list[DataFrame] = []
    for k in range(max_rounds):
        if live.isEmpty():
            break
        both = live.union(live.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), c.alias("n"))  # noqa: B023, E731
        rep = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        rep = cut(rep.select(F.col("a").alias("node"), F.least(F.col("m"), order(F.col("a")))["n"].alias("up")))
        maps.append(rep)
        left, right = rep.toDF("a", "ra"), rep.toDF("b", "rb")
        to = live.join(left, "a").join(right, "b").where("ra <> rb")
        live = cut(to.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    if not maps:
        return edges.sparkSession.createDataFrame([], "node long, component long")

    def compose(later: DataFrame, earlier: DataFrame) -> DataFrame:
        up = later.toDF("up", "root")
        return earlier.join(up, "up", "left").select("node", F.coalesce("root", "up").alias("up"))

    rooted = cut(reduce(compose, reversed(maps)).toDF("node", "root"))
    least = rooted.groupBy("root").agg(F.min("node").alias("component"))
    return rooted.join(least, "root").select("node", "component")
