"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the least node that each node of the edges is connected with.

    Two star steps take turns: larger neighbours of a node are tied to its least neighbour, then smaller
    ones are, until nothing changes. Least neighbours are minima combined on the map side; rounds are
    tables in the checkpoint folder, and their number grows with the logarithm of the longest chain.
    The least node of a component has no row of its own.
    """
    pair = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
    tied = materialize(pair.filter("x <> y").distinct(), "edges")
    state = None
    while True:
        both = tied.union(tied.select("y", "x"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        upward = both.join(least, "x").filter("y > x AND y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        least = upward.groupBy("x").agg(F.min("y").alias("m"))
        ends = F.array(F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct("x", F.col("m").alias("y")))
        downward = upward.join(least, "x").select(F.explode(ends).alias("e")).select("e.*")
        tied = materialize(downward.filter("x <> y").distinct(), "edges")
        last, state = state, tied.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if state == last:
            return tied.select(F.col("x").alias("node"), F.col("y").alias("component"))
