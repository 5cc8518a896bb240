"""Connected components by alternating large-star and small-star steps: DataFrame operations only.

Every step is an aggregation by node with partial sums and a join back; edges of a node with many
neighbours are spread by the join's skew handling, and lineage is cut with reliable checkpoints. What a step has shuffled
is let go before the next one. Up to ``FEW`` edges are one partition, whose steps need no shuffle. The steps go on to the
fixed point, which takes a number of rounds in the order of the logarithm of the nodes; an unfinished labelling is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import cut, free


#: So many edges fit one task, whatever the number of shuffle partitions.
FEW = 1 << 16


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """Edges to (node, component), the component being its smallest node. Nodes without an edge are absent."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    e = cut(edges.filter(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct())
    free(edges.sparkSession)
    state, whole = None, lambda df: df
    for _ in range(most):
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())
        whole = (lambda df: df.coalesce(1)) if now[0] <= FEW else lambda df: df
        e = whole(e)
        if now == state or not now[0]:
            break
        state = now
        both = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("_e")).select("_e.*")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("x2"), F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(least, F.col("x") == F.col("x2")).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), "m")
        small = large.join(low, F.col("u") == F.col("u2")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(whole(small.unionByName(low.select(F.col("u2").alias("u"), F.col("m").alias("v")))).distinct())
        free(edges.sparkSession)
    else:
        raise RuntimeError(f"components: no fixed point after {most} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
