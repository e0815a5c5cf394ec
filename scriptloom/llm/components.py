"""Connected components of a graph too large for one machine.

Each round sends every node to the neighbour (or itself) that comes first in that
round's pseudo-random order, and contracts the graph along this map. The image of a
connected graph is connected, so components stay whole, and a constant share of the
nodes goes in each round. Nothing is collected; every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import store

_MIX = (0x1B873593CC9E2D51, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85, 0x4CF5AD432745937F)


def _order(node: Column, turn: int) -> Column:
    """A bijection of longs, another in each round: rotate, then flip bits."""
    r = (17 * turn + 11) % 63 + 1
    return F.shiftleft(node, r).bitwiseOR(F.shiftrightunsigned(node, 64 - r)).bitwiseXOR(F.lit(_MIX[turn % 4]))


def _node(order: Column, turn: int) -> Column:
    r = (17 * turn + 11) % 63 + 1
    x = order.bitwiseXOR(F.lit(_MIX[turn % 4]))
    return F.shiftrightunsigned(x, r).bitwiseOR(F.shiftleft(x, 64 - r))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is a node of the
    same component, the same for all of it. Loops and repeated edges do no harm; no
    edges give no rows."""

    def clean(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    edges = store(clean(edges))
    labels = None
    turn = 0
    while labels is None or not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(_order(F.col("b"), turn)).alias("x"))
        to = store(first.select(F.col("a").alias("node"), _node(F.least("x", _order(F.col("a"), turn)), turn).alias("root")))
        if labels is None:
            labels = to
        else:
            later = to.select(F.col("node").alias("root"), F.col("root").alias("later"))
            labels = store(labels.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root")))
        for side in ("a", "b"):
            edges = edges.join(to.select(F.col("node").alias(side), F.col("root").alias("to")), side).drop(side).withColumnRenamed("to", side)
        edges = store(clean(edges.select("a", "b")))
        turn += 1
    return labels
