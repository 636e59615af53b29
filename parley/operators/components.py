"""Connected components by alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): every step hooks nodes
to the smallest node in sight and keeps the components, until each component is one star.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.skew import PART_ROWS, salted_join
from parley.plans.storage import shared_dir


def _each(edges: DataFrame, *rows: tuple[Column, Column]) -> DataFrame:
    """Rows ``(node, low)`` of every edge, from one reading of it."""
    return edges.select(F.inline(F.array(*[F.struct(node.alias("node"), low.alias("low")) for node, low in rows])))


def _hooked(edges: DataFrame, smallest: DataFrame, few: bool) -> DataFrame:
    if few:  # too few rows for a hot node
        return edges.join(smallest.drop("n"), "node")
    return salted_join(edges, smallest.drop("n"), "node", smallest)


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Hook every larger neighbour of a node to the smallest node around it."""
    node, low = F.col("node"), F.col("low")
    both = _each(edges, (node, low), (low, node))
    smallest = both.groupBy("node").agg(F.min("low").alias("_min"), F.count("*").alias("n"))
    hooked = _hooked(both, smallest.select("node", F.least("node", "_min").alias("_low"), "n"), few)
    return hooked.filter(low > node).select(low.alias("node"), F.col("_low").alias("low"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Hook a node and its smaller neighbours to the smallest of them."""
    smallest = edges.groupBy("node").agg(F.min("low").alias("_low"), F.count("*").alias("n"))
    hooked = _hooked(edges, smallest, few)
    return _each(hooked, (F.col("low"), F.col("_low")), (F.col("node"), F.col("_low"))).filter("node > low")


def _state(edges: DataFrame) -> tuple[bool, int]:
    """Whether each component is a star, and the number of edges.

    In stars every node has one edge to a smaller one, which has none itself.
    """
    ends = _each(edges, (F.col("node"), F.lit(1)), (F.col("low"), F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("low").alias("up"), F.min("low").alias("least"))
    bad = F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("least") == 0)))
    n_bad, n = nodes.agg(bad, F.coalesce(F.sum("up"), F.lit(0))).first()
    return not n_bad, n


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; a component is its smallest node.

    Up to ``PART_ROWS`` rows of edges, the most that one part of a hot key may hold anyway, are worked on as one partition.
    """
    shared_dir(edges.sparkSession)
    a, b = F.col("a"), F.col("b")
    edges = edges.filter(a != b).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("low"))
    edges = edges.distinct().checkpoint()
    settled, n = _state(edges)
    while not settled:
        few = 2 * n <= PART_ROWS
        # Rows that the first half repeats do no harm to the second, whose result is made distinct.
        stars = _small_star(_large_star(edges.coalesce(1) if few else edges, few), few)
        edges = stars.distinct().checkpoint()
        settled, n = _state(edges)
    found = _each(edges, (F.col("node"), F.col("low")), (F.col("low"), F.col("low"))).distinct()
    return found.withColumnRenamed("low", "component")
