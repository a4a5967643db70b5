"""Connected components of an edge table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.shared import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of the edges (a, b); component is its smallest node.

    Each round hangs the nodes of a neighbourhood below its smallest node, first the
    larger neighbours, then the smaller ones, until nothing changes; the number of rounds
    grows with the logarithm of the nodes. No neighbourhood is gathered: a round is a
    grouped minimum and a join, so that a hub is reduced before it is moved. Every round
    is written to shared storage. Edges with a null end are left out; an edge from a node
    to itself makes a component. No edges, no rows.
    """
    whole = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    current = stored(
        whole.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = None
    while state != (state := _state(current)):
        current = stored(_small_star(_large_star(current)), "edges")
    heads = current.select(F.col("b").alias("id"))
    return (
        current.select(F.col("a").alias("id"), F.col("b").alias("component"))
        .where("id <> component")
        .unionByName(heads.distinct().select("id", F.col("id").alias("component")))
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node go below the smallest one of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b >= a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, go below the smallest one."""
    down = edges.where("b <= a")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
