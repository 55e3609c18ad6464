"""Connected groups of rows that share ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def connected(df: DataFrame, id_col: str, links: Sequence[str]) -> DataFrame:
    """(id, group): rows that share a value of a link column, directly or by others, are
    in one group, named by its smallest id.  Null links join nothing.

    The graph of links is contracted: a row ties its smallest link to its others, and each
    round a link goes to its neighbour that comes first in a seeded order.  What is
    left is a graph of the places gone to, about half as large, so all rounds
    together cost little more than the first.  A link carries the smallest id below it; on the
    way back a link takes the name of the place it went to.  Minima are partial
    aggregates: a link with a third of the rows is no hot key there.
    """
    kinds = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n}:"), F.col(c).cast("string"))) for n, c in enumerate(links)])
    rows = df.select(F.col(id_col).alias("id"), kinds.alias("links"))
    held = stored(rows.where(F.col("id").isNotNull()).select("id", F.explode("links").alias("link")).distinct(), "links")
    ties = held.where(F.col("link").isNotNull())
    first = ties.groupBy("id").agg(F.min("link").alias("first"))
    vertices = ties.groupBy("link").agg(F.min("id").alias("least"))
    edges = stored(ties.join(first, "id").where(F.col("link") != F.col("first")).select(
        F.col("first").alias("a"), F.col("link").alias("b")).distinct(), "edges")
    steps = []
    while not edges.isEmpty():
        def place(c: str):
            return F.struct(F.xxhash64(F.col(c), F.lit(len(steps))).alias("at"), F.col(c).alias("link"))

        near = edges.select(F.col("a").alias("link"), place("b").alias("to")).unionByName(
            edges.select(F.col("b").alias("link"), place("a").alias("to"))).groupBy("link").agg(F.min("to").alias("to"))
        gone = stored(vertices.join(near, "link").select("link", "least", F.least(place("link"), F.col("to"))["link"].alias("to")), "gone")
        steps.append((vertices, gone))
        vertices = gone.groupBy(F.col("to").alias("link")).agg(F.min("least").alias("least"))
        moved = edges
        for end in ("a", "b"):
            moved = moved.join(gone.select(F.col("link").alias(end), F.col("to").alias("__to")), end).drop(end).withColumnRenamed("__to", end)
        edges = stored(moved.where(F.col("a") != F.col("b")).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    named = vertices.select("link", F.col("least").alias("group"))
    for below, gone in reversed(steps):
        found = gone.select("link", "to").join(named.withColumnRenamed("link", "to"), "to").select("link", F.col("group").alias("__group"))
        named = stored(below.join(found, "link", "left").select("link", F.coalesce("__group", "least").alias("group")), "named")
    lone = F.coalesce(F.col("group"), F.col("id"))
    ids = held.groupBy("id").agg(F.min("link").alias("link"))
    return ids.join(named, "link", "left").select(F.col("id").alias(id_col), lone.alias("group"))
