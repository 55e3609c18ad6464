"""Connected components of a large edge table, by union-find and hooking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the edges, without the smallest
    nodes themselves: union-find with path halving."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[:len(a)].tolist(), at[len(a):].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([find(x) for x in range(len(names))], dtype=np.int64)
    moved = roots != np.arange(len(names))
    return names[moved], names[roots[moved]]


def _locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a partition by a spanning forest of stars; what is held
    is reduced after every batch."""
    a = b = np.zeros(0, dtype=np.int64)
    for batch in batches:
        a, b = forest(np.concatenate((a, batch.column(0).to_numpy())), np.concatenate((b, batch.column(1).to_numpy())))
    for first in range(0, len(a), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[first:first + 50_000]), pa.array(b[first:first + 50_000])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b: bigint, not null); the root is
    the smallest node of the component, and roots have no row of their own.

    Each round every component of what is left hooks to its smallest neighbour and
    the pointers double until they show to roots, so long chains close in a
    logarithmic number of steps.
    Edges of a partition are first reduced to a spanning forest, so what is moved is
    in proportion to the nodes.  Neighbour minima are pre-aggregated: a node with
    very many neighbours is no hot key.
    """
    left = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
                   .mapInArrow(_locally, "a bigint, b bigint"), "edges")
    roots: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("root"))
        hook = written(hook, "hooks")
        moving = True
        while moving:  # pointers double until all show to roots
            jump = hook.select(F.col("node").alias("root"), F.col("root").alias("__next"))
            jumped = written(hook.select("node", "root").join(jump, "root", "left").select(
                "node", F.coalesce("__next", "root").alias("root"),
                (F.col("__next") != F.col("root")).alias("__moved")), "hooks")
            moving, hook = not jumped.where("__moved").isEmpty(), jumped.select("node", "root")
        step = hook.where("node <> root")
        if roots is None:
            roots = step
        else:
            seen = roots.join(step.select(F.col("node").alias("root"), F.col("root").alias("__next")), "root", "left").select(
                "node", F.coalesce("__next", "root").alias("root"))
            # Nodes that hooked earlier are no longer in the edges that are left.
            roots = seen.unionByName(step)
        roots = written(roots, "roots")
        to = hook.select("node", "root")
        left = written(
            left.join(to.select(F.col("node").alias("a"), F.col("root").alias("__a")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("root").alias("__b")), "b")
            .select(F.col("__a").alias("a"), F.col("__b").alias("b")).where("a <> b")
            .mapInArrow(_locally, "a bigint, b bigint"), "edges")
    if roots is None:
        return edges.sparkSession.createDataFrame([], "node bigint, root bigint")
    return roots
