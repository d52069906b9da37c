"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Every step is an aggregation of the smallest neighbour (combined on the map side, so a hub of any
degree is cheap) and an equi-join back (which adaptive execution splits where a hub makes it uneven).
Each round is cut by a table in the shared folder; no edge, label or component reaches the driver, only
one number a round.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Edges that one file of a round holds, about; rounds over few edges write few files.
EDGES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of the edge list that isn't its own root; the root is the smallest node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        apart = ru != rv
        if not apart.any():
            break
        ru, rv = ru[apart], rv[apart]
        low, high = np.minimum(ru, rv), np.maximum(ru, rv)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        first = np.concatenate(([True], high[1:] != high[:-1]))
        root[high[first]] = low[first]
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        u, v = u[apart], v[apart]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b`` long), the root being the component's smallest node.

    Null ends and self loops are ignored; an empty list gives an empty result.
    """
    now = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("m"))
        .distinct()
    )
    mark, files = None, max(1, math.ceil(now.count() / EDGES))
    while True:
        # large-star: every larger neighbour of u is linked to the smallest of u's neighbourhood
        both = now.union(now.select("m", "u"))
        least = both.groupBy("u").agg(F.min("m").alias("x")).select("u", F.least("u", "x").alias("x"))
        large = (
            now.join(least.withColumnRenamed("u", "m"), "m")  # u > m: u goes to the least of m
            .select("u", F.col("x").alias("m"))
            .where("u <> m")
            .distinct()
        )
        # small-star: u and its smaller neighbours are linked to the least of them
        low = large.groupBy("u").agg(F.min("m").alias("x"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("x").alias("m")), F.struct(F.col("m").alias("u"), F.col("x").alias("m")))).alias("e"))
            .select("e.u", "e.m")
            .where("u <> m")
            .distinct()
        )
        now = cut(small.coalesce(files))
        # a star forest that a round leaves as it is is the answer
        seen = now.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "m").cast("decimal(38,0)")).alias("h"),
        ).first()
        if (seen["n"], seen["h"]) == mark:
            return now.select(F.col("u").alias("node"), F.col("m").alias("root"))
        mark = (seen["n"], seen["h"])
