"""Connected components of a link table, by alternating stars; and small forests inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrid.operators.lineage import cut, cut_short, fewer


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For n places linked by pairs: the smallest place reachable from each."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        nxt = root.copy()
        np.minimum.at(nxt, root[left], low)
        np.minimum.at(nxt, root[right], low)
        nxt = np.minimum(nxt, nxt[nxt])
        nxt = nxt[nxt]
        if (nxt == root).all():
            return root
        root = nxt


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b: long), for each node in a link.

    Each round turns every node's links towards its smallest neighbour, first for larger neighbours and then for
    smaller ones, until a round changes nothing; the number of rounds grows with the logarithm of the longest chain.
    Only minima are aggregated, with partial minima before the exchange. The joins pair the links of a node with its one
    minimum, so adaptive execution splits a hub's links over tasks. No step makes more rows than the two sides of the
    links are, and steps run in tasks that these fill. Links with a null end, and from a node to itself, count for nothing.
    """
    big, small = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = cut_short(links.where("a <> b").select(big, small).distinct())
    rows = 2 * edges.count()
    few = lambda f: fewer(f, rows)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = few(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        edges = few(few(both.where("v > u").join(least, "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = few(edges.groupBy("u").agg(F.min("v").alias("m")))
        edges = few(edges.join(least, "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(few(edges))
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
