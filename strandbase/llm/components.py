"""Connected components of a graph given as an edge table, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, fresh_path, make_folder, materialise

#: A node with more edges is a hub.
HUB = 1 << 12
MOST_HUBS = 100_000


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) of the graph of pairs (a, b), at most one for each node."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        open_ = p != q
        if not open_.any():
            break
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows`` (u, v) with m, the least node that ``ends`` (u, m, n) has for u.

    Hubs, whose rows would meet in one task, are joined by a broadcast of their (u, m),
    if they are counted to be few: as one has HUB edges or more, they are by far fewer than
    edges.  If not, they are dealt over salts.
    """
    hubs = ends.where(F.col("n") > HUB).select("u", "m", "n")
    number = hubs.count()
    if not number:
        return rows.join(ends.select("u", "m"), "u")
    if number <= MOST_HUBS:
        few = F.broadcast(hubs.select(F.col("u").alias("h"), F.col("m").alias("hm")))
        marked = rows.join(few, F.col("u") == F.col("h"), "left")
        plain = marked.where("h is null").select("u", "v").join(ends.where(F.col("n") <= HUB).select("u", "m"), "u")
        return plain.unionByName(marked.where("h is not null").select("u", "v", F.col("hm").alias("m")))
    salts = 64
    spread = ends.select("u", "m", F.explode(F.when(F.col("n") > HUB, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    known = rows.join(hubs.select("u", F.lit(salts).alias("k")), "u", "left")
    return known.withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("k", F.lit(1))).cast("int")).join(spread, ["u", "salt"]).select("u", "v", "m")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its least node.

    Each round joins every node's least neighbour to its edges; least nodes are
    pre-aggregated, hubs joined apart.  A round's edges are deleted after the next.
    """
    spark = edges.sparkSession
    work = make_folder(spark, fresh_path(spark, "components"))
    round_path = lambda k: make_folder(spark, f"{work}/{k}")
    now = round_path(0)
    edges = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", under=now)
    before = _digest(edges)
    for k in range(1, most_rounds + 1):
        old, now = now, round_path(k)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least", under=old)
        # every larger neighbour is tied to the node's least neighbour
        large = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialise(large, "large", under=old)
        # every node and its smaller neighbours are tied to the least of them
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low", under=old)
        small = _with_least(large, low).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialise(small.where("u != v").distinct(), "edges", under=now)
        after = _digest(edges)
        drop(spark, old)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no components after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
