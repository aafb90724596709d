"""PageRank over a sparse edge table: by iterated joins, or in memory for graphs of a checked, small size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.storage import cut


#: Nodes and different edges, together, up to which the driver iterates over arrays (some 20 bytes each).
IN_MEMORY = 2_000_000


def _in_memory(nodes: np.ndarray, src: np.ndarray, dst: np.ndarray, times: np.ndarray, damping: float, tol: float, max_iter: int) -> np.ndarray:
    """The ranks of sorted ``nodes``."""
    n = len(nodes)
    a, b = np.searchsorted(nodes, src), np.searchsorted(nodes, dst)
    degree = np.bincount(a, weights=times, minlength=n)
    weight, loose = times / degree[a], degree == 0
    rank = np.full(n, 1.0 / n)
    for _ in range(max_iter):
        before = rank
        coming = np.bincount(b, weights=before[a] * weight, minlength=n)
        rank = damping * (coming + before[loose].sum() / n) + (1 - damping) / n
        if np.abs(rank - before).sum() < tol:
            break
    return rank / rank.sum()


def compute(nodes: DataFrame, links: DataFrame, damping: float = 0.85, tol: float = 1e-6, max_iter: int = 100, in_memory: int = IN_MEMORY) -> DataFrame:
    """doc_id, pagerank for each doc_id of ``nodes``; they add up to 1.

    Every occurrence of a link (src, dst) between known nodes counts. A node
    without links gives its rank to all nodes alike. Iterations end when ranks
    move by less than ``tol`` in sum. Edges keep their partitioning by source,
    so each iteration shuffles ranks and contributions only; a node with very
    many links in is summed on the map side first. Graphs of up to ``in_memory``
    nodes and edges, which are counted first, take the same steps over arrays.
    """
    spark = nodes.sparkSession
    ids = nodes.select(F.col("doc_id").alias("node")).distinct()
    known = links.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    edges = cut(known.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times")))
    ids = cut(ids)
    if ids.count() + edges.count() <= in_memory:
        held = np.sort(ids.toArrow().column("node").to_numpy())
        if not len(held):
            return spark.createDataFrame([], "doc_id long, pagerank double")
        e = edges.toArrow()
        found = _in_memory(held, *(e.column(c).to_numpy() for c in ("src", "dst", "times")), damping, tol, max_iter)
        return spark.createDataFrame(pa.table({"doc_id": held, "pagerank": found}), "doc_id long, pagerank double")
    out = edges.groupBy("src").agg(F.sum("times").alias("degree"))
    weighted = cut(edges.join(out, "src").select("src", "dst", (F.col("times") / F.col("degree")).alias("weight")).repartition("src"))
    state = cut(ids.join(out.select(F.col("src").alias("node"), F.lit(True).alias("gives")), "node", "left").select("node", F.coalesce("gives", F.lit(False)).alias("gives")))
    n = state.count()
    ranks = state.withColumn("rank", F.lit(1.0 / n))
    loose = state.where("NOT gives").count() / n
    for _ in range(max_iter):
        coming = weighted.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("weight")).alias("coming"))
        moved = ranks.join(coming, ranks["node"] == coming["dst"], "left").select(
            "node", "gives", F.col("rank").alias("before"), (damping * (F.coalesce("coming", F.lit(0.0)) + loose / n) + (1 - damping) / n).alias("rank")
        )
        moved = cut(moved)
        row = moved.agg(F.sum(F.abs(F.col("rank") - F.col("before"))).alias("delta"), F.sum(F.when(~F.col("gives"), F.col("rank"))).alias("loose")).first()
        ranks, loose = moved.select("node", "gives", "rank"), row.loose or 0.0
        if row.delta < tol:
            break
    total = ranks.agg(F.sum("rank")).first()[0]
    return ranks.select(F.col("node").alias("doc_id"), (F.col("rank") / total).alias("pagerank"))
