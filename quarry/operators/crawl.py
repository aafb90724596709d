"""A crawl as budgeted breadth-first search: one round is one set of joins."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarry.functions import html
from quarry.operators.pagerank import IN_MEMORY
from quarry.storage import cut

#: Rounds whose found pages are kept in tables of their own before they are merged into one.
SEEN_TABLES = 8
#: Links that one round of a walk over a large graph goes down at most.
HOPS = 8


def default_seeds(manifest: DataFrame) -> DataFrame:
    """topic, id: the first page by ``ord`` of each topic but the empty one and admin, by topic."""
    topics = manifest.withColumn("topic", html.topic_of(F.col("url"))).where("topic NOT IN ('', 'admin')")
    return topics.groupBy("topic").agg(F.min_by("id", "ord").alias("id")).orderBy("topic")


def links_of(manifest: DataFrame, disallowed: tuple[str, ...] = html.DISALLOWED) -> DataFrame:
    """id, target, place, allowed: outlinks of pages to known pages (manifest: id, url, outlinks)."""
    target = manifest.select(F.col("id").alias("target"), html.is_allowed(F.col("url"), disallowed).alias("allowed"))
    return manifest.select("id", F.posexplode("outlinks").alias("place", "target")).join(target, "target").select("id", "target", "place", "allowed")


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` with their number, from 0, in the order of ``by``; sorted in as many tasks as there are ranges."""
    ranges = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("range__", F.spark_partition_id()))
    sizes = sorted((r.range__, r.n) for r in ranges.groupBy("range__").agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    own = F.row_number().over(Window.partitionBy("range__").orderBy(*by)) - 1
    offset = rows.sparkSession.createDataFrame(offsets, "range__ int, offset__ long")
    return ranges.withColumn(name, own).join(F.broadcast(offset), "range__").withColumn(name, F.col(name) + F.col("offset__")).drop("range__", "offset__")


def _key(child: int, topic: Column, turn: Column, place: Column) -> Column:
    """Where a page waits: those of earlier rounds come first, then new ones by their page's turn and their place on it."""
    return F.struct(F.lit(child).alias("child"), topic.alias("topic"), turn.cast("long").alias("turn"), place.cast("long").alias("place")).alias("key")


def crawl(manifest: DataFrame, seeds: list[str] | None = None, max_pages: int | None = None, per_topic: int = 40, disallowed: tuple[str, ...] = html.DISALLOWED) -> tuple[DataFrame, dict]:
    """The pages in fetch order (id, fetch_ord, round, depth, outlinks that are known and allowed), and the crawl's figures.

    ``manifest``: id, url, ord, outlinks (in page order), and optionally
    present (false: the page's file is missing). In a round each topic gives
    its first ``per_topic`` waiting pages, topics in their order; the others
    wait in front of newly found ones. A round writes two tables, its turns and
    the pages that it finds; the fetch order of all rounds is numbered at the end.
    """
    spark = manifest.sparkSession
    own = manifest if "present" in manifest.columns else manifest.withColumn("present", F.lit(True))
    pages = cut(own.select("id", "ord", html.topic_of(F.col("url")).alias("topic"), html.is_allowed(F.col("url"), disallowed).alias("allowed"), "present"))
    links = cut(links_of(own, disallowed))
    if seeds is None:
        seeds = [r.id for r in default_seeds(own).collect()]
    figures = {"fetched": 0, "rounds": 0, "skipped_robots": 0, "skipped_missing": 0, "politeness_ticks": 0, "per_round_max": 0, "seeds": list(seeds)}
    asked = cut(spark.createDataFrame([(s, i) for i, s in enumerate(seeds)], "id string, pos long").join(pages, "id"))
    start = asked.groupBy("id").agg(F.min("pos").alias("pos"), *(F.first(c).alias(c) for c in ("topic", "allowed", "present")))
    queue = start.where("allowed").select("id", "topic", "present", _key(0, F.lit(""), F.col("pos"), F.lit(0)), F.lit(0).alias("depth"))
    seen, recent = start.select("id"), 0
    fetched = []
    left = max_pages
    while left is None or left > 0:
        turns = cut(queue.withColumn("turn", F.row_number().over(Window.partitionBy("topic").orderBy("key"))))
        now = F.col("turn") <= per_topic
        row = turns.agg(F.max("turn").alias("most"), F.count_if(now & F.col("present")).alias("n"), F.count_if(now & ~F.col("present")).alias("missing")).first()
        if not row.most:
            break
        taken, n, missing = turns.where(now), row.n, row.missing
        if left is not None and n > left:
            # the budget ends within this round: with the last page that it still fetches
            last = taken.where("present").orderBy("topic", "turn").limit(left).agg(F.max(F.struct("topic", "turn")).alias("last")).first().last
            at = F.struct("topic", "turn") <= F.struct(F.lit(last.topic).alias("topic"), F.lit(last.turn).alias("turn"))
            taken, n = taken.where(at), left
            missing = taken.where("NOT present").count()
        figures["rounds"] += 1
        figures["skipped_missing"] += missing
        figures["per_round_max"] = max(figures["per_round_max"], min(row.most, per_topic))
        figures["fetched"] += n
        got = taken.where("present").select("id", F.lit(figures["rounds"]).alias("round"), "topic", "turn", "depth")
        fetched.append(got)
        if left is not None:
            left -= n
            if left <= 0:
                break
        found = links.where("allowed").join(got, "id")
        first = F.struct("topic", "turn", "place")
        fresh = found.groupBy("target").agg(F.min(first).alias("first"), F.min_by("depth", first).alias("depth")).withColumnRenamed("target", "id")
        fresh = cut(fresh.join(seen, "id", "left_anti"))
        recent += 1
        seen = seen.union(fresh.select("id"))
        if recent == SEEN_TABLES:
            seen, recent = cut(seen), 0
        waiting = turns.where(~now).select("id", "topic", "present", _key(0, F.col("topic"), F.col("turn"), F.lit(0)), "depth")
        children = fresh.join(pages, "id").select("id", "topic", "present", _key(1, F.col("first.topic"), F.col("first.turn"), F.col("first.place")), (F.col("depth") + 1).alias("depth"))
        queue = waiting.union(children)
    figures["politeness_ticks"] = figures["fetched"]
    figures["skipped_robots"] = asked.where("NOT allowed").count()
    if not fetched:
        return spark.createDataFrame([], "id string, fetch_ord long, round int, depth int, outlinks array<string>"), figures
    order = cut(numbered(reduce(DataFrame.union, fetched), ["round", "topic", "turn"], "fetch_ord").select("id", F.col("fetch_ord").cast("long").alias("fetch_ord"), "round", "depth"))
    figures["skipped_robots"] += links.where("NOT allowed").join(order, "id", "left_semi").count()
    kept = links.where("allowed").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "target"))), lambda x: x.target).alias("outlinks"))
    return order.join(kept, "id", "left").select("id", "fetch_ord", "round", "depth", F.coalesce("outlinks", F.array().cast("array<string>")).alias("outlinks")), figures


def _levels(src: pa.Array, dst: pa.Array, roots: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The nodes that links reach from ``roots``, and their depths."""
    names = pa.concat_arrays([roots, src, dst]).dictionary_encode()
    codes = names.indices.to_numpy()
    level, a, b = np.split(codes, [len(roots), len(roots) + len(src)])
    b = b[np.argsort(a, kind="stable")]
    degree = np.bincount(a, minlength=len(names.dictionary))
    start = np.cumsum(degree) - degree
    depths = np.full(len(names.dictionary), -1, dtype=np.int32)
    depth = 0
    while len(level):
        depths[level] = depth
        n = degree[level]
        to = b[np.repeat(start[level] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        level, depth = np.unique(to[depths[to] < 0]), depth + 1
    reached = np.flatnonzero(depths >= 0)
    return names.dictionary.take(pa.array(reached)), depths[reached]


def bfs_depths(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, in_memory: int = IN_MEMORY) -> DataFrame:
    """node, depth of every node that edges (src, dst) reach from ``roots`` (node), at any depth or up to ``max_depth``.

    Nulls are no nodes. Graphs of up to ``in_memory`` different edges and roots, which are
    counted first, are walked over arrays. Others take rounds, each a chain of joins that
    goes up to HOPS levels down from the last round's deepest level: along it a node stays
    by a link of no length to itself, and of its ways the shortest counts.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    edges = cut(edges.select("src", F.col("dst").cast(kind)).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    level = cut(roots.select(F.col("node").cast(kind)).where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    if max_depth is None and edges.count() + level.count() <= in_memory:
        e, r = edges.toArrow(), level.select("node").toArrow()
        nodes, depths = _levels(*(x.combine_chunks() for x in (e.column("src"), e.column("dst"), r.column("node"))))
        return spark.createDataFrame(pa.table({"node": nodes, "depth": depths}), level.schema)
    stays = level.select("node").union(edges.select(F.col("dst").alias("node"))).distinct()
    ways = edges.withColumn("length", F.lit(1)).union(stays.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("length")))
    ways = cut(ways.repartition("src"))
    found, recent, depth = level, 0, 0
    while max_depth is None or depth < max_depth:
        # deep graphs are walked in larger steps; shallow, wide ones would meet their links too often so
        hops = min(HOPS, 1 + depth // 4, HOPS if max_depth is None else max_depth - depth)
        for _ in range(hops):
            level = ways.join(level.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("length")).alias("depth"))
        fresh = cut(level.join(found, "node", "left_anti"))
        found, recent, depth = found.union(fresh), recent + 1, depth + hops
        if recent == SEEN_TABLES:
            found, recent = cut(found.repartition("node")), 0
        level = fresh.where(F.col("depth") == depth)
        if not level.head(1):
            break
    return found
