"""Near-duplicate embeddings by collision-counting projections.

Vectors with equal labels (and lengths) are projected to ``PROJECTIONS``
orthonormal directions. In each direction the candidates are sorted, and those
in the window around a query's value collide with it; pairs whose number of
collisions passes a count are verified by cosine in double precision. Window
and count are calibrated so that a pair at the threshold, whose difference has
length d = sqrt(2 - 2 * cosine) and a share of about d / sqrt(dimension) in each
direction, is missed with a probability of at most ``MISS``.

Pairs are counted where they meet: in ``TABLES`` grids, each over ``AXES`` of the
directions, in cells of ``WIDTH`` standard deviations of a threshold pair's difference
and shifted at random. Such a pair shares a direction's cell with probability
1 - sqrt(2 / pi) / WIDTH, so some grid's cell with 1 - (1 - 0.9^8)^20, all but 1.2e-5;
two unrelated vectors share a cell with some 0.0008, which leaves one in fifty of a
label's pairs. A pair belongs to the first grid in which it shares a cell, so each link
counts once. Cells of more than BLOCK vectors are cut into blocks, and each pair of
blocks is a group of its own, so memory is bounded whatever the size of a label, and
hot cells become more groups. A task returns, for each vector, how many it links with,
and for the components only a forest as its links would give it.

Equal vectors of a label are one node with a multiplicity. Cases: vectors that
are null, empty, zero, or hold null or non-finite components, and those without
a label, link with nothing and are their own component; a null vec_id counts as
a vector, and its component is null if all ids in it are null; repeated rows are
further vectors; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import connected_components, written

PROJECTIONS, BLOCK = 32, 1024
#: Half width of the counted windows, and width of the cells, in standard deviations of a threshold pair's difference.
NARROW, WIDTH = 1.5, 8.0
AXES, TABLES = 8, 20
#: Vectors of a group up to which its windows are compared pair by pair, which for few of them is faster than by sorting.
FEW = 64
#: Vectors that a task holds at a time besides a group that is larger; pairs verified at a time.
HELD, VERIFIED = 4096, 1 << 16
MISS = 1e-4
SEED = 20_240_229


def directions(dim: int) -> np.ndarray:
    """Orthonormal rows, the same for a dimension everywhere."""
    rng = np.random.default_rng(SEED + dim)
    q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    return q.T[: min(dim, PROJECTIONS)]


class Grid:
    """Cells of the grids for one dimension and threshold."""

    def __init__(self, dim: int, cosine: float):
        rng = np.random.default_rng(SEED - dim)
        self.axes = directions(dim)
        n = len(self.axes)
        self.chosen = np.stack([rng.choice(n, min(AXES, n), replace=False) for _ in range(TABLES)])
        self.width = WIDTH * spread(dim, cosine)
        self.shift = rng.random(self.chosen.shape)
        self.times = rng.integers(0, 1 << 63, self.chosen.shape, dtype=np.int64) * 2 + 1

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """A hash of the unit vector's cell in each grid."""
        place = np.floor((self.axes @ unit)[self.chosen] / self.width + self.shift).astype(np.int64)
        return (place * self.times).sum(1)


def least_collisions(n: int) -> int:
    """The count that a threshold pair reaches in n directions with probability 1 - MISS at least."""
    p = math.erf(NARROW / math.sqrt(2))
    missed, k = 0.0, 0
    while k < n and missed + (chance := math.comb(n, k) * p**k * (1 - p) ** (n - k)) <= MISS:
        missed += chance
        k += 1
    return k


def spread(dim: int, cosine: float) -> float:
    """Standard deviation, in one direction, of the difference of two unit vectors at the threshold."""
    return math.sqrt(2 - 2 * cosine) / math.sqrt(dim)


def collisions(queries: np.ndarray, others: np.ndarray, half: float) -> np.ndarray:
    """For each query and candidate, in how many columns the candidate is in the query's window."""
    count = np.zeros((len(queries), len(others)), np.uint8)
    for j in range(queries.shape[1]):
        order = np.argsort(others[:, j], kind="stable")
        line = others[order, j]
        lo = np.searchsorted(line, queries[:, j] - half, side="left").tolist()
        hi = np.searchsorted(line, queries[:, j] + half, side="right").tolist()
        for row, a, z in zip(count, lo, hi, strict=True):
            row[order[a:z]] += 1
    return count


def colliding_pairs(x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs (row of x, row of y) of unit vectors that collide often enough."""
    axes = directions(x.shape[1])
    count = collisions(x @ axes.T, y @ axes.T, NARROW * spread(x.shape[1], cosine) + 1e-9)
    return np.nonzero(count >= least_collisions(len(axes)))


def linked_pairs(x: np.ndarray, side: np.ndarray, first: np.ndarray, cells: np.ndarray, table: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked rows of x, of whole groups that begin at ``first``.

    side is 0 or 1 where two blocks meet, of which only pairs across count, and -1 in a
    group where all pairs do. cells has each row's cells in all grids, table the group's.
    """
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    axes = directions(x.shape[1])
    projected = (unit @ axes.T).astype(np.float32)
    half = np.float32(NARROW * spread(x.shape[1], cosine) + 1e-6)
    sizes = np.diff(np.append(first, len(x)))
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # groups of few vectors: all pairs (i, j), i after j, of all groups together
    place = np.arange(len(x)) - np.repeat(first, sizes)
    later = np.where(np.repeat(sizes, sizes) <= FEW, place, 0)
    for lo in range(0, len(x), HELD):
        n = later[lo : lo + HELD]
        i = np.repeat(np.arange(lo, lo + len(n)), n)
        j = i - np.repeat(place[lo : lo + HELD], n) + (np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n))
        across = (side[i] < 0) | (side[i] != side[j])
        i, j = i[across], j[across]
        for at in range(0, len(i), VERIFIED):
            a, b = i[at : at + VERIFIED], j[at : at + VERIFIED]
            good = (np.abs(projected[a] - projected[b]) <= half).sum(1) >= least_collisions(len(axes))
            found_a.append(a[good])
            found_b.append(b[good])
    for start, n in zip(first[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        rows = np.arange(start, start + n)
        if side[start] < 0:
            a, b = colliding_pairs(unit[rows], unit[rows], cosine)
            a, b = rows[a[a < b]], rows[b[a < b]]
        else:
            left, right = rows[side[rows] == 0], rows[side[rows] == 1]
            a, b = colliding_pairs(unit[left], unit[right], cosine)
            a, b = left[a], right[b]
        found_a.append(a)
        found_b.append(b)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    keep = [np.zeros(0, bool)]
    for at in range(0, len(a), VERIFIED):
        i, j = a[at : at + VERIFIED], b[at : at + VERIFIED]
        # of the grids in which a pair meets, only the first counts it
        own = (cells[i] == cells[j]).argmax(1) == table[i]
        dot = np.einsum("ij,ij->i", x[i], x[j])
        keep.append(own & (dot / (np.linalg.norm(x[i], axis=1) * np.linalg.norm(x[j], axis=1)) >= cosine))
    good = np.concatenate(keep)
    return a[good], b[good]


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges with the same components as the links a-b over n nodes: from each to the first one that it reaches."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(i), root(j)
        if p != q:
            parent[max(p, q)] = min(p, q)
    return [(i, r) for i in range(n) if (r := root(i)) != i]


def _packed(x: np.ndarray) -> bytes:
    """Little-endian doubles, or floats where these say the same."""
    single = x.astype("<f4")
    return single.tobytes() if np.array_equal(single.astype("<f8"), x) else x.tobytes()


def _unpacked(vecs: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8").astype("<f8") for v in vecs])


def _vectors(rows: DataFrame, cosine: float) -> DataFrame:
    """vec_id, label, dim, vec (packed; null if it can't link), cells (of all grids, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids: dict[int, Grid] = {}
        for b in batches:
            dims, vecs, cells = [], [], []
            for label, v in zip(b.column("label"), b.column("embedding"), strict=True):
                x = None
                if label.is_valid and v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                    scale = np.abs(x).max()
                    if not (np.isfinite(x).all() and scale > 0):
                        x = None
                if x is None:
                    dims.append(None), vecs.append(None), cells.append(None)
                    continue
                unit = x / scale
                unit = unit / np.linalg.norm(unit)
                dims.append(len(x))
                vecs.append(_packed(x / scale if scale > 1e100 or scale < 1e-100 else x))
                grid = grids.get(len(x)) or grids.setdefault(len(x), Grid(len(x), cosine))
                cells.append(grid.cells(unit).tolist())
            kinds = [pa.array(dims, pa.int32()), pa.array(vecs, pa.binary()), pa.array(cells, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), *kinds], ["vec_id", "label", "dim", "vec", "cells"])

    slim = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    return slim.mapInArrow(run, "vec_id long, label string, dim int, vec binary, cells array<long>")


def _dealt(reps: DataFrame) -> DataFrame:
    """kind (label and dimension), grid, place (a cell or two blocks of one), side, digest, rep, times, dim, vec, cells: a row for each group of a vector."""
    kind = F.xxhash64("label", "dim")
    met = reps.select(kind.alias("kind"), "node", F.posexplode("cells").alias("grid", "cell"))
    sizes = met.groupBy("kind", "grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # tables on both sides, so that Spark can split the join of a hot cell
    sizes = written(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "cells")
    block = F.pmod(F.xxhash64("node", "grid"), F.col("blocks")).cast("int")
    meet = F.expr("transform(sequence(0, blocks - 1), j -> struct(least(block, j) AS i, greatest(block, j) AS j, IF(blocks = 1 OR block = j, -1, CAST(block > j AS int)) AS side))")
    located = met.join(sizes, ["kind", "grid", "cell"]).withColumn("block", block).withColumn("m", F.explode(meet))
    located = located.select("kind", "grid", F.xxhash64("cell", "m.i", "m.j").alias("place"), F.col("m.side").alias("side"), "node")
    # only vectors that meet another one move
    whole = located.join(reps.select("node", "times", "dim", "vec", "cells"), "node")
    return whole.select("kind", "grid", "place", "side", "node.digest", "node.rep", "times", "dim", "vec", "cells")


def _links(dealt: DataFrame, cosine: float) -> DataFrame:
    """a_rep, a_digest, links: how many vectors a node's vectors link with; and a_..., b_...: edges that connect the same nodes."""
    schema = "a_rep long, a_digest long, b_rep long, b_digest long, links long"

    def told(t: pa.Table) -> pa.RecordBatch:
        """What whole groups of one dimension give."""
        dim = t.column("dim")[0].as_py()
        x = _unpacked(t.column("vec").to_pylist(), dim)
        key = np.stack([t.column(c).to_numpy() for c in ("place", "kind", "grid")], 1)
        first = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1)
        cells = t.column("cells").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        side, times = t.column("side").to_numpy(), t.column("times").to_numpy()
        a, b = linked_pairs(x, side, first, cells, key[:, 2], cosine)
        links = (np.bincount(a, times[b], len(x)) + np.bincount(b, times[a], len(x))).astype(np.int64)
        ends = np.array(spanning(a, b, len(x)), np.int64).reshape(-1, 2)
        linked = np.flatnonzero(links)
        rep, digest = t.column("rep").combine_chunks(), t.column("digest").combine_chunks()
        own, other = np.append(linked, ends[:, 0]), ends[:, 1]
        empty = pa.nulls(len(linked), pa.int64())
        columns = [rep.take(pa.array(own)), digest.take(pa.array(own)), pa.concat_arrays([empty, rep.take(pa.array(other))]), pa.concat_arrays([empty, digest.take(pa.array(other))]), pa.array(np.append(links[linked], np.zeros(len(ends), np.int64)))]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    def whole_groups(t: pa.Table, last: bool) -> Iterator[tuple[pa.Table, bool]]:
        """Runs of whole groups of one dimension, of HELD rows or one group; then the rows that may go on, marked False."""
        key = np.stack([t.column(c).to_numpy() for c in ("dim", "place", "kind", "grid")], 1)
        starts = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1)
        bounds = np.append(starts, t.num_rows) if last else starts
        at = 0
        while len(ahead := bounds[bounds > at]):
            same = ahead[key[ahead - 1, 0] == key[at, 0]]
            near = same[same <= at + HELD]
            stop = int(near[-1] if len(near) else same[0])
            yield t.slice(at, stop - at), True
            at = stop
        if at < t.num_rows:
            yield t.slice(at), False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        size = 0
        for b in batches:
            rest.append(pa.Table.from_batches([b]))
            size += b.num_rows
            if size < HELD:
                continue
            parts = list(whole_groups(pa.concat_tables(rest), False))
            rest, size = [], 0
            for part, done in parts:
                if done:
                    yield told(part)
                else:
                    rest, size = [part], 0
        if rest:
            for part, _ in whole_groups(pa.concat_tables(rest), True):
                yield told(part)

    order = ["place", "kind", "grid"]
    sorted_ = dealt.repartition(*order).sortWithinPartitions("dim", *order)
    return sorted_.mapInArrow(run, schema)


def near_duplicates(rows: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``rows`` (vec_id, embedding, label)."""
    vectors = written(_vectors(rows, cosine), "vectors")
    kinds = (
        vectors.where("vec IS NOT NULL")
        .groupBy("label", "dim", "vec")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"), F.first("cells").alias("cells"))
        .withColumn("digest", F.xxhash64("label", "dim", "vec"))
    )
    reps = written(kinds.withColumn("node", F.struct("rep", "digest")).drop("rep", "digest"), "vector-classes")
    found = _links(_dealt(reps), cosine)
    found = written(found.select(F.struct(F.col("a_rep").alias("rep"), F.col("a_digest").alias("digest")).alias("node"), F.when(F.col("b_digest").isNotNull(), F.struct(F.col("b_rep").alias("rep"), F.col("b_digest").alias("digest"))).alias("other"), "links"), "links")
    reached = connected_components(found.where("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = (
        reps.join(links, "node", "left")
        .join(reached, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .select("label", "dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "node.rep", "component")
    )
    classes = written(classes, "classes")
    smallest = written(classes.groupBy("component").agg(F.min("rep").alias("component_id")), "components")
    named = classes.join(smallest, "component").select("label", "dim", "vec", "n_links", "component_id")
    own = vectors.join(named, ["label", "dim", "vec"], "left")
    single = F.col("vec").isNull()
    component = F.when(single, F.col("vec_id")).otherwise(F.col("component_id"))
    return own.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op8_embeddup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT u, w FROM links
  UNION
  SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u
), low AS (SELECT u, min(w) AS m FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, low.m) AS component_id,
       e.vec_id = least(e.vec_id, low.m) AS kept
FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN low ON low.u = e.vec_id
"""
