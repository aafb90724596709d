"""SimHash near-duplicates with a pigeonring filter.

A text's words (A-Z lower-cased, split at ASCII white space) form shingles of
``words_per_shingle`` words, repeats included; a fingerprint bit is set if it
is set in more than half of the shingles' XXH64 hashes (seed 42).

Pairs within ``max_bits`` of 64 bits are found exactly. The bits are cut into
``max_bits + 1`` ring-ordered segments. Where two fingerprints differ in at
most t bits, some segment starts a chain whose first l segments differ in at
most floor(l * t / (t + 1)) bits for every l: its first segment is equal, and
the next one differs in at most one bit. So each fingerprint is filed under its
pairs of neighbouring segments, and looked up under the same pairs and those
with one zero bit of the second segment raised. The chain budgets of all
lengths and the full Hamming distance are tested inside the join, which returns
each pair once: under the first segment whose chain holds.

Equal fingerprints count as one node, so groups of exact copies never meet in
a join.

``near_duplicates`` links by those bits alone. ``one_of_each`` links by similarity:
the Jaccard similarity of the sets of shingles, counted over the whole sets, of at
least ``least``. One fingerprint cannot propose such pairs: at a similarity of 0.8 two
bits in thirteen differ, and 4 of 64 are kept by one pair in thirty. So beside the
fingerprint of the whole set, whose pairs within ``max_bits`` come from the ring,
each set has ``SAMPLES`` fingerprints of min-wise samples: of the shingles that come
first in ``DRAWN`` orders of all hashes. Those of two sets of similarity s are equal
with probability s^DRAWN at least, so a pair meets with probability
1 - (1 - s^5)^16 at least: 0.998 at 0.8, more above. Such prints are asked for equality
only, a ring of one segment.

Texts that meet form a bucket, and are not paired off at once. First each text is
counted against one of its bucket, another one for each print; then, in buckets
that the links found so far leave apart, all texts of different components. So the
components are those of all pairs that meet, and a large group of near copies costs a
few pairs for each text. In a bucket of texts that meet but aren't linked the counting
grows with the square, inside a join that returns links only.

Cases: a null or blank text has fingerprint 0 and the one shingle 0, and is linked like
any other; a text of fewer words than a shingle is one shingle; repeated rows share
fingerprint and component; the component of documents whose ids are all null is null;
of rows that share id and text ``one_of_each`` keeps the one whose other columns, as
JSON, come first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import connected_components, trim, written

BITS, SEED = 64, 42
#: Shingles hashed before their bits are added up, and put in all orders at a time; texts taken from a batch at a time.
BLOCK, ORDERED, ROWS = 1 << 15, 1 << 10, 500
#: Fingerprints of min-wise samples, and shingles drawn for each; an odd number has no ties.
SAMPLES, DRAWN = 16, 5
LEAST = 0.8

_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 1 << 64, SAMPLES * DRAWN, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 64, SAMPLES * DRAWN, dtype=np.uint64) | np.uint64(1)


def _hashes(text: str | None, words_per_shingle: int) -> Iterator[np.ndarray]:
    """The hashes of the text's shingles in turn, a block at a time; none for a blank text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    for at in range(0, max(1, len(words) - words_per_shingle + 1) if words else 0, BLOCK):
        part = words[at : at + BLOCK + words_per_shingle - 1]
        runs = [part] if len(part) < words_per_shingle else zip(*(part[i:] for i in range(words_per_shingle)), strict=False)
        yield np.fromiter((digest(b" ".join(x), SEED) for x in runs), np.uint64)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set: over the last axis but one of (..., n) hashes."""
    return np.unpackbits(hashes[..., None].view(np.uint8), axis=-1, bitorder="little").sum(-2, dtype=np.int64)


def fingerprint(text: str | None, words_per_shingle: int) -> int:
    """The 64-bit fingerprint, unsigned."""
    counts, shingles = np.zeros(BITS, np.int64), 0
    for hashes in _hashes(text, words_per_shingle):
        counts += _set_bits(hashes)
        shingles += len(hashes)
    return int(np.packbits(counts * 2 > shingles, bitorder="little").view("<u8")[0])


def shingle_set(text: str | None, words_per_shingle: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; a blank text has the hash 0."""
    found = list(_hashes(text, words_per_shingle))
    return np.unique(np.concatenate(found)) if found else np.zeros(1, np.uint64)


def prints_of_set(own: np.ndarray) -> np.ndarray:
    """The fingerprint of the whole set, then those of its min-wise samples."""
    counts = np.zeros(BITS, np.int64)
    best, first = np.full(SAMPLES * DRAWN, np.iinfo(np.uint64).max), np.zeros(SAMPLES * DRAWN, np.uint64)
    for at in range(0, len(own), ORDERED):
        part = own[at : at + ORDERED]
        counts += _set_bits(part)
        order = (part[:, None] ^ _FLIP) * _TIMES
        place = order.argmin(0)
        rank = np.take_along_axis(order, place[None], 0)[0]
        better = rank <= best
        best[better], first[better] = rank[better], part[place[better]]
    samples = _set_bits(first.reshape(SAMPLES, DRAWN)) * 2 > DRAWN
    bits = np.concatenate([(counts * 2 > len(own))[None], samples])
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _by_text(rows: DataFrame, kept: list[str], make, schema: str) -> DataFrame:
    """The columns ``kept`` of ``rows``, then those that ``make`` gives as arrays for a list of texts."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *make(b.column("text").to_pylist())], names)
            trim()

    return rows.select(*kept, "text").mapInArrow(run, schema)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    stops = np.append(0, np.cumsum([len(x) for x in arrays])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in arrays)])))


def fingerprints(docs: DataFrame, words_per_shingle: int = 5) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for each row of ``docs``."""

    def make(texts: list) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, words_per_shingle) for t in texts], np.uint64).view(np.int64))]

    return _by_text(_keyed(docs), ["doc_id"], make, "doc_id long, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the max_bits + 1 segments."""
    edges = [round(i * BITS / (max_bits + 1)) for i in range(max_bits + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def near_pairs(nodes: DataFrame, max_bits: int = 4) -> DataFrame:
    """u, v: all pairs of the distinct longs ``fp`` of ``nodes`` that differ in 1 to ``max_bits`` bits."""
    if not 1 <= max_bits <= 7:
        raise ValueError("max_bits must be from 1 to 7")
    seg = segments(max_bits)
    m = len(seg)
    # a few bytes a node, but dozens of keys each: as many tasks as the keys will need
    nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")

    def cut(word: str, i: int) -> str:
        first, width = seg[i % m]
        return f"(shiftrightunsigned({word}, {first}) & {(1 << width) - 1}L)"

    def key(i: int, second: str) -> str:
        return f"struct({i} AS chain, shiftleft({cut('fp', i)}, 32) | {second} AS part)"

    filed = [key(i, cut("fp", i + 1)) for i in range(m)]
    raised = [
        f"CASE WHEN ({cut('fp', i + 1)} & {1 << b}L) = 0 THEN {key(i, f'({cut("fp", i + 1)} | {1 << b}L)')} END"
        for i in range(m)
        for b in range(seg[(i + 1) % m][1])
    ]
    # every segment's difference, then whether the chain that starts at i keeps all its budgets
    diff = "(a.fp ^ b.fp)"
    apart = [f"bit_count({cut(diff, i)})" for i in range(m)]
    holds = [
        " AND ".join(f"{' + '.join(apart[(i + j) % m] for j in range(n))} <= {n * max_bits // m}" for n in range(1, m + 1))
        for i in range(m)
    ]
    first = "CASE " + " ".join(f"WHEN {x} THEN {i}" for i, x in enumerate(holds)) + " END"
    build = nodes.select("fp", F.explode(F.expr(f"array({', '.join(filed)})")).alias("k")).select("fp", "k.*")
    probe = (
        nodes.select("fp", F.explode(F.expr(f"array({', '.join(filed + raised)})")).alias("k"))
        .where("k IS NOT NULL")
        .select("fp", "k.*")
    )
    whole = " OR ".join(f"(a.chain = {i} AND {cut('a.fp', i + 1)} = {cut('b.fp', i + 1)})" for i in range(m))
    on = (
        "a.chain = b.chain AND a.part = b.part AND a.fp <> b.fp "
        f"AND bit_count({diff}) <= {max_bits} AND (NOT ({whole}) OR a.fp < b.fp) AND a.chain = ({first})"
    )
    return probe.alias("a").join(build.alias("b"), F.expr(on)).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, max_bits: int = 4) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs``.

    component_id is the smallest doc_id that links reach, the document's own
    included; a link is a difference of at most ``max_bits`` bits.
    """
    prints = written(fingerprints(docs, words_per_shingle), "fingerprints")
    kinds = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprint-classes")
    reached = connected_components(written(near_pairs(kinds.select("fp"), max_bits), "pairs"))
    named = kinds.join(reached.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = written(named, "classes")
    # tables on both sides of a join, so that Spark can split a hot component or fingerprint
    smallest = written(named.groupBy("component").agg(F.min("low").alias("component_id")), "components")
    classes = written(named.join(smallest, "component").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def _signed(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """doc_id, text_key, node (a hash of the set), fps (its fingerprints) of each row."""

    def make(texts: list) -> list[pa.Array]:
        sets = [shingle_set(t, words_per_shingle) for t in texts]
        nodes = [xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), SEED) for own in sets]
        return [pa.array(np.array(nodes, np.uint64).view(np.int64)), _lists([prints_of_set(own) for own in sets])]

    return _by_text(_keyed(docs), ["doc_id", "text_key"], make, "doc_id long, text_key long, node long, fps array<long>")


def _sets(rows: DataFrame, words_per_shingle: int) -> DataFrame:
    """node, own: the set as signed longs."""
    return _by_text(rows, ["node"], lambda texts: [_lists([shingle_set(t, words_per_shingle) for t in texts])], "node long, own array<long>")


def _similar(a: str, z: str, least: float) -> str:
    """The condition that two arrays, as sets, reach a Jaccard similarity; sets of very different sizes never do."""
    both = f"size(array_intersect({a}, {z}))"
    sizes = f"least(size({a}), size({z})) >= {least}D * greatest(size({a}), size({z}))"
    return f"CASE WHEN {sizes} THEN {both} >= {least}D * (size({a}) + size({z}) - {both}) ELSE false END"


def _buckets(kinds: DataFrame, max_bits: int) -> DataFrame:
    """key, node, pivot: the nodes that meet, and one of them for each."""
    near = written(near_pairs(kinds.select(F.col("fps")[0].alias("fp")).distinct(), max_bits), "pairs")
    equal = kinds.select("node", F.posexplode("fps").alias("k", "fp")).select("node", F.xxhash64("k", "fp").alias("key"))
    beside = near.select(F.xxhash64(F.lit(-1), "u", "v").alias("key"), F.explode(F.array("u", "v")).alias("fp"))
    beside = beside.join(kinds.select("node", F.col("fps")[0].alias("fp")), "fp").select("node", "key")
    met = equal.union(beside)
    pivot = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node")).alias("p"))
    pivot = written(pivot.where("n > 1").select("key", F.col("p.node").alias("pivot")), "pivots")
    return written(met.join(pivot, "key").select("key", "node", "pivot"), "buckets")


def similar_links(signed: DataFrame, docs: DataFrame, words_per_shingle: int, max_bits: int, least: float) -> DataFrame:
    """u, v: enough of the links between nodes that meet for their components."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    kinds = written(signed.groupBy("node").agg(first, F.first("fps").alias("fps")), "kinds")
    buckets = _buckets(kinds, max_bits)
    named = buckets.select("node").distinct().join(kinds.select("node", "first.*"), "node")
    id_or_0 = F.coalesce("doc_id", F.lit(0))
    text = _keyed(docs).withColumns({"doc__": id_or_0, "no_id": F.col("doc_id").isNull()}).drop("doc_id")
    rows = text.join(named.withColumn("doc__", id_or_0).drop("doc_id"), ["no_id", "doc__", "text_key"]).dropDuplicates(["node"])
    sets = written(_sets(rows, words_per_shingle), "sets")
    ordered = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    stars = buckets.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).select(*ordered).distinct()
    sides = [sets.select(F.col("node").alias(n), F.col("own").alias(s)) for n, s in (("u", "a"), ("v", "z"))]
    found = written(written(stars, "stars").join(sides[0], "u").join(sides[1], "v").where(_similar("a", "z", least)).select("u", "v"), "links")
    reached = connected_components(found)
    parts = buckets.select("key", "node").join(reached, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    apart = parts.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    parts = written(parts.join(apart, "key").join(sets, "node"), "parts")
    # counted inside the join, so that pairs which are no links are never rows
    near = f"a.key = b.key AND a.part < b.part AND {_similar('a.own', 'b.own', least)}"
    rest = parts.alias("a").join(parts.alias("b"), F.expr(near)).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    return found.union(written(rest.select(*ordered), "links"))


def one_of_each(docs: DataFrame, words_per_shingle: int = 5, max_bits: int = 4, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each component of similar texts: that of the smallest doc_id."""
    signed = written(_signed(docs, words_per_shingle), "signed")
    reached = connected_components(similar_links(signed, docs, words_per_shingle, max_bits, least))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    first = signed.groupBy("node").agg(F.min(own).alias("first")).join(reached, "node", "left")
    first = first.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("f"))
    same = {
        "no_id__": F.col("doc_id").isNull(),
        "doc__": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
        "text_key__": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))),
    }
    chosen = first.select(F.col("f.no_id").alias("no_id__"), F.coalesce("f.doc_id", F.lit(0)).alias("doc__"), F.col("f.text_key").alias("text_key__"))
    row = F.struct(*docs.columns)
    once = F.min_by(row, F.to_json(row)).alias("row__")
    return docs.withColumns(same).join(chosen, list(same), "left_semi").groupBy(*same).agg(once).select("row__.*")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, words_per_shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
