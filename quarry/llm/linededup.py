"""Line deduplication that returns keep bitmaps.

A line's key is the line without leading and trailing ASCII white space, A-Z
lower-cased. Its 128-bit hash is range-partitioned together with the document,
so the rows of one (key, document) stay together while a key of very many
documents spreads over as many partitions as its rows need. Each partition is
sorted by hash, document and position and read as a stream: a run of equal
hashes is one key, its first row the first occurrence. A key can reach over
partition borders only as a partition's first or last run, so those two counts
per partition are all that the driver gathers before the pass that decides.

Only positions of dropped lines travel on; each document gets a bitmap (bit i:
keep line i, least significant bit first), compressed with zlib.

Cases: a null or empty text has one empty line, which is kept; a document is a
doc_id (null is one id): rows that share it count once per key and each gets
the bitmap of its own text; an empty table gives an empty result; other columns
stay as they are, and those named like an added column are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import shared_dir, trim, written

#: Rows that a Python batch gathers before it goes on.
ROWS = 50_000
SORTED = ["h1", "h2", "no_id", "doc", "text_key", "pos"]
SCHEMA = "h1 long, h2 long, no_id boolean, doc long, text_key long, pos int"


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line, in order."""
    return [line.strip().lower() for line in text.split(b"\n")]


def hashed_lines(docs: DataFrame, min_key_chars: int) -> DataFrame:
    """A row for each line whose key has at least ``min_key_chars`` code points."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, counts, places, n = [], [], [], 0

            def out(upto: int, first: int) -> pa.RecordBatch:
                which = np.repeat(np.arange(first, upto), counts)
                pair = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                cols = [pa.array(pair[:, 0]), pa.array(pair[:, 1]), *(b.column(c).take(pa.array(which)) for c in ("no_id", "doc", "text_key")), pa.array(places, pa.int32())]  # noqa: B023
                return pa.RecordBatch.from_arrays(cols, SORTED)

            first = 0
            for i, text in enumerate(x.as_py() for x in b.column("text")):
                had = len(places)
                for pos, key in enumerate(line_keys(text.encode())):
                    if key and (min_key_chars <= 1 or len(key.decode()) >= min_key_chars):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        places.append(pos)
                counts.append(len(places) - had)
                if len(places) >= ROWS:
                    yield out(i + 1, first)
                    hashes, counts, places, first = [], [], [], i + 1
            if places:
                yield out(b.num_rows, first)
            trim()

    return docs.select("no_id", "doc", "text_key", "text").mapInArrow(rows, SCHEMA)


def _runs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Where a new hash starts, and where a new (hash, document) starts, in a sorted batch."""
    h1, h2, doc, no_id = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc", "no_id"))
    fresh = np.ones(b.num_rows, bool)
    fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    fresh_doc = fresh.copy()
    fresh_doc[1:] |= (doc[1:] != doc[:-1]) | (no_id[1:] != no_id[:-1])
    return fresh, fresh_doc


def _border_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """This partition's first and last hash, and in how many of its documents each is."""
    pid = TaskContext.get().partitionId()
    runs: list[list] = []  # [hash, documents, last document]: the first run and the one being read
    for b in batches:
        if not b.num_rows:
            continue
        fresh, fresh_doc = _runs(b)
        starts = np.flatnonzero(fresh)
        docs = np.add.reduceat(fresh_doc.astype(np.int64), starts)
        ends = np.append(starts[1:], b.num_rows) - 1
        for at in {0, len(starts) - 1} if len(starts) > 1 else {0}:
            row = {c: b.column(c)[int(starts[at])].as_py() for c in ("h1", "h2", "no_id", "doc")}
            key, head = (row["h1"], row["h2"]), (row["no_id"], row["doc"])
            tail = tuple(b.column(c)[int(ends[at])].as_py() for c in ("no_id", "doc"))
            if runs and runs[-1][0] == key:
                runs[-1][1] += int(docs[at]) - (runs[-1][2] == head)
                runs[-1][2] = tail
            else:
                runs = [*runs[:1], [key, int(docs[at]), tail]]
    if runs:
        yield pd.DataFrame([(pid, *r[0], r[1]) for r in runs], columns=["pid", "h1", "h2", "n"])


def _dropped(batches, totals: dict, firsts: dict, min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """The rows of keys in at least ``min_docs`` documents, as the stream decides them.

    Only the rows of a run that is still below ``min_docs`` wait for more.
    """
    pid = TaskContext.get().partitionId()
    waiting, decided = None, None
    for b in batches:
        if waiting is not None:
            b = pa.Table.from_batches([waiting, b]).combine_chunks().to_batches()[0]
            waiting = None
        if not b.num_rows:
            continue
        fresh, fresh_doc = _runs(b)
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, b.num_rows))
        docs = np.add.reduceat(fresh_doc.astype(np.int64), starts)
        first, last = ((b.column("h1")[int(i)].as_py(), b.column("h2")[int(i)].as_py()) for i in (starts[0], starts[-1]))
        drop = docs >= min_docs
        going_on = decided == first  # the run began in an earlier batch and was decided there
        drop[0] |= going_on
        for at, key in ((0, first), (len(starts) - 1, last)):
            if key in totals:
                drop[at] = totals[key] >= min_docs
        gone = np.repeat(drop, sizes)
        if keep_first:
            keep = starts[1:] if going_on or firsts.get(first, pid) != pid else starts
            gone[keep] = False
        decided = last if drop[-1] else None
        if not drop[-1] and last not in totals:
            waiting = b.slice(int(starts[-1]))
        if gone.any():
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("no_id", "doc", "text_key", "pos")], ["no_id", "doc", "text_key", "pos"]).filter(pa.array(gone))


def dropped_lines(docs: DataFrame, min_docs: int, min_key_chars: int, keep_first: bool) -> DataFrame:
    """(no_id, doc, text_key, pos) of each line that goes."""
    shared_dir(docs.sparkSession)
    lines = written(hashed_lines(docs, min_key_chars), "lines")
    ranged = lines.repartitionByRange("h1", "h2", "no_id", "doc").sortWithinPartitions(*SORTED).checkpoint()
    found = ranged.mapInArrow(lambda it: (pa.RecordBatch.from_pandas(x, preserve_index=False) for x in _border_runs(it)), "pid long, h1 long, h2 long, n long").collect()
    totals: dict = {}
    firsts: dict = {}
    for r in found:
        key = (r.h1, r.h2)
        totals[key] = totals.get(key, 0) + r.n
        firsts[key] = min(firsts.get(key, r.pid), r.pid)
    return ranged.mapInArrow(lambda it: _dropped(it, totals, firsts, min_docs, keep_first), "no_id boolean, doc long, text_key long, pos int")


def to_bitmap(n_lines: int, dropped: list[int]) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def from_bitmap(keep: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[:n_lines].astype(bool)


def kept_text(text: str, keep: bytes) -> str:
    """The lines that the bitmap keeps, joined."""
    lines = text.split("\n")
    return "\n".join(line for line, stays in zip(lines, from_bitmap(keep, len(lines)), strict=True) if stays)


@F.pandas_udf(T.BinaryType())
def _bitmaps(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    return pd.Series([to_bitmap(n, [] if d is None else d) for n, d in zip(n_lines, dropped, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else kept_text(t, k) for t, k in zip(text, keep, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _kept_sha256(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else hashlib.sha256(kept_text(t, k).encode()).hexdigest() for t, k in zip(text, keep, strict=True)], dtype=object)


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_key_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` with n_lines, n_dropped (longs) and keep, the compressed bitmap.

    Keys of at least ``min_key_chars`` code points that ``min_docs`` or more
    documents hold lose their lines: all of them, or with ``keep_first`` all but
    the first by document and position.
    """
    own = docs.drop("n_lines", "n_dropped", "keep")
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = {"__no_id": F.col("doc_id").isNull(), "__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__text_key": F.xxhash64(body)}
    rows = own.select(*(c.alias(n.strip("_")) for n, c in key.items()), body.alias("text"))
    gone = dropped_lines(rows, min_docs, min_key_chars, keep_first)
    places = gone.groupBy(*(F.col(n.strip("_")).alias(n) for n in key)).agg(F.array_sort(F.collect_set("pos")).alias("__gone"))
    n_lines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    return (
        own.withColumns(key)
        .join(places, list(key), "left")
        .withColumns({"n_lines": n_lines.cast("long"), "n_dropped": F.greatest(F.coalesce(F.size("__gone"), F.lit(0)), F.lit(0)).cast("long")})
        .withColumn("keep", _bitmaps("n_lines", "__gone"))
        .select(*own.columns, "n_lines", "n_dropped", "keep")
    )


def without_dropped_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the dropped lines gone from text; untouched texts, and all other columns, stay as they are."""
    aside = {c: f"own__{c}" for c in docs.columns if c in ("n_lines", "n_dropped", "keep")}
    marked = line_bitmaps(docs.withColumnsRenamed(aside), **how)
    some = F.col("n_dropped") > 0
    text = F.when(some, _kept(F.when(some, F.col("text")), F.col("keep"))).otherwise(F.col("text"))
    return marked.withColumn("text", text).select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def op10_linededup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = line_bitmaps(docs, min_docs=10, min_key_chars=1)
    some = F.col("n_dropped") > 0
    untouched = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    sha = F.when(some, _kept_sha256(F.when(some, F.col("text")), F.col("keep"))).otherwise(untouched)
    return marked.select("doc_id", "n_lines", "n_dropped", sha.alias("kept_sha256"))


OP10_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY k.doc_id
"""
