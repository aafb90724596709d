"""WARC archives: a transactional writer and a splittable reader.

Writer: every record is a gzip member of its own. Spark's text writer stores
the members, so any Hadoop store works and a lost or repeated task leaves
nothing behind: a member goes out without its last byte, a zero, which the
writer's line separator supplies. (A gzip member ends with its length, whose top
byte is zero below 16 MB; longer ones get an empty member appended.)

Reader: tasks take byte ranges, look for the gzip magic, and validate each
candidate by decoding it: a WARC header must open it, the header's content
length must fit, and gzip's checksum must hold. A record belongs to the range
in which its member starts, and a task reads beyond its range to finish it.

Cases: a null html is an empty payload; repeated rows of one page_id are each
a record, none a revisit of the other; a null page_id is stored as ``null`` and
neither revisits nor is revisited; an empty table gives an archive without
records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import forget_on_exit, new_path, written

MAGIC = b"\x1f\x8b\x08"
URN = "urn:page:"
#: Bytes read at a time, and the longest header that a candidate may have.
CHUNK, HEADER = 1 << 20, 1 << 16
#: Range tasks at most; further ranges share tasks.
MOST_TASKS = 20_000


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member, or two, that end with a zero byte."""

    def packed(x: bytes) -> bytes:
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        return z.compress(x) + z.flush()

    member = packed(data)
    return member if member.endswith(b"\0") else member + packed(b"")


def record(kind: str, page: str, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: str | None = None) -> bytes:
    """A WARC 1.1 record. A revisit names the response and has no payload."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{page}>", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_bytes}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


@F.pandas_udf(T.BinaryType())
def _responses(page: pd.Series, url: pd.Series, html: pd.Series, digest: pd.Series) -> pd.Series:
    bodies = [(h or "").encode() for h in html]
    return pd.Series([gzip_member(record("response", p, u, b, d, len(b))) for p, u, b, d in zip(page, url, bodies, digest, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def _revisits(page: pd.Series, url: pd.Series, digest: pd.Series, n_bytes: pd.Series, to: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else gzip_member(record("revisit", p, u, b"", d, int(n), t)) for p, u, d, n, t in zip(page, url, digest, n_bytes, to, strict=True)], dtype=object)


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 100) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) under ``path``.

    Of equal payloads of at least ``min_revisit_bytes`` bytes the smallest
    page_id is the response; the others revisit it. Bodies are compressed
    before they move, and digests that occur once take no part in the lookup.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumns(
        {"digest": F.sha2(F.col("html").cast("binary"), 256), "n_bytes": F.octet_length("html").cast("long")}
    )
    shared = (
        keyed.where((F.col("n_bytes") >= min_revisit_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    # a table, so that both sides of the join are plain shuffles and Spark can split a hot digest
    shared = written(shared, "digests")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    packed = keyed.withColumn("page", page).withColumn("member", _responses("page", "url", "html", "digest")).drop("html")
    to = F.when(F.col("page_id") > F.col("first"), F.col("first").cast("string"))
    decided = packed.join(shared, "digest", "left").withColumn("to", to)
    member = F.coalesce(_revisits("page", "url", "digest", "n_bytes", "to"), F.col("member"))
    (
        decided.select(member.alias("m"))
        .select(F.expr("CAST(substring(m, 1, octet_length(m) - 1) AS STRING)").alias("value"))
        .write.option("lineSep", "\0")
        .text(path)
    )


def _local(path: str) -> str:
    return re.sub("^file:/+", "file:///", path)


class _Window:
    """Bytes of one file from a moving offset, read in chunks."""

    def __init__(self, path: str):
        system, inner = pa.fs.FileSystem.from_uri(_local(path))
        self.file = system.open_input_file(inner)
        self.size = self.file.size()
        self.at, self.data = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from offset at."""
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.data = self.file.read_at(max(0, min(max(n, CHUNK), self.size - at)), at)
            self.at = at
        return self.data[at - self.at : at - self.at + n]

    def find(self, at: int, end: int) -> int:
        """The first offset from at on, before end, where the magic stands; else -1."""
        while at < end:
            piece = self.get(at, min(CHUNK, end - at + len(MAGIC) - 1))
            found = piece.find(MAGIC)
            if 0 <= found < end - at:
                return at + found
            if len(piece) < len(MAGIC):
                return -1
            at += len(piece) - len(MAGIC) + 1
        return -1


def _headers(block: bytes) -> dict[str, str] | None:
    first, *rest = block.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", first):
        return None
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in rest)}


def decode_member(window: _Window, start: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end offset of the record whose member starts at ``start``; None if none does."""
    z, at, parts, size = zlib.decompressobj(31), start, [], 0
    try:
        while not z.eof:
            piece = window.get(at, 1 << 16)
            if not piece:
                return None
            parts.append(z.decompress(piece))
            size += len(parts[-1])
            at += len(piece)
            if len(parts) > 1 and size < HEADER:
                parts = [b"".join(parts)]
            if not b"WARC/1."[:size].startswith(parts[0][:7]) and not parts[0].startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    data = b"".join(parts)
    head, mark, block = data.partition(b"\r\n\r\n")
    headers = _headers(head) if mark else None
    if headers is None or not headers.get("content-length", "").isdigit() or len(block) < (n := int(headers["content-length"])):
        return None
    return headers, block[:n], at - len(z.unused_data)


def records_in_range(path: str, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, member length, headers and block of each record that starts in [start, end)."""
    window = _Window(path)
    at = window.find(start, end)
    while at >= 0:
        got = decode_member(window, at)
        if got:
            headers, block, stop = got
            yield at, stop - at, headers, block
            at = window.find(stop, end)
        else:
            at = window.find(at + 1, end)


def read_archives(spark: SparkSession, path: str, range_bytes: int = 8 << 20, with_block: bool = True) -> DataFrame:
    """One row per record: file, offset, length, warc_type, record_id, refers_to, target_uri,
    payload_digest, payload_length (as the headers say), block, block_sha256, block_bytes.

    ``with_block=False`` leaves block null: digest and size are still those of the bytes read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", F.explode(F.expr(f"sequence(0L, length - 1, {range_bytes}L)")).alias("start"))
    schema = "file string, offset long, length long, warc_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_length long, block binary, block_sha256 string, block_bytes long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, start in zip(b["path"], b["start"], strict=True):
                rows, held = [], 0
                for at, n, h, block in records_in_range(where, start, start + range_bytes):
                    length = h.get("x-payload-length", "")
                    rows.append((where, at, n, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), int(length) if length.isdigit() else len(block), block if with_block else None, hashlib.sha256(block).hexdigest(), len(block)))
                    held += len(block) if with_block else 0
                    if len(rows) >= 2000 or held > 16 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = [x.split()[0] for x in schema.split(", ")]
    n = ranges.count()
    return ranges.repartition(max(1, min(n, MOST_TASKS))).mapInPandas(run, schema)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    forget_on_exit(spark, path)
    found = read_archives(spark, path, with_block=False)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<{URN}(-?[0-9]+)>$', 1) AS BIGINT)")
    own = F.col("warc_type") == "response"
    return found.select(
        page("record_id").alias("page_id"),
        F.when(own, F.col("block_bytes")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(own, F.col("block_sha256")).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
