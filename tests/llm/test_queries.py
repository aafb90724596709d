"""The registered queries on small tables: against their SQL, against an independent reader, against the tokenizers library."""

import hashlib
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from quarry.llm import flac, licenses, linededup, packing, warc
from tests.llm.test_operators import LONG, ROWS, SCHEMA, TEXT

P = pytest.importorskip("public_tokenizers")
MORE = [
    (20, "Released under the MIT License, see the Apache  license and the GENERAL public license.\nmit license", "en", "src0", 1),
    (21, "mit-license apache/license (general public license) mit license", "en", None, 1),
    *((30 + i, f"own line {i}\n  Shared Line \nshared line\n\nend", "en", "src0", 1) for i in range(12)),
    (50, "shared line", "en", "src0", 1),
    (51, "\n\n", "en", "src0", 1),
]
#: One row for each doc_id, as the SQL takes it; repeated rows are in test_operators.py.
DOCUMENTS = list(dict.fromkeys(ROWS + MORE))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(DOCUMENTS, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    body = "<p>" + "x" * 200 + "</p>"
    pages = [(3, "u", body), (1, None, body), (2, "u", body), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (9, "u", "é" * 60), (10, "u", "é" * 60), (11, "u", "\x1f\u008b\x08" * 50)]
    pages += [(100 + i, "hot", "parked " * 40) for i in range(300)]  # most payloads are equal
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.mark.parametrize(
    ("query", "sql", "table"),
    [(licenses.op4_licenses, licenses.OP4_SQL, "documents"), (warc.op9_warc, warc.OP9_SQL, "pages"), (linededup.op10_linededup, linededup.OP10_SQL, "documents")],
)
def test_query_equals_sql(spark, folder, query, sql, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = query(spark, folder)
    names = sorted(found.columns)
    assert sorted(con.sql(sql).columns) == names
    rounded = lambda rows: Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert rounded(map(tuple, found.select(*names).collect())) == rounded(con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())


def test_op3_packing(spark, folder):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.op3_packing(spark, folder).collect()
    want = Counter()
    for doc_id, text, *_ in DOCUMENTS:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 2048):
            part = np.array(ids[at : at + 2048], "<u4").tobytes()
            want[(doc_id, at, len(part) // 4, zlib.crc32(part), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


# --- a plain reader of FLAC, bit by bit


class Bits:
    def __init__(self, data, at):
        self.data, self.at = data, 8 * at

    def get(self, n):
        value = 0
        for _ in range(n):
            value = value << 1 | self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return value

    def signed(self, n):
        value = self.get(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def zeros(self):
        n = 0
        while not self.get(1):
            n += 1
        return n


def remainder_of(data, width, poly):
    r = 0
    for byte in data:
        r ^= byte << (width - 8)
        for _ in range(8):
            r = (r << 1 ^ poly) if r >> (width - 1) else r << 1
            r &= (1 << width) - 1
    return r


def residuals(b, size, order):
    wide = 4 + b.get(2)
    parts = b.get(4)
    out = []
    for i in range(1 << parts):
        n = (size >> parts) - (order if i == 0 else 0)
        k = b.get(wide)
        if k == (1 << wide) - 1:
            raw = b.get(5)
            out += [b.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                v = b.zeros() << k | b.get(k)
                out.append(v >> 1 if v & 1 == 0 else -(v >> 1) - 1)
    return out


def subframe(b, size, wide):
    assert b.get(1) == 0
    kind = b.get(6)
    assert b.get(1) == 0  # no wasted bits
    if kind == 0:
        return [b.signed(wide)] * size
    if kind == 1:
        return [b.signed(wide) for _ in range(size)]
    if kind < 32:
        order, shift = kind - 8, 0
        out = [b.signed(wide) for _ in range(order)]
        coefficients = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
    else:
        order = kind - 31
        out = [b.signed(wide) for _ in range(order)]
        precision = b.get(4) + 1
        shift = b.signed(5)
        coefficients = [b.signed(precision) for _ in range(order)]
    for r in residuals(b, size, order):
        out.append(r + (sum(c * out[-1 - i] for i, c in enumerate(coefficients)) >> shift))
    return out


def plain_flac(stream):
    """The samples as bytes; everything that the format lets a reader check is checked."""
    assert stream[:4] == b"fLaC"
    at, last, points = 4, False, []
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4])
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18])
            channels, wide, total, md5 = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            points = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, size, 18)]
        at += 4 + size
    begin, samples, starts = at, [], {}
    assert channels == 1 and wide == 8
    while at < len(stream):
        starts[len(samples)] = at - begin
        b = Bits(stream, at)
        assert b.get(14) == 0x3FFE and b.get(2) == 0
        size_code, rate_code, channel, depth, spare = b.get(4), b.get(4), b.get(4), b.get(3), b.get(1)
        assert channel == 0 and depth in (0, 1) and spare == 0
        lead = b.get(8)
        more = 0
        while lead >> (7 - more) & 1:
            more += 1
        number = lead & (0x7F >> more)
        for _ in range(max(0, more - 1)):
            number = number << 6 | b.get(8) & 63
        size = {1: 192, 6: None, 7: None}.get(size_code, 576 << size_code - 2 if size_code < 6 else 256 << size_code - 8)
        size = size or b.get(8 if size_code == 6 else 16) + 1
        b.get({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
        assert number == len(starts) - 1
        assert remainder_of(stream[at : b.at >> 3], 8, 0x07) == b.get(8)
        samples += subframe(b, size, wide)
        end = b.at + 7 >> 3
        assert remainder_of(stream[at:end], 16, 0x8005) == int.from_bytes(stream[end : end + 2])
        at = end + 2
    assert len(samples) == total
    assert hashlib.md5(bytes(s & 255 for s in samples)).digest() == md5
    for sample, offset, _ in points:
        assert sample == (1 << 64) - 1 or starts[sample] == offset
    return bytes(s + 128 for s in samples)


def payload_of(text):
    data = (text or "").encode()
    return data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))


def test_streams_by_a_plain_reader():
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, 576, dtype=np.uint8).tobytes()
    made = [payload_of(None), payload_of(TEXT), payload_of("日本語 äöü " * 40), noise, bytes(range(192)) * 6]
    assert [plain_flac(s) for s in flac.encode_streams(made)] == made


def test_op6_flac(spark, folder):
    short = [r for r in DOCUMENTS if r[1] != LONG]
    streams = {(r.doc_id, r.n_bytes): bytes(r.media) for r in flac.encode(spark.createDataFrame(short, SCHEMA)).collect()}
    got = [r for r in flac.op6_flac(spark, folder).collect() if r.doc_id != 7]
    want = Counter()
    for doc_id, text, *_ in short:
        payload = payload_of(text)
        n = len((text or "").encode())
        media = streams[doc_id, n]
        assert plain_flac(media) == payload
        want[(doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got) == want
    by_payload = {}
    for r in got:
        assert by_payload.setdefault(r.payload_sha256, r.feature) == r.feature
