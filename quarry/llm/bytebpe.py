"""Byte-level BPE encoding and decoding from a file of ranks.

A text is split by the tokenizer's pattern into words; words of all texts are
encoded once. Encoding is a fold of Spark higher-order functions over a word's
bytes: the state holds where the current pieces begin and the rank of each
neighbouring pair, a step merges the lowest-ranked pair, and ranks come from a
literal map (an array of small maps, indexed by hash, since a lookup in a map is
a scan). Ids are ranks; ``decode`` looks up each id's bytes in a literal array and
concatenates them, also in Spark.

Getting the ids back to the texts needs little traffic. A task numbers the
distinct words of a block of texts and turns each text into numbers. Blocks send
their words, packed by hash bucket, to where equal words of all blocks meet and
are encoded; each block gets the ids of its own words back, packed, and meets
its numbered texts again. Words and numbers are made in two passes over the
input, which must give the same rows both times, as a table does. Blocks are bounded
in words and pieces, and so is what a task holds of a bucket, as buckets grow in
number with the shuffle partitions.

Bytes travel through SQL strings as the characters of the same numbers (Latin-1).
Words of more than LONGEST bytes, for which a fold over arrays would take time
with the square of their size, are merged with a heap instead, to the same ids.

Cases: a null text is empty and has no ids; repeated rows and null ids stay; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import trim

LONGEST = 64
#: Small maps that the rank map is dealt into; a power of two.
MAPS = 1 << 16
#: Bytes of text of a block; words of a row that Spark encodes at a time; pieces of text whose ids are unpacked at a time; words hashed in step.
BLOCK_BYTES, ROW_WORDS, ROW_PIECES, STEP_WORDS = 12 << 20, 20_000, 300_000, 5_000


@lru_cache(4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Expressions:
    """Column expressions over Latin-1 strings for one vocabulary.

    The literals are bound to a lambda variable once, outside the words' loop, so
    that a plan holds one copy of them.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def encoded(self, words: Column) -> Column:
        """The ids of each word of an array; null for a null word."""
        maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
        for token, rank in self.ranks.items():
            word = token.decode("latin-1")
            maps[xxhash.xxh64_intdigest(word.encode(), 42) % MAPS][word] = rank
        # constant folding turns this into a literal
        literal = F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>")
        return _let(literal, lambda m: F.transform(words, lambda w: F.when(w.isNotNull(), _encode(w, m))))

    def decoded(self, ids: Column) -> Column:
        """The bytes of ids, concatenated."""
        pieces: list[str | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            pieces[rank] = token.decode("latin-1")
        literal = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")
        return _let(literal, lambda m: F.encode(F.array_join(F.transform(ids, lambda i: F.get(m, i)), ""), "ISO-8859-1"))


def _encode(word: Column, maps: Column) -> Column:
    """The ids of a word of at least one byte."""

    def rank(token: Column) -> Column:
        slot = F.xxhash64(token).bitwiseAND(F.lit(MAPS - 1)).cast("int")
        return F.try_element_at(F.get(maps, slot), token)

    def step(state: Column, _: Column) -> Column:
        begin, ranks = state.begin, state.rank

        def token(first: Column, last: Column) -> Column:
            return F.substring(word, F.get(begin, first), F.get(begin, last) - F.get(begin, first))

        def merged(p: Column) -> Column:  # p counts from 1
            fresh = F.transform(ranks, lambda r, i: F.when(i == p - 2, rank(token(p - 2, p + 1))).when(i == p, rank(token(p - 1, p + 2))).otherwise(r))
            return F.struct(F.filter(begin, lambda _, i: i != p).alias("begin"), F.filter(fresh, lambda _, i: i != p - 1).alias("rank"))

        return _let(F.array_position(ranks, F.array_min(ranks)).cast("int"), lambda p: F.when(p > 0, merged(p)).otherwise(state))

    pairs = F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: rank(F.substring(word, i, F.lit(2))))
    start = F.struct(F.sequence(F.lit(1), F.length(word) + 1).alias("begin"), pairs.alias("rank"))
    ids = F.aggregate(
        F.sequence(F.lit(2), F.length(word)),
        start,
        step,
        lambda s: F.transform(F.sequence(F.lit(0), F.size(s.begin) - 2), lambda i: rank(F.substring(word, F.get(s.begin, i), F.get(s.begin, i + 1) - F.get(s.begin, i)))),
    )
    return _let(rank(word), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(ids))


def merge_with_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word; time grows with size times its logarithm."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[i : after[j]])) is not None:
            heapq.heappush(heap, (r, i, after[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or after[j] != end:
            continue  # one of the two pieces has changed since
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


#: White space that Unicode knows beside ASCII's.
_SPACE = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def pieces_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """How many pieces each text has, the distinct pieces, and the number of each text's pieces in turn.

    A space that follows a non-space begins a new match of the pattern (words take at
    most one space before them), so cutting there changes nothing. Texts with a space
    after white space are left whole.
    """
    whole = pc.match_substring_regex(texts, _SPACE + " ")
    split = pc.split_pattern(texts, " ")
    split = pc.if_else(whole, pc.split_pattern(texts, "\0never\0"), split) if pc.any(whole).as_py() else split
    count = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(split).dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64) * 2 + 1
    number[np.cumsum(count) - count] -= 1  # even: without a space before it, as a text's first piece
    there = np.zeros(2 * len(coded.dictionary), bool)
    there[number] = True
    distinct, number = np.flatnonzero(there), (np.cumsum(there) - 1)[number]
    bare = coded.dictionary.take(pa.array(distinct >> 1))
    lead = pa.array(np.array(["", " "], object)[distinct & 1], pa.string())
    return count, pc.binary_join_element_wise(lead, bare, ""), number


#: A pattern that begins so takes a piece of letters only, with or without a space before them, as one word.
_LETTERS_FIRST = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+|"
#: Such a piece, of letters that every version of Unicode has: ASCII, Latin-1 and Latin Extended-A.
_LETTERS_ONLY = r"\A ?[A-Za-zÀ-ÖØ-öø-ſ]+\z"


def words_of(pieces: pa.Array, pattern: str, words_in: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Another order of the pieces (each one's place in it), and in that order how many words each has, and the words."""
    plain = np.zeros(len(pieces), bool)
    if pattern.startswith(_LETTERS_FIRST):
        plain = pc.match_substring_regex(pieces, _LETTERS_ONLY).to_numpy(zero_copy_only=False)
    place = np.where(plain, np.cumsum(plain), plain.sum() + np.cumsum(~plain)) - 1
    made = [words_in(p) for p in pieces.filter(pa.array(~plain)).to_pylist()]
    sizes = np.concatenate([np.ones(plain.sum(), np.int64), np.fromiter(map(len, made), np.int64, len(made))])
    return place, sizes, pa.concat_arrays([pieces.filter(pa.array(plain)), pa.array([w for m in made for w in m], pa.string())])


def buckets_of(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each word (binary), by a hash of its bytes alone; short words in step."""
    short = pc.binary_length(words).to_numpy(zero_copy_only=False) <= LONGEST
    out = np.zeros(len(words), np.int64)
    out[~short] = [zlib.crc32(w) % buckets for w in words.filter(pa.array(~short)).to_pylist()]
    power = np.cumprod(np.full(LONGEST, 0x9E3779B97F4A7C15, np.uint64))
    which = np.flatnonzero(short)
    for first in range(0, len(which), STEP_WORDS):
        now = which[first : first + STEP_WORDS]
        part = words.take(pa.array(now))
        ends = np.frombuffer(part.buffers()[1], "<i4", len(part) + 1, part.offset * 4).astype(np.int64)
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
        ends -= ends[0]
        at = np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))
        total = np.append(np.uint64(0), np.cumsum((data + np.uint64(1)) * power[at]))
        mixed = total[ends[1:]] - total[ends[:-1]]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[now] = (mixed >> np.uint64(32)) % np.uint64(buckets)
    return out


def pack_words(numbers: np.ndarray, words: pa.Array) -> bytes:
    """Numbers and words (binary) in one compressed value."""
    words = pa.concat_arrays([words])  # offsets from 0
    offsets = np.frombuffer(words.buffers()[1], "<i4", len(words) + 1, words.offset * 4)
    data = words.buffers()[2]
    body = data[int(offsets[0]) : int(offsets[-1])] if data is not None else b""
    return zstandard.compress(struct.pack("<I", len(words)) + numbers.astype("<u4").tobytes() + (offsets - offsets[0]).tobytes() + bytes(body), 1)


def unpack_words(data: bytes) -> tuple[np.ndarray, pa.Array]:
    raw = zstandard.decompress(data)
    n = struct.unpack_from("<I", raw)[0]
    numbers = np.frombuffer(raw, "<u4", n, 4).astype(np.int64)
    buffer = pa.py_buffer(raw)
    at = 4 + 4 * n
    return numbers, pa.Array.from_buffers(pa.binary(), n, [None, buffer.slice(at, 4 * n + 4), buffer.slice(at + 4 * n + 4)])


def pack_ids(numbers: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    return zstandard.compress(np.array([len(numbers)], "<u4").tobytes() + b"".join(np.asarray(x).astype("<u4").tobytes() for x in (numbers, counts, ids)), 1)


def unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), "<u4").astype(np.int64)
    n = int(raw[0])
    return raw[1 : n + 1], raw[n + 1 : 2 * n + 1], raw[2 * n + 1 :]


def gathered(counts: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and concatenated values of the chosen lists."""
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, pa.int32()))
    took = lists.take(pa.array(which))
    return counts[which], took.flatten().to_numpy()


def squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed byte by byte."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def loosened(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


SCHEMA = "block string, bucket int, doc_ids array<long>, sizes binary, data binary"


def _rows(block: list[str], data: list[bytes], bucket: np.ndarray | None = None, doc_ids: list | None = None, sizes: list | None = None) -> pa.RecordBatch:
    n = len(data)
    columns = [pa.array(block, pa.string()), pa.nulls(n, pa.int32()) if bucket is None else pa.array(bucket, pa.int32()), pa.array(doc_ids or [None] * n, pa.list_(pa.int64())), pa.array(sizes or [None] * n, pa.binary()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "bucket", "doc_ids", "sizes", "data"])


def _blocks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about BLOCK_BYTES of text."""
    size = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False))
    first = 0
    while first < b.num_rows:
        before = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, before + BLOCK_BYTES, side="right")))
        yield b.slice(first, last - first)
        first = last


def _numbered(docs: DataFrame, pattern: str, buckets: int, texts: bool) -> DataFrame:
    """For each block of texts either the texts as numbers of distinct words, or the words by bucket.

    The two are made by one pass each, for half the traffic of a table of both. A
    block's name has a digest of its texts, so blocks that a repeated pass made of
    other rows would not be taken for the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_in = regex.compile(pattern).findall
        pid, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in _blocks(batch):
                text = pa.concat_arrays([b.column("text")])
                block, done = f"{pid}-{done}-{xxhash.xxh3_64_hexdigest(text.buffers()[2] or b'')}", done + 1
                count, pieces, number = pieces_of(text)
                place, sizes, words = words_of(pieces, pattern, words_in)
                number = place[number]
                coded = words.cast(pa.binary()).dictionary_encode()
                del pieces, place, words
                if texts:
                    part = coded.indices.to_numpy().astype(np.int64)
                    each, numbers = gathered(sizes, part, number)
                    ends = np.append(0, np.cumsum(each))[np.append(0, np.cumsum(count))]
                    yield _rows([block], [squeezed(numbers)], None, [b.column("doc_id").to_pylist()], [np.diff(ends).astype("<u8").tobytes()])
                else:
                    words = coded.dictionary
                    bucket = buckets_of(words, buckets)
                    order = np.argsort(bucket, kind="stable")
                    groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
                    if groups:
                        yield _rows([block] * len(groups), [pack_words(g, words.take(pa.array(g))) for g in groups], np.array([bucket[g[0]] for g in groups]))
                del coded, number
                trim()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, SCHEMA)


def _encoded_words(packed: DataFrame, path: str) -> DataFrame:
    """For each block and bucket a row with the ids of the block's words."""
    said = Expressions(ranks_of(path))

    def meet(table: pa.Table) -> pa.Table:
        """Rows of distinct words, with where they occur: a block, a word of the block, a word of the row."""
        names, found, where, numbers = table.column("block").to_pylist(), [], [], []
        for block, data in enumerate(table.column("data").to_pylist()):
            own, words = unpack_words(data)
            found.append(words)
            numbers.append(own)
            where.append(np.full(len(own), block))
        coded = pa.concat_arrays(found).dictionary_encode()
        at, where, numbers = coded.indices.to_numpy().astype(np.int64), np.concatenate(where), np.concatenate(numbers)
        order = np.argsort(at, kind="stable")
        at, where, numbers = at[order], where[order], numbers[order]
        kept, rows = coded.dictionary.to_pylist(), []
        for first in range(0, len(kept), ROW_WORDS):
            part = kept[first : first + ROW_WORDS]
            lo, hi = np.searchsorted(at, [first, first + len(part)])
            places = np.stack([where[lo:hi], numbers[lo:hi], at[lo:hi] - first], 1).astype("<u4")
            long = {i: merge_with_heap(w, ranks_of(path)) for i, w in enumerate(part) if len(w) > LONGEST}
            rows.append(([None if i in long else w.decode("latin-1") for i, w in enumerate(part)], [long.get(i) for i in range(len(part))] if long else None, names, places.tobytes()))
        types = [pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()), pa.binary()]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["words", "long", "blocks", "places"])

    met = packed.groupBy("bucket").applyInArrow(meet, "words array<string>, long array<array<int>>, blocks array<string>, places binary")
    ids = said.encoded(F.col("words"))

    def give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (names, places) in enumerate(zip(b.column("blocks").to_pylist(), b.column("places").to_pylist(), strict=True)):
                found, long = b.column("ids").slice(i, 1).flatten(), b.column("long").slice(i, 1).flatten()
                if len(long):
                    found = pa.array([x if x is not None else y for x, y in zip(found.to_pylist(), long.to_pylist(), strict=True)], pa.list_(pa.int32()))
                counts, values = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64), found.flatten().to_numpy(zero_copy_only=False)
                place = np.frombuffer(places, "<u4").reshape(-1, 3)
                place = place[np.argsort(place[:, 0], kind="stable")]
                parts = np.split(place, np.flatnonzero(np.diff(place[:, 0])) + 1)
                del found, long
                yield _rows([names[p[0, 0]] for p in parts], [pack_ids(p[:, 1], *gathered(counts, values, p[:, 2].astype(np.int64))) for p in parts])

    return met.select("blocks", "places", "long", ids.alias("ids")).mapInArrow(give_back, SCHEMA)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 (of the decimal ids joined by commas) for each row of ``docs`` (doc_id, text)."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * partitions
    texts = _numbered(docs, pattern, buckets, True)
    answers = _encoded_words(_numbered(docs, pattern, buckets, False).select("block", "bucket", "data"), path)
    schema = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string"

    def finish(table: pa.Table) -> pa.Table:
        data, sizes = table.column("data"), table.column("sizes")
        own = [i for i in range(table.num_rows) if sizes[i].is_valid]
        if len(own) != 1:
            raise ValueError("a block's texts and words come from different rows: the input changes between passes; write it as a table first")
        size = np.frombuffer(sizes[own[0]].as_py(), "<u8").astype(np.int64)
        numbers = loosened(data[own[0]].as_py())
        answers = [unpack_ids(data[i].as_py()) for i in range(table.num_rows) if i != own[0]]
        nothing = np.zeros(0, np.int64)
        order = np.argsort(np.concatenate([a[0] for a in answers])) if answers else nothing
        counts, values = gathered(*(np.concatenate([a[k] for a in answers]) for k in (1, 2)), order) if answers else (nothing, nothing)
        del answers
        if len(numbers) and numbers.max() >= len(counts):
            raise ValueError("a block's words are missing: the input changes between passes; write it as a table first")
        decimal = _spelled(path)
        stops = np.append(0, np.cumsum(size))
        found: list[np.ndarray] = []
        digests: list[str] = []
        ends = [np.zeros(1, np.int64)]
        first = 0
        while first < len(size):
            last = max(first + 1, int(np.searchsorted(stops, stops[first] + ROW_PIECES, side="right")) - 1)
            own_counts, ids = gathered(counts, values, numbers[stops[first] : stops[last]])
            stop = np.append(0, np.cumsum(own_counts))[stops[first : last + 1] - stops[first]]
            digests += [hashlib.sha256(spelled[:-1]).hexdigest() for spelled in _joined(decimal, ids, stop)]
            found.append(ids.astype(np.int32))
            ends.append(ends[-1][-1] + stop[1:])
            first = last
        trim()
        stop = np.concatenate(ends)
        lists = pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(np.concatenate([nothing.astype(np.int32), *found])))
        doc_ids = table.column("doc_ids").combine_chunks().slice(own[0], 1).flatten()
        return pa.table([doc_ids, pa.array(np.diff(stop)), lists, pa.array(digests, pa.string())], names=[f.split()[0] for f in schema.split(", ")])

    # blocks are large: more partitions than usual, so that few of them share one by chance
    return texts.unionByName(answers).repartition(4 * partitions, "block").groupBy("block").applyInArrow(finish, schema)


@lru_cache(2)
def _spelled(path: str) -> pa.Array:
    """For each id its decimal with a comma after it."""
    return pa.array([f"{i},".encode() for i in range(max(ranks_of(path).values()) + 1)], pa.binary())


def _joined(table: pa.Array, ids: np.ndarray, stop: np.ndarray) -> list[memoryview]:
    """The bytes of ids, concatenated, for each run of ids between two stops."""
    took = table.take(pa.array(ids))
    at = np.frombuffer(took.buffers()[1], "<i4", len(took) + 1, took.offset * 4)[stop]
    data = memoryview(took.buffers()[2] or b"")
    return [data[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with decoded (binary), the bytes of the column ids (array of int)."""
    return rows.withColumn("decoded", Expressions(ranks_of(path)).decoded(F.col("ids")))


def op5_bytebpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = decode(encode(docs, path, public_tokenizers.PATTERN), path)
    return found.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
