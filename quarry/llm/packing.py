"""Packing of token sequences by minimum bin slack.

Documents are tokenized and cut into pieces of at most one window. How many
pieces of each length exist is all that the plan needs: at most one count per
length up to the window, whatever the corpus. The plan fixes the longest
remaining length, lets a bitset subset-sum over the remaining lengths and counts
find the sum closest to what is left of the window, backtracks which lengths
with which counts make it, and uses that pattern as often as the counts allow;
so each step uses some length up, and the number of patterns depends on the
window alone. The patterns give each length's ranks their sequence and offset.

Ranks within a length come from a range partitioning by length, document and
start: tasks count their rows, the driver adds up one count per partition and
length in it, and tasks number their rows from there. A length that a third of
all pieces share is dealt out like any other.

Cases: a null text is empty and has only the closing id; repeated rows are
pieces of their own; a null doc_id stays null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import shared_dir, trim, written

WINDOW = 2048


@lru_cache(4)
def encoder(path: str, pattern: str):
    """Encodes a text to the ids that the ``tokenizers`` library gives for the byte-level BPE file at ``path``.

    In such a file ids below the added tokens are in merge order, so the same
    ids follow from ranks by the faster ``tiktoken``. Texts that hold an added
    token's string go to ``tokenizers`` itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # byte-level files spell printable bytes as themselves and number the others from 256 on
    printable = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    del spec, ranks
    plain = lru_cache(1)(lambda: Tokenizer.from_file(path))

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return plain().encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


def token_pieces(docs: DataFrame, path: str, pattern: str, closing_id: int = 1, window: int = WINDOW) -> DataFrame:
    """doc_id, start, ids (binary, little-endian unsigned 32-bit), length, doc_tokens: pieces of at most ``window`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        for b in batches:
            which, start, ids, length, total, held = [], [], [], [], [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(which, pa.int64())), pa.array(start, pa.int64()), pa.array(ids, pa.binary()), pa.array(length, pa.int64()), pa.array(total, pa.int64())], ["doc_id", "start", "ids", "length", "doc_tokens"])  # noqa: B023

            for i, text in enumerate(x.as_py() for x in b.column("text")):
                own = np.array([*encode(text or ""), closing_id], "<u4")
                for at in range(0, len(own), window):
                    piece = own[at : at + window]
                    which.append(i)
                    start.append(at)
                    ids.append(piece.tobytes())
                    length.append(len(piece))
                    total.append(len(own))
                    held += len(piece)
                if held > 1 << 20:
                    yield out()
                    which, start, ids, length, total, held = [], [], [], [], [], 0
            if which:
                yield out()
            trim()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, start long, ids binary, length long, doc_tokens long")


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum comes closest to ``room`` from below."""
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            part = min(part, left)
            steps.append((reach, length, part))
            reach |= (reach << (length * part)) & ((1 << (room + 1)) - 1)
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, part in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + part
            total -= length * part
    return chosen


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: count}) of each pattern; together they use up ``counts``."""
    left = {x: n for x, n in counts.items() if n}
    found = []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = best_fill(left, window - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[x] // n for x, n in chosen.items())
        found.append((times, chosen))
        for x, n in chosen.items():
            left[x] -= times * n
            if not left[x]:
                del left[x]
    return found


def _placements(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length rows of (first rank, first sequence, count in a sequence, offset of the first)."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, chosen in patterns:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rows.setdefault(length, []).append((used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + times * n
            offset += n * length
        sequence += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (doc_id, start, length and more) with sequence_id and offset."""
    own = pieces.drop("sequence_id", "offset")
    shared_dir(own.sparkSession)
    ranged = written(own, "pieces").repartitionByRange("length", "doc_id", "start").checkpoint()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(window + 1, np.int64)
        for b in batches:
            total += np.bincount(b.column("length").to_numpy(), minlength=window + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), TaskContext.get().partitionId(), np.int64)), pa.array(at), pa.array(total[at])], ["pid", "length", "n"])

    counted = sorted((r.pid, r.length, r.n) for r in ranged.select("length").mapInArrow(count, "pid long, length long, n long").collect())
    totals: dict[int, int] = {}
    begins: dict[tuple[int, int], int] = {}
    for pid, length, n in counted:
        begins[(pid, length)] = totals.get(length, 0)
        totals[length] = totals.get(length, 0) + n
    held = own.sparkSession.sparkContext.broadcast((_placements(plan(totals, window)), begins))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placements, begins = held.value
        pid = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for b in batches:
            length = b.column("length").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                rank = np.arange(len(at)) + begins[(pid, x)] + seen.get(x, 0)
                seen[x] = seen.get(x, 0) + len(at)
                rows = placements[x]
                row = rows[np.searchsorted(rows[:, 0], rank, side="right") - 1]
                step = rank - row[:, 0]
                sequence[at] = row[:, 1] + step // row[:, 2]
                offset[at] = row[:, 3] + step % row[:, 2] * x
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(offset)], [*b.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    return ranged.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame) -> DataFrame:
    """Where each piece of each document goes, under the production settings, with a checksum of its ids."""
    import public_tokenizers

    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    return pack(digests)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
