"""Language-model scores by a weighted backoff automaton over all n-grams.

Tokens are words (A-Z lower-cased, split at ASCII white space), then one end. The
lowest order is the smoothed unigram over all training tokens,
(c + 0.5) / (N + 0.5 (V + 1)); higher orders are smoothed by Dirichlet priors:

    p(w | v)   = (c(vw)  + k1 p(w))     / (c(v)  + k1)
    p(w | u v) = (c(uvw) + k2 p(w | v)) / (c(uv) + k2)

A context that training holds is a state, an n-gram that training holds an arc.
Where a state has no arc for a token, its failure arc leads to the shorter context
for the weight k / (c + k), which is what the formulas say of a count of 0. All
bigrams and trigrams of the training texts count, those that occur once too, so the
model grows with the corpus; no task and not the driver holds more than a block's
part of it.

Texts are cut into blocks of at most ``BLOCK_TOKENS`` tokens, written as numbers of
the block's distinct words. Each block sends its distinct words, bigrams and trigrams,
with their training counts inside the block, as sorted hashes packed by hash range.
Equal ones of all blocks meet, are added up, and each block gets the sums back in the
order it sent them. So a block knows the counts of all n-grams that its texts can ask
for: its part of the automaton, which one left-to-right traversal of each text walks,
carrying the state. An n-gram is sent once a block however often it occurs, so no
key is hot. Words go by hashes of 64 bits, n-grams by ``CODE_BITS``: of 10^12 different
n-grams, one in 10^5 shares its code with another.

Cases: a null text is empty and has only the end token; each row gets its own result
row, repeated rows equal ones; a text longer than a block is cut, its parts carry two
tokens of context and are added up; without training texts N is 0, no state has arcs,
and each token has probability 1; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import trim, written

#: The end token: no word has a space in it.
END = b" "
#: The hash that stands for a text's start.
START = 1
#: The priors k1 and k2.
PRIORS = (500.0, 1.0)
CODE_BITS = 56
#: Tokens of a block; tokens of the texts that share an automaton in memory; codes that meet in a bucket, on average.
BLOCK_TOKENS, RUN_TOKENS, BUCKET_CODES = 1 << 20, 1 << 17, 1 << 20
#: Different words whose hashes a task remembers.
REMEMBERED = 400_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hash_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42) if word else START


class Hashes(dict):
    """Words' hashes, each made once, and the words by their hashes; the empty word is a text's start."""

    def __init__(self):
        super().__init__()
        self.word = {}

    def __missing__(self, word: bytes) -> int:
        self[word] = h = hash_of(word)
        self.word[h] = word
        return h

    def forget(self) -> bool:
        if full := len(self) >= REMEMBERED:
            self.clear()
            self.word.clear()
        return full


def squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, compressed byte by byte."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def loosened(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each two hashes in their order."""
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


BLOCKS = "block long, tokens long, doc_ids array<long>, texts array<long>, parts binary, words binary, stream binary"


def blocks_of(batches: Iterator[pa.RecordBatch], pid: int) -> Iterator[pa.RecordBatch]:
    """The texts of one task (doc_id, text, trains) in blocks.

    texts numbers the rows, parts has three numbers for each (tokens, those of them
    that are context only, whether it trains), words the distinct words, frequent ones
    first (the empty one is the start), and stream a number of a word for each token.
    """
    hashes = Hashes()
    waiting: list[tuple] = []
    size = done = texts = 0

    def out() -> pa.RecordBatch:
        # the end's count, which is that of the starts, is asked for by every block
        end = np.array([hashes[END]], np.uint64)
        hashes[b""]
        own, number, n = np.unique(np.concatenate([*(w[4] for w in waiting), end]), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        parts = np.array([(len(x), context, learns) for _, _, context, learns, x in waiting], np.int64).ravel()
        columns = [
            pa.array([pid << 32 | done], pa.int64()),
            pa.array([size], pa.int64()),
            pa.array([[w[0] for w in waiting]], pa.list_(pa.int64())),
            pa.array([[w[1] for w in waiting]], pa.list_(pa.int64())),
            pa.array([squeezed(parts)], pa.binary()),
            # shorter than their hashes
            pa.array([zstandard.compress(b"\n".join(map(hashes.word.__getitem__, own[order].tolist())), 3)], pa.binary()),
            pa.array([squeezed(place[number[:-1]])], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCKS.split(", ")])

    for b in batches:
        for doc_id, text, learns in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "trains")), strict=True):
            own = words(text)
            x = np.fromiter((START, *map(hashes.__getitem__, own), hashes[END]), np.uint64, len(own) + 2)
            texts += 1
            at = 1
            while at < len(x):
                context = min(at, 2)
                part = x[at - context : at + BLOCK_TOKENS - size]
                waiting.append((doc_id, pid << 40 | texts, context, learns, part))
                at += len(part) - context
                size += len(part) - context
                if size >= BLOCK_TOKENS:
                    yield out()
                    waiting, size, done = [], 0, done + 1
                    if hashes.forget():  # but not what the rest of this text needs
                        hashes.word.update(zip(x.tolist(), [b"", *own, END], strict=True))
                    trim()
    if waiting:
        yield out()


def coded_blocks(docs: DataFrame, trains: Column) -> DataFrame:
    """The texts of ``docs`` (doc_id, text) in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from blocks_of(batches, TaskContext.get().partitionId())

    chosen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(trains, F.lit(False)).alias("trains"),
    )
    return chosen.mapInArrow(run, BLOCKS)


class Block:
    """A block's tokens and codes.

    x numbers each token's word, hashes is by word, parts says of each text's part what
    BLOCKS says, stops where parts begin and end; own tells tokens that aren't context,
    learns those that train; by_token[k] is the code of the k + 1 tokens that end there.
    """

    def __init__(self, row: dict):
        self.hashes = np.fromiter(map(hash_of, zstandard.decompress(row["words"]).split(b"\n")), np.uint64)
        self.x = loosened(row["stream"]).astype(np.int64)
        self.parts = loosened(row["parts"]).astype(np.int64).reshape(-1, 3)
        sizes, context, learns = self.parts.T
        self.stops = np.append(0, np.cumsum(sizes))
        place = np.arange(len(self.x)) - np.repeat(self.stops[:-1], sizes)
        self.own = place >= np.repeat(context, sizes)
        self.learns = self.own & (np.repeat(learns, sizes) > 0)
        self.place = place
        h = self.hashes[self.x]
        shift = np.uint64(64 - CODE_BITS)
        two = np.zeros(len(h), np.uint64)
        two[1:] = mixed(h[:-1], h[1:])
        three = np.zeros(len(h), np.uint64)
        three[2:] = mixed(two[1:-1], h[2:])
        self.by_token = [h, two >> shift, three >> shift]

    def order(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted distinct codes of order k + 1, which of them the tokens end that end one, and where these are."""
        ends = np.flatnonzero(self.place >= k)
        return *np.unique(self.by_token[k][ends], return_inverse=True), ends

    def sent(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct codes of order k + 1 and how often each occurs in training texts."""
        ends = np.flatnonzero(self.place >= k)
        if not len(ends):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if k == 0:
            n = np.bincount(self.x, self.learns, len(self.hashes)).astype(np.int64)
            order = np.argsort(self.hashes)
            return self.hashes[order], n[order]
        both = np.sort(self.by_token[k][ends] << np.uint64(1) | self.learns[ends].astype(np.uint64))
        code = both >> np.uint64(1)
        first = np.append(0, np.flatnonzero(code[1:] != code[:-1]) + 1)
        return code[first], np.add.reduceat((both & np.uint64(1)).astype(np.int64), first)


def _edges(k: int, buckets: int) -> np.ndarray:
    """The first code of each bucket but the first."""
    bits = 64 if k == 0 else CODE_BITS
    return np.array([(i << bits) // buckets for i in range(1, buckets)], np.uint64)


def _ngrams(blocks: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, codes, n: for each order the block's codes in a range of hashes (as differences), and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                block = Block(row)
                codes: list[list] = [[] for _ in range(buckets)]
                counts: list[list] = [[] for _ in range(buckets)]
                for k in range(3):
                    code, n = block.sent(k)
                    at = [0, *np.searchsorted(code, _edges(k, buckets)).tolist(), len(code)]
                    for bucket, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
                        codes[bucket].append(squeezed(np.diff(code[lo:hi], prepend=np.uint64(0))))
                        counts[bucket].append(squeezed(n[lo:hi]))
                names = ["block", "bucket", "codes", "n"]
                kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.binary())] * 2]
                values = [[row["block"]] * buckets, list(range(buckets)), codes, counts]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names)
                del block
                trim()

    return blocks.select("block", "parts", "words", "stream").mapInArrow(run, "block long, bucket int, codes array<binary>, n array<binary>")


def _added_up(ngrams: DataFrame) -> DataFrame:
    """block, bucket, n: the counts of the block's codes over all blocks; tokens and distinct words of the bucket's training words, in one of its rows."""

    def meet(table: pa.Table) -> pa.Table:
        codes, counts = table.column("codes").to_pylist(), table.column("n").to_pylist()
        answers: list[list[bytes]] = [[] for _ in codes]
        total = distinct = 0
        for k in range(3):
            own = [np.cumsum(loosened(c[k]), dtype=np.uint64) for c in codes]
            n = [loosened(c[k]).astype(np.int64) for c in counts]
            known, number = np.unique(np.concatenate(own), return_inverse=True)
            sums = np.bincount(number, np.concatenate(n), len(known)).astype(np.int64)
            if k == 0:
                total, distinct = int(sums.sum()), int((sums > 0).sum())
            stops = np.cumsum([len(x) for x in own])
            for i, places in enumerate(np.split(number, stops[:-1])):
                answers[i].append(squeezed(sums[places]))
        trim()
        rest = [0] * (len(codes) - 1)
        return pa.table(
            [
                table.column("block"),
                table.column("bucket"),
                pa.array(answers, pa.list_(pa.binary())),
                pa.array([total, *rest], pa.int64()),
                pa.array([distinct, *rest], pa.int64()),
            ],
            names=["block", "bucket", "n", "total", "distinct_words"],
        )

    return ngrams.groupBy("bucket").applyInArrow(meet, "block long, bucket int, n array<binary>, total long, distinct_words long")


class Words:
    """A block's words as states and as unigram arcs: ``p`` has each one's probability, ``size`` how often training has it as a context."""

    def __init__(self, p: np.ndarray, size: np.ndarray, prior: float = PRIORS[0]):
        self.p, self.size, self.prior = p, size, prior
        self.weight = np.log10(p).tolist()
        # a word that training doesn't hold leads to the state without context
        self.to = np.where(size > 0, 1 + np.arange(len(p)), 0).tolist()
        self.back = np.log10(prior / (size + prior)).tolist()


class Automaton:
    """States are 0 (no context), 1 + w (a word), 1 + words + k (the k-th pair).

    ``pairs`` (first word, second word, count) and ``triples`` (number of the pair of the
    first two words, number of the pair of the last two, count) are those that training
    holds. Arc k is that of the k-th pair, from its first word's state; arc pairs + k that
    of the k-th triple, from its first pair's state. An arc leads to the pair's state of
    its last two words; a pair's failure arc to its second word's state.
    """

    def __init__(self, words: Words, pairs: tuple, triples: tuple, prior: float = PRIORS[1]):
        (u, v, n2), (head, tail, n3) = pairs, triples
        lower = (n2 + words.prior * words.p[v]) / (words.size[u] + words.prior)
        upper = (n3 + prior * lower[tail]) / (n2[head] + prior)
        self.words, self.first_pair = words, 1 + len(words.p)
        self.weight = np.log10(np.concatenate([lower, upper])).tolist()
        self.to = np.concatenate([self.first_pair + np.arange(len(u)), self.first_pair + tail]).tolist()
        self.fail = (1 + v).tolist()
        self.back = np.log10(prior / (n2 + prior)).tolist()

    def traverse(self, tokens: list[int], from_word: list[int], from_pair: list[int], context: int) -> float:
        """The log10 probability of the tokens after the first ``context`` of them.

        from_word and from_pair have for each token the arc that it takes from the state
        of the word before it, and of the two words before it; -1 where there is none.
        """
        words, first_pair = self.words, self.first_pair
        weight, to, fail, back, word_back = self.weight, self.to, self.fail, self.back, words.back
        state, total = 0, 0.0
        for i, w in enumerate(tokens):
            if i == context:
                total = 0.0
            if state >= first_pair:
                arc = from_pair[i]
                if arc >= 0:
                    total += weight[arc]
                    state = to[arc]
                    continue
                total += back[state - first_pair]
                state = fail[state - first_pair]
            if state:
                arc = from_word[i]
                if arc >= 0:
                    total += weight[arc]
                    state = to[arc]
                    continue
                total += word_back[state - 1]
            total += words.weight[w]
            state = words.to[w]
        return total


def scored(block: Block, counts: list[np.ndarray], total: int, distinct: int) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base and automaton scores of a block's parts."""
    x, stops = block.x, block.stops
    n1 = np.empty(len(block.hashes), np.int64)
    n1[np.argsort(block.hashes)] = counts[0]
    p = (n1 + 0.5) / (total + 0.5 * (distinct + 1))
    size = n1.copy()
    # as many starts as ends
    size[block.hashes == np.uint64(START)] = n1[block.hashes == np.uint64(xxhash.xxh64_intdigest(END, 42))]
    # which of the block's n-grams ends at each token, -1 for none, and its count in training
    at, n = [], []
    for k in (1, 2):
        codes, which, ends = block.order(k)
        if len(codes) != len(counts[k]):
            raise ValueError("a block's counts are not those of its n-grams")
        place = np.full(len(x), -1, np.int32)
        place[ends] = which
        seen = np.zeros(len(x), np.int64)
        seen[ends] = counts[k][which]
        at.append(place)
        n.append(seen)
    own = block.own
    running = lambda values: np.diff(np.append(0, np.cumsum(values))[stops])
    base = np.add.reduceat(np.where(own, np.log10(p)[x], 0.0), stops[:-1]) if len(x) else np.zeros(0)
    scores = np.zeros(len(stops) - 1)
    words = Words(p, size)
    first = 0
    while first < len(scores):
        last = max(first + 1, int(np.searchsorted(stops, stops[first] + RUN_TOKENS, side="right")) - 1)
        lo, hi = stops[first], stops[last]

        def arcs(k: int, lo: int = lo, hi: int = hi) -> tuple[np.ndarray, np.ndarray]:
            """Where the run's different n-grams that training holds end first, and the number of that n-gram at each token."""
            ends = lo + np.flatnonzero(n[k][lo:hi] > 0)
            _, place, number = np.unique(at[k][ends], return_index=True, return_inverse=True)
            by_token = np.full(hi - lo, -1)
            by_token[ends - lo] = number
            return ends[place], by_token

        two, pair_at = arcs(0)
        three, triple_at = arcs(1)
        automaton = Automaton(words, (x[two - 1], x[two], n[0][two]), (pair_at[three - 1 - lo], pair_at[three - lo], n[1][three]))
        triple_at[triple_at >= 0] += len(two)
        for i in range(first, last):
            part = slice(stops[i] - lo, stops[i + 1] - lo)
            scores[i] = automaton.traverse(x[lo:hi][part].tolist(), pair_at[part].tolist(), triple_at[part].tolist(), int(block.parts[i, 1]))
        first = last
    return running(own), running(own & (n1[x] > 0)), base, scores


def score(docs: DataFrame, trains: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text).

    The model learns from the rows where ``trains`` holds.
    """
    spark = docs.sparkSession
    blocks = written(coded_blocks(docs, trains), "blocks")
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    # distinct codes are at most three a token, some 1.7 in practice
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * tokens // BUCKET_CODES))
    answers = written(_added_up(_ngrams(blocks, buckets)), "counts")
    row = answers.agg(F.sum("total"), F.sum("distinct_words")).first()
    total, distinct = int(row[0] or 0), int(row[1] or 0)
    schema = "doc_id long, number long, n_tokens long, n_known long, base double, score double"

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1:
            raise ValueError("counts came back to no block")
        row = left.to_pylist()[0]
        order = np.argsort(right.column("bucket").to_numpy())
        got = [right.column("n")[int(i)].as_py() for i in order]
        counts = [np.concatenate([loosened(g[k]).astype(np.int64) for g in got]) for k in range(3)]
        n, known, base, scores = scored(Block(row), counts, total, distinct)
        trim()
        columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["texts"], pa.int64()), *map(pa.array, (n, known, base, scores))]
        return pa.table(columns, names=[c.split()[0] for c in schema.split(", ")])

    texts = blocks.select("block", "doc_ids", "texts", "parts", "words", "stream")
    parts = texts.groupBy("block").cogroup(answers.select("block", "bucket", "n").groupBy("block")).applyInArrow(finish, schema)
    return (
        parts.groupBy("number")
        .agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
        .select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
    )


def remainder(mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def op7_lmscore(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, remainder(5) != 1).withColumn("held_out", remainder(5) == 1)
