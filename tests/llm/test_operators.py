"""Small cases for each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarry.llm import bytebpe, embeddup, flac, langid, licenses, linededup, lmscore, packing, simhash, warc
from quarry.llm.shared import connected_components

P = pytest.importorskip("public_tokenizers")
TEXT = "the quick brown fox jumps over the lazy dog near the river bank while birds sing in tall trees all day long"
LONG = " ".join(f"word{i % 997} and{i % 31}" for i in range(20_000))
ROWS = [
    (1, TEXT, "en", "src0", 5), (2, TEXT, "en", None, 5), (3, TEXT.upper(), None, "src0", 5), (4, None, "en", "src1", None), (5, "", None, None, 0),
    (6, " \t\n ", "de", "x", 3), (7, LONG, "en", "src0", 9), (8, TEXT.replace("lazy", "idle"), "en", "src0", 1), (8, TEXT.replace("lazy", "idle"), "en", "src0", 1),
    (None, "no id here", "en", "src0", 1), (10, "Straße und Übermut für den Ärger der größeren Häuser", "de", "q", 1), (11, "日本語のテキスト", "ja", "q", 1), (12, "123 456 !!", "en", "q", 1), (13, "x" * 5000, "en", "q", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    """The documents with columns named like results and helpers."""
    for name in ("fp", "component_id", "keep", "score", "lang_pred", "words", "key", "length", "media", "labels", "n_lines"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- SimHash


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, bits):
    part = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    lows = {p: min((i for i, q in zip(ids, part, strict=True) if q == p and i is not None), default=None) for p in part}
    return [lows[p] for p in part]


def test_simhash(docs, none, clashing):
    fps = [brute_fingerprint(r[1], 4) for r in ROWS]
    want = Counter((r[0], f, c) for r, f, c in zip(ROWS, fps, brute_components(fps, [r[0] for r in ROWS], 4), strict=True))
    for df in (docs, clashing):
        got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df, 4, 4).collect())
        assert got == want
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.fingerprint(None, 4) == simhash.fingerprint(" \n", 4) == 0


def test_op1_simhash(spark, docs, tmp_path):
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    fps = [brute_fingerprint(r[1], 4) for r in ROWS]
    want = Counter((r[0], f"{f:016x}", c) for r, f, c in zip(ROWS, fps, brute_components(fps, [r[0] for r in ROWS], 4), strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, str(tmp_path)).collect()) == want


def test_fingerprint_of_many_blocks(monkeypatch):
    text = LONG + " the end"
    want = brute_fingerprint(text, 4)
    for block in (1 << 15, 1000, 7):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert simhash.fingerprint(text, 4) == want
    whole = simhash.prints_of_set(simhash.shingle_set(text, 5)).tolist()
    monkeypatch.setattr(simhash, "ORDERED", 13)
    assert simhash.prints_of_set(simhash.shingle_set(text, 5)).tolist() == whole


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9, 0.95])
def test_similar_sets_meet(similarity):
    """Sets of a similarity share a sampled fingerprint as often as the docstring says."""
    rng, met, n = np.random.default_rng(11), 0, 200
    for _ in range(n):
        size = int(rng.integers(20, 400))
        own = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
        apart = max(1, round(size * (1 - similarity) / (1 + similarity)))  # shingles that only one of the two has
        a, z = (simhash.prints_of_set(np.unique(x)) for x in (own[:size], own[apart : size + apart]))
        met += bool((a[1:] == z[1:]).any())
    assert met >= 0.97 * n


def test_hub_of_components(spark):
    """A node with very many neighbours: one component, and the join of a hub can be split."""
    edges = spark.range(1, 20_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")).union(spark.range(20_001, 20_010).selectExpr("id", "id + 1"))
    got = Counter(r.component for r in connected_components(edges).collect())
    assert got == {0: 20_001, 20_001: 10}


def test_near_pairs_are_complete(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    made = [int(b) for b in base]
    for b in base.tolist():
        for n in (1, 2, 3, 4, 5):
            made.append(b ^ sum(1 << int(i) for i in rng.choice(64, n, replace=False)))
    made = sorted(set(made))
    for bits in (1, 3, 4, 5):
        want = {(a, b) for a in made for b in made if a < b and (a ^ b).bit_count() <= bits}
        df = spark.createDataFrame([(m - (1 << 64) if m >= 1 << 63 else m,) for m in made], "fp long")
        found = [tuple(sorted((r.u % (1 << 64), r.v % (1 << 64)))) for r in simhash.near_pairs(df, bits).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_one_of_each(docs, none, clashing):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and simhash.one_of_each(none).count() == 0
    ids = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(8) <= 1 and ids.count(4) == 1 and 5 not in ids and 6 not in ids
    assert simhash.one_of_each(clashing).count() == kept.count()


def test_one_of_each_of_tied_rows(spark):
    rows = [(1, TEXT, "en", "b", 5), (1, TEXT, "en", "a", 5), (1, TEXT, None, "c", 5), (2, TEXT, "aa", "a", 5)]
    for n in (1, 3):
        got = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect()
        assert [tuple(r) for r in got] == [rows[1]]


# --- language ID


def test_langid(docs, none, clashing):
    model = langid.train(docs)
    got = {(r.doc_id, r.text): r for r in langid.identify(docs, model).collect()}
    assert got[(10, ROWS[10][1])].lang_pred == "de" and got[(11, ROWS[11][1])].lang_pred == "ja" and got[(1, TEXT)].lang_pred == "en"
    assert [got[(i, t)].lang_pred for i, t in ((4, None), (5, ""), (6, " \t\n "), (12, "123 456 !!"))] == ["und"] * 4
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(clashing, model, False).where("lang_pred = 'clash'").count() == 0
    empty = langid.train(none)
    assert langid.identify(docs, empty).where("lang_pred <> 'und' OR score <> 0").count() == 0 and langid.identify(none, model).count() == 0


def plain_words(text):
    """(start, letters) of each run of letters, lower-cased one by one."""
    out, run = [], []
    for i, c in enumerate([*(text or ""), " "]):
        if c.isalpha():
            run.append(c.lower() if len(c.lower()) == 1 else c)
        elif run:
            out.append((i - len(run), run))
            run = []
    return out


def plain_trigrams(letters):
    for a, b, c in zip([0, *map(ord, letters)], map(ord, letters), [*map(ord, letters[1:]), 0]):
        x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) % (1 << 64)
        yield ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) % (1 << 64) >> 64 - 16


def plain_script(c):
    return [name for first, name in langid.RANGES if first <= ord(c)][-1]


def brute_langid(train, text):
    """The language and its share of letters, by counts in dictionaries and by dynamic programming word by word."""
    langs = sorted({lang for t, lang in train if lang is not None and t is not None})
    grams, scripts = {k: Counter() for k in langs}, {k: Counter() for k in langs}
    for t, lang in train:
        for _, run in plain_words(t) if lang is not None else []:
            grams[lang].update(plain_trigrams(run))
            scripts[lang].update(map(plain_script, run))
    own = {k: {x for x, n in scripts[k].items() if x and n >= 0.01 * sum(scripts[k].values())} for k in langs}
    words = plain_words(text)
    if not words or not langs:
        return "und", 0.0
    value, back, known = {k: 0.0 for k in langs}, [], []
    for n, (_, run) in enumerate(words):
        mine = set(map(plain_script, run))
        good = [k for k in langs if mine <= own[k]] or [k for k in langs if mine & own[k]]
        known.append(bool(good))
        raw = {k: sum(math.log((grams[k][g] + 0.5) / (sum(grams[k].values()) + 0.5 * langid.BUCKETS)) for g in plain_trigrams(run)) for k in good}
        score = {k: max(raw[k] - max(raw.values()), -1e4) if k in raw else -1e4 if good else 0.0 for k in langs}
        top = max(langs, key=lambda k: value[k])
        source = {k: top if n and value[top] - langid.SWITCH > value[k] else k for k in langs}
        value = {k: max(value[k], value[top] - langid.SWITCH if n else value[k]) + score[k] for k in langs}
        back.append(source)
    path = [max(langs, key=lambda k: value[k])]
    for source in back[:0:-1]:
        path.append(source[path[-1]])
    share = Counter({k: 0 for k in langs})
    for (_, run), k, sure in zip(words, path[::-1], known, strict=True):
        share[k] += len(run) * sure
    best = max(langs, key=lambda k: share[k])
    return best, share[best] / max(sum(share.values()), 1)


def test_op2_langid(spark, tmp_path):
    """The query against plain counts and dynamic programming; mixed, foreign and blank texts."""
    rng = np.random.default_rng(9)
    make = {"aa": "abcdeilmnorst", "bb": "aeioukpqrz", "cc": "äöüßeinrst", "dd": "абвгдеж"}
    word = lambda k: "".join(rng.choice(list(make[k]), int(rng.integers(1, 8))))
    rows = []
    for i in range(60):
        k = ("aa", "bb", "cc", "dd")[i % 4]
        other = ("aa", "bb", "cc", "dd")[int(rng.integers(4))]
        text = " ".join([word(k) for _ in range(12)] + [word(other) for _ in range(i % 9)])
        rows.append((i, text.title() if i % 5 == 0 else text, k if i % 6 else None, "s", 1))
    rows += [(70, None, "aa", "s", 0), (71, "", "bb", "s", 0), (72, "12 34 !", "cc", "s", 1), (73, "日本 語", "aa", "s", 1), (74, "日本 abc abc", None, "s", 1), (74, "日本 abc abc", None, "s", 1), (None, "abc deil", "aa", "s", 1)]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 4 == 2 for r in rows]
    train = [(r[1], r[2]) for r, h in zip(rows, held, strict=True) if not h]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for r, h in zip(rows, held, strict=True):
        lang, share = brute_langid(train, r[1])
        want[(r[0], h, lang, round(share, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in langid.op2_langid(spark, str(tmp_path)).collect()) == want


def test_long_texts_in_pieces(docs, monkeypatch):
    model = langid.train(docs)
    texts = [f"{TEXT} " * 30 + "Straße und Übermut für den Ärger der Häuser " * 9 + TEXT, "", None, "x" * 300, TEXT]
    whole = langid.label_texts(model, texts, True)
    for letters, cells in ((1 << 20, 1), (50, 1 << 22), (7, 10), (1, 1)):
        monkeypatch.setattr(langid, "LETTERS", letters)
        monkeypatch.setattr(langid, "CELLS", cells)
        assert langid.label_texts(model, texts, True) == whole


def test_langid_memory(docs):
    """A batch of 16 MB of text needs little memory beside it."""
    import tracemalloc

    model = langid.train(docs)
    texts = pa.array(["Straße und Übermut für den Ärger der Häuser " * 90] * 4000)
    tracemalloc.start()
    found = langid.labelled(model, texts, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(found.field("lang_pred").to_pylist()) == {"de"} and peak < 120e6


def test_langid_in_slices(docs, monkeypatch):
    whole = Counter((r.doc_id, r.text, r.lang_pred, r.score, tuple(r.spans)) for r in langid.identify(docs, langid.train(docs)).collect())
    monkeypatch.setattr(langid, "SLICE_BYTES", 100)
    table = pa.record_batch({"text": pa.array(["a" * 60, None, "b" * 60, "c" * 300, "", "d"])})
    assert [len(b) for b in langid._slices(table, table.column("text"))] == [2, 1, 1, 2]
    assert Counter((r.doc_id, r.text, r.lang_pred, r.score, tuple(r.spans)) for r in langid.identify(docs, langid.train(docs)).collect()) == whole


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        langid.train(spark.createDataFrame([("a text", f"l{i}") for i in range(5)], "text string, lang string"))


def test_spans_of_mixed_text(docs):
    model = langid.train(docs)
    text = f"{TEXT}. Straße und Übermut für den Ärger der Häuser! 日本語のテキスト"
    ((_, _, spans),) = langid.label_texts(model, [text], True)
    assert [s[2] for s in spans] == ["en", "de", "ja"] and text[spans[1][0] : spans[1][1]].startswith("Straße")


def test_viterbi_is_best():
    import itertools

    rng = np.random.default_rng(2)
    sizes = np.array([4, 0, 3])
    score = rng.normal(size=(7, 3)) * 3

    def value(path, at):
        return sum(score[at + i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))

    got = langid.viterbi(score, sizes, 2.0)
    for at, n in ((0, 4), (4, 3)):
        best = max(value(p, at) for p in itertools.product(range(3), repeat=n))
        assert math.isclose(value(got[at : at + n].tolist(), at), best)


# --- packing


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    placed = packing.pack(packing.token_pieces(docs, path, P.PATTERN)).collect()
    by_text = Counter()
    for r in placed:
        by_text[(r.doc_id, r.start, r.ids, r.doc_tokens)] += 1
        assert r.length * 4 == len(r.ids) and r.length <= 2048
    want = Counter()
    for doc_id, text, *_ in ROWS:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 2048):
            want[(doc_id, at, np.array(ids[at : at + 2048], "<u4").tobytes(), len(ids))] += 1
    assert by_text == want
    ends = {}
    for r in sorted(placed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and sorted(ends) == list(range(len(ends)))
    assert packing.pack(packing.token_pieces(none, path, P.PATTERN)).count() == 0


def test_special_strings():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    text = "a <|endoftext|> b  　c  \n d's"
    assert packing.encoder(path, P.PATTERN)(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_best_fill_is_closest():
    import itertools

    counts = {7: 2, 5: 1, 11: 3, 13: 1, 2: 1}
    items = [x for x, n in counts.items() for _ in range(n)]
    for room in range(60):
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        chosen = packing.best_fill(counts, room)
        assert sum(x * n for x, n in chosen.items()) == best and all(n <= counts[x] for x, n in chosen.items())
    used = Counter()
    for times, chosen in packing.plan(counts, 20):
        assert sum(x * n for x, n in chosen.items()) <= 20
        for x, n in chosen.items():
            used[x] += times * n
    assert used == counts


# --- licenses


def test_licenses(spark, none):
    full = dict(licenses.TEMPLATES)["bsd"]
    rows = [
        (1, "Released under the MIT License. An MIT  license!"), (2, full), (3, " ".join(full.split()[:-4])), (4, " ".join(full.split()[:8])), (5, None), (6, ""), (7, "GENERAL-public_license; apache\nlicense"),
        (8, "mit"), (9, "MIT LICENSE"), (9, "MIT LICENSE"), (10, "Licensed under\nCC BY-NC 4.0\n\nother text"), (None, "apache license"), (12, "the of and " * 5000 + "general public license"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"words": F.lit(1), "key": F.lit(2), "hits": F.lit(3)})
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    one = got[1][0]
    assert (one.n_words, one.n_base, one.first_word, one.last_word, one.base_labels, one.labels, one.score) == (8, 2, 3, 6, "mit", "mit", 1.0)
    assert got[2][0].labels == "bsd" and got[2][0].score == 1.0 and got[2][0].base_labels == ""
    assert got[3][0].labels == "bsd" and 0.8 <= got[3][0].score < 1 and got[4][0].labels == ""
    assert (got[5][0].n_words, got[5][0].first_word, got[6][0].labels) == (0, None, "")
    assert got[7][0].base_labels == "apache,gpl" and (got[7][0].first_word, got[7][0].last_word) == (0, 3)
    assert len(got[9]) == 2 and got[9][0].n_base == 1 and got[8][0].n_base == 0
    assert got[10][0].labels == "cc-by-nc-4.0" and got[None][0].base_labels == "apache" and got[12][0].first_word == 15000
    assert licenses.scan(none).count() == 0


# --- byte-level BPE


def test_bytebpe(spark, docs, none, clashing, tmp_path):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bytebpe.ranks_of(path)
    said = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.ids_sha256) for r in bytebpe.encode(clashing, path, P.PATTERN).collect())
    want, full = Counter(), Counter()
    for doc_id, text, *_ in ROWS:
        ids = said.encode_ordinary(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[(doc_id, len(ids), tuple(ids), digest)] += 1
        full[(doc_id, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest())] += 1
    assert got == want and bytebpe.encode(none, path, P.PATTERN).count() == 0
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = bytebpe.op5_bytebpe(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == full
    back = bytebpe.decode(spark.createDataFrame([(said.encode_ordinary("naïve 日本 x"),), ([],)], "ids array<int>"), path).collect()
    assert [bytes(r.decoded).decode() for r in back] == ["naïve 日本 x", ""]
    for word in (b"a" * 3000, "é".encode() * 700, b"hello"):
        assert bytebpe.merge_with_heap(word, ranks) == said.encode_ordinary(word.decode())


def test_bytebpe_numbers_words(monkeypatch):
    """Pieces of letters only skip the pattern where it takes them whole; hashes depend on a word's bytes alone."""
    import regex

    texts = ["Straße it's don't I'll 'sup ſſ łódź", " The  quick, (brown) fox2 x\ty", "", "ʼn ª º µ × ÷ a\u0301b ΑΒ 日本 ĳ", "a'b we've " + "x" * 200, "naïve\n\nÀÿ ÖØ öø", "a" * 64 + " " + "a" * 65]
    split = r"\p{Lu}?\p{Ll}+|\p{L}|\s+|."
    for pattern in (P.PATTERN, split):
        words_in, asked = regex.compile(pattern).findall, []
        count, pieces, number = bytebpe.pieces_of(pa.array(texts))
        place, sizes, words = bytebpe.words_of(pieces, pattern, lambda p, f=words_in, a=asked: a.append(p) or f(p))
        starts, found, at = np.append(0, np.cumsum(sizes)), words.to_pylist(), 0
        for text, n in zip(texts, count, strict=True):
            got = [w for i in place[number[at : at + n]] for w in found[starts[i] : starts[i + 1]]]
            at += n
            assert got == words_in(text)
        assert len(asked) < len(pieces) if pattern == P.PATTERN else len(asked) == len(pieces)
    words = pa.array([w.encode() for w in ["", "a", "ab", "ba", "a" * 64, "a" * 65, *map(str, range(3000))]])
    want = bytebpe.buckets_of(words, 50)
    monkeypatch.setattr(bytebpe, "STEP_WORDS", 7)
    assert bytebpe.buckets_of(words, 50).tolist() == want.tolist() and bytebpe.buckets_of(words.slice(5, 90), 50).tolist() == want[5:95].tolist()
    assert np.bincount(want, minlength=50).min() > 20 and bytebpe.buckets_of(words.slice(0, 0), 50).tolist() == []


# --- FLAC


def test_flac_round_trip(docs, none):
    found = flac.decode(flac.encode(docs)).collect()
    payloads = Counter(b"".join(b.pcm for b in r.blocks) for r in found)
    assert payloads == Counter(flac.padded(r[1])[1] for r in ROWS)
    assert all([b.sample_offset for b in r.blocks] == list(range(0, 576 * len(r.blocks), 576)) for r in found)
    assert flac.decode(flac.encode(none)).count() == 0


def test_flac_samples_of_all_kinds():
    rng = np.random.default_rng(3)
    t = np.arange(576 * 3)
    made = [rng.integers(0, 256, 576 * 2, dtype=np.uint8), np.full(576, 7, np.uint8), (128 + 100 * np.sin(t / 9)).astype(np.uint8), (t // 3 % 256).astype(np.uint8), np.tile([0, 255], 288).astype(np.uint8)]
    streams = flac.encode_streams([m.tobytes() for m in made])
    assert [b"".join(x for _, x in d) for d in flac.decode_streams(streams)] == [m.tobytes() for m in made]
    kinds = {flac.metadata(s)[0]["samples"] for s in streams}
    assert kinds == {len(m) for m in made}


def test_flac_reads_without_a_seek_table():
    (stream,) = flac.encode_streams([flac.padded(LONG[:3000])[1]])
    at = flac.metadata(stream)[1]
    bare = stream[:4] + b"\x80" + stream[5:42] + stream[at:]
    assert flac.decode_streams([bare]) == flac.decode_streams([stream])


@pytest.mark.parametrize("where", [-1, -40, 46])
def test_flac_finds_damage(where):
    (stream,) = flac.encode_streams([flac.padded(TEXT)[1]])
    broken = bytearray(stream)
    broken[flac.metadata(stream)[1] + 2 if where == 46 else where] ^= 4
    with pytest.raises(ValueError, match="CRC|header"):
        flac.decode_streams([bytes(broken)])


# --- language model


def brute_base(train, text):
    counts = Counter(w for t in train for w in [*lmscore.words(t), b" "])
    total, distinct = sum(counts.values()), len(counts)
    own = [*lmscore.words(text), b" "]
    return sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own), len(own), sum(counts[w] > 0 for w in own), total


def lm_training(rows):
    """The texts of (doc_id, text, ...) that op7_lmscore learns from."""
    return [r[1] for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1]


def brute_score(train, text):
    """log10 of the model's probability of the text, straight from the formulas of the docstring."""
    coded = [["<s>", *lmscore.words(t), b" "] for t in train]
    grams = Counter(tuple(x[i : i + n]) for x in coded for n in (1, 2, 3) for i in range(len(x) - n + 1))
    total, distinct = sum(len(x) - 1 for x in coded), len({w for x in coded for w in x[1:]})

    def p(context, w):
        if not context:
            return (grams[(w,)] + 0.5) / (total + 0.5 * (distinct + 1))
        k = lmscore.PRIORS[len(context) - 1]
        return (grams[(*context, w)] + k * p(context[1:], w)) / (grams[context] + k)

    x = ["<s>", *lmscore.words(text), b" "]
    return sum(math.log10(p(tuple(x[max(0, i - 2) : i]), x[i])) for i in range(1, len(x)))


def lm_matches(got, rows, train):
    """Each row of (doc_id, text) has its result among got, once."""
    want = Counter()
    for r in rows:
        base, n, known, total = brute_base(train, r[1])
        want[(r[0], n, known, total, round(base, 6), round(brute_score(train, r[1]), 6))] += 1
    return Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_lmscore(docs, none, clashing):
    learns = lmscore.remainder(5) != 1
    rows = [r for r in ROWS if r[0] != 7]
    assert lm_matches(lmscore.score(clashing.where("doc_id <> 7 OR doc_id IS NULL"), learns).collect(), rows, lm_training(rows))
    got = lmscore.score(docs, learns).where("doc_id = 7").first()
    base, n, known, total = brute_base(lm_training(ROWS), LONG)
    assert (got.n_tokens, got.n_known, got.train_tokens) == (n, known, total) and math.isclose(got.base_score, base, rel_tol=1e-9)
    assert lmscore.score(none, learns).count() == 0
    assert all(r.score == 0 and r.base_score == 0 for r in lmscore.score(docs.where("doc_id = 5"), F.lit(False)).collect())


@pytest.mark.parametrize(("block", "run"), [(1 << 20, 1 << 16), (50, 30), (7, 5), (1, 1)])
def test_lmscore_in_blocks(spark, monkeypatch, block, run):
    """Texts cut over many blocks get the scores of the whole model; n-grams that occur once count."""
    monkeypatch.setattr(lmscore, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lmscore, "RUN_TOKENS", run)
    monkeypatch.setattr(lmscore, "REMEMBERED", 10)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.6, 20) % 40) for _ in range(8)] + [TEXT, TEXT, "", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, "the quick brown fox w1 w2 unseen dog"), (99, "the quick brown fox w1 w2 unseen dog")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert lm_matches(scored_here(frame, F.col("doc_id") < 90), rows, texts)


def scored_here(frame, trains):
    """What score() does, in this process, where patched settings hold."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("trains", pa.bool_())])
    batches = pa.Table.from_pylist(frame.select("doc_id", "text", trains.alias("trains")).toArrow().to_pylist(), schema).to_batches(max_chunksize=5)
    rows = [row for b in lmscore.blocks_of(batches, 0) for row in b.to_pylist()]
    blocks = [lmscore.Block(row) for row in rows]
    counts = [Counter(), Counter(), Counter()]
    for b in blocks:
        for k in range(3):
            for code, n in zip(*b.sent(k), strict=True):
                counts[k][int(code)] += int(n)
    total, distinct = sum(counts[0].values()), sum(n > 0 for n in counts[0].values())
    sums = {}
    for row, b in zip(rows, blocks, strict=True):
        own = [np.array([counts[k][int(c)] for c in b.sent(k)[0]], np.int64) for k in range(3)]
        for text, doc, n, known, base, score in zip(row["texts"], row["doc_ids"], *lmscore.scored(b, own, total, distinct), strict=True):
            was = sums.setdefault(text, [doc, 0, 0, 0.0, 0.0])
            was[1:] = [was[1] + n, was[2] + known, was[3] + base, was[4] + score]
    return [Row(doc_id=d, n_tokens=n, n_known=k, train_tokens=total, base_score=b, score=s) for d, n, k, b, s in sums.values()]


def test_automaton_is_a_distribution():
    """From each state the probabilities of all words, unknown ones included, add up to 1."""
    rng = np.random.default_rng(3)
    x = np.append(rng.integers(0, 6, 200), 6)  # word 6 ends the text, word 7 is unknown
    pairs, triples = Counter(zip(x[:-1], x[1:])), Counter(zip(x[:-2], x[1:-1], x[2:]))
    number = {g: i for i, g in enumerate(pairs)}
    n = np.bincount(x, minlength=8)
    p = (n + 0.5) / (len(x) + 0.5 * 8)
    size = np.where(np.arange(8) == 6, 0, n)  # nothing follows the end
    two = tuple(np.array(c) for c in zip(*((u, v, k) for (u, v), k in pairs.items())))
    three = tuple(np.array(c) for c in zip(*((number[g[:2]], number[g[1:]], k) for g, k in triples.items())))
    a = lmscore.Automaton(lmscore.Words(p, size, 2.0), two, three, 0.7)
    three_at = {g: len(number) + i for i, g in enumerate(triples)}

    def walked(x, context):
        before = [number.get((u, v), -1) for u, v in zip([None, *x], x, strict=False)]
        further = [three_at.get(g, -1) for g in zip([None, None, *x], [None, *x], x, strict=False)]
        return a.traverse(x, before, further, context)

    for context in [[], *([u] for u in range(6)), *(list(g) for g in pairs if g[1] != 6)]:
        assert math.isclose(sum(10 ** walked([*context, w], len(context)) for w in range(8)), 1, rel_tol=1e-9)


def test_op7_lmscore(spark, docs, tmp_path):
    rows = [r for r in ROWS if r[0] != 7]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = lmscore.op7_lmscore(spark, str(tmp_path)).collect()
    assert lm_matches(got, rows, lm_training(rows))
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 1) for r in got)


# --- embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 64))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    for i, v in enumerate(base):  # copies, scaled copies, and copies around the threshold
        rows += [(100 + i, v.tolist(), i % 3), (200 + i, (2 * v).tolist(), i % 3)]
        noise = rng.normal(size=64)
        noise -= v * (noise @ v) / (v @ v)
        angle = math.acos(0.98) * rng.uniform(0.2, 1.8)
        rows.append((300 + i, (v / np.linalg.norm(v) + math.tan(angle) * noise / np.linalg.norm(noise)).tolist(), i % 3))
    rows += [(400, None, 1), (401, [0.0] * 64, 1), (402, [float("nan")] + [1.0] * 63, 1), (403, [None] + [1.0] * 63, 1), (404, base[0].tolist(), None), (405, [], 1), (406, [1.0, 2.0], 0), (407, [1.0, 2.0], 0), (None, base[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"node": F.lit(1), "cell": F.lit("x"), "dim": F.lit(2.5)})
    vec = {}
    for k, (i, v, label) in enumerate(rows):
        good = v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)
        vec[k] = (i, label, np.array(v) if good else None)
    links = {k: [m for m, b in vec.items() if m != k and a[2] is not None and b[2] is not None and a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] / (np.linalg.norm(a[2]) * np.linalg.norm(b[2])) >= 0.98] for k, a in vec.items()}
    want = Counter()
    for k, (i, _, _) in vec.items():
        seen, todo = {k}, [k]
        while todo:
            for m in links[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        low = min((vec[m][0] for m in seen if vec[m][0] is not None), default=None)
        want[(i, len(links[k]), low, i is not None and i == low)] += 1
    got = Counter(tuple(r) for r in embeddup.near_duplicates(df).collect())
    assert got == want
    assert embeddup.near_duplicates(df.where("false")).count() == 0


def test_blocks_meet(spark, monkeypatch):
    """Cells of many blocks find the same links as one block."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.02).tolist(), 0) for i in range(60)] + [(100 + i, rng.normal(size=16).tolist(), 0) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = rows_of(embeddup.near_duplicates(df))
    monkeypatch.setattr(embeddup, "BLOCK", 7)
    assert rows_of(embeddup.near_duplicates(df)) == whole and max(r[1] for r in whole) >= 50


def threshold_pairs(n, dim, cosine):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return x, x * cosine + noise * math.sqrt(1 - cosine**2)


def test_recall_of_threshold_pairs():
    """Pairs just above the threshold meet in a grid and pass the count, whether sorted or compared in pairs."""
    n, dim = 20_000, 64
    x, y = threshold_pairs(n, dim, 0.9801)
    grid = embeddup.Grid(dim, 0.98)
    cells = [np.array([grid.cells(v) for v in m]) for m in (x, y)]
    assert (cells[0] == cells[1]).any(1).sum() >= n - 10
    # unrelated vectors: less than a tenth of the pairs
    met = np.mean([(cells[0][i] == cells[0][i + 1]).any() for i in range(n - 1)])
    assert met < 0.1
    for size in (2, 200):  # groups of the pair alone; groups of a hundred pairs
        rows = np.stack([x[:3000], y[:3000]], 1).reshape(-1, dim)
        first = np.arange(0, 6000, size)
        none = np.zeros((6000, 1), np.int64)  # one grid, one cell
        a, b = embeddup.linked_pairs(rows, np.full(6000, -1), first, none, np.zeros(6000, np.int64), 0.98)
        assert len(a) >= 2985 and (np.abs(a - b) == 1).all()
        side = np.tile([0, 1], 3000)
        a, b = embeddup.linked_pairs(rows, side, first, none, np.zeros(6000, np.int64), 0.98)
        assert len(a) >= 2985 and (side[a] != side[b]).all()


def test_op8_embeddup(spark, tmp_path):
    """The query against brute force, over many small labels and one large one, in partitions that groups cross."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 32))
    rows = [(i, (base[i % 300] + rng.normal(size=32) * 0.07).tolist(), i % 7 if i % 3 else 0) for i in range(1200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    x = np.array([np.array(r[1], np.float32) for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    component = np.arange(1200)
    for _ in range(50):
        component = np.minimum(component, np.where(near, component, 1200).min(1))
    want = sorted((i, int(near[i].sum()), int(component[i]), bool(component[i] == i)) for i in range(1200))
    assert sum(w[1] for w in want) > 500
    assert sorted(tuple(r) for r in embeddup.op8_embeddup(spark, str(tmp_path)).collect()) == want


# --- WARC


def test_warc(spark, tmp_path):
    body = "<p>" + "x" * 200 + "</p>"
    rows = [(3, "http://a/\r\nb", body), (1, None, body), (2, "u", body), (2, "u", body), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", body), (9, "u", "é" * 60), (10, "u", "é" * 60), (11, "u", "\x1f\u008b\x08" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "member": F.lit(2), "n": F.lit(3)})
    path = f"file://{tmp_path}/w"
    warc.write_archives(df.repartition(3), path)
    for size in (17, 300, 1 << 20):
        got = Counter((r.record_id, r.warc_type, r.refers_to, r.payload_length, bytes(r.block)) for r in warc.read_archives(spark, path, size).collect())
        assert sum(got.values()) == len(rows)
        kinds = Counter((k[0], k[1], k[2]) for k in got.elements())
        assert kinds[("<urn:page:1>", "response", None)] == 1 and kinds[("<urn:page:3>", "revisit", "<urn:page:1>")] == 1 and kinds[("<urn:page:2>", "revisit", "<urn:page:1>")] == 2
        assert kinds[("<urn:page:7>", "response", None)] == 1 and kinds[("<urn:page:10>", "revisit", "<urn:page:9>")] == 1 and kinds[("<urn:page:null>", "response", None)] == 1
        assert ("<urn:page:4>", "response", None, 0, b"") in got
    warc.write_archives(df.where("false"), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_reader_skips_false_magic(tmp_path):
    good = warc.gzip_member(warc.record("response", "1", "u", b"hello", "d", 5))
    other = warc.gzip_member(b"not a record")
    data = b"\x1f\x8b\x08junk" + other + good + b"\x1f\x8b\x08\x00" + good
    (tmp_path / "f").write_bytes(data)
    for cut in range(1, len(data), 7):
        got = [x[0] for a, b in ((0, cut), (cut, len(data))) for x in warc.records_in_range(f"file://{tmp_path}/f", a, b)]
        assert got == [7 + len(other), 7 + len(other) + len(good) + 4]


def test_members_end_with_zero():
    import gzip

    for data in (b"", b"abc", bytes(1 << 24)):
        member = warc.gzip_member(data, 1)
        assert member.endswith(b"\0") and gzip.decompress(member) == data


# --- line dedup


def brute_lines(rows, least, first=False):
    where = {}
    for k, (doc, text, *_) in enumerate(rows):
        for line in (text or "").split("\n"):
            key = line.encode().strip().lower()
            if key:
                where.setdefault(key, set()).add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if not (x.encode().strip().lower() and len(where[x.encode().strip().lower()]) >= least)]
        out.append((doc, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


LINES = [(i, f"Header {i % 2}\n own {i}\n\n\tCOMMON line \nx\ncommon LINE", None) for i in range(12)] + [(100, None, None), (101, "", None), (102, "common line", None), (102, "common line", None), (None, "common line\nlast ", None), (104, "\n" * 2000 + "x", None)]


@pytest.mark.parametrize("least", [2, 7, 10, 13, 99])
def test_linededup(spark, least):
    df = spark.createDataFrame(LINES, "doc_id long, text string, other string").withColumns({"keep": F.lit(1), "doc": F.lit(2), "gone": F.lit(3), "pos": F.lit(4)})
    marked = linededup.line_bitmaps(df, min_docs=least)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, linededup.kept_text(r.text or "", r.keep)) for r in marked.collect())
    assert got == Counter(brute_lines(LINES, least))


def test_linededup_over_partitions(spark):
    rows = [(i, f"hot\nown {i}\nrare {i // 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {(r.doc_id, r.n_dropped, linededup.kept_text(r.text, r.keep)) for r in linededup.line_bitmaps(df, 10).collect()}
    assert got == {(i, 1, f"own {i}\nrare {i // 2}") for i in range(3000)}
    kept = linededup.without_dropped_lines(df, min_docs=2, keep_first=True)
    held = Counter(line for r in kept.collect() for line in r.text.split("\n"))
    assert held["hot"] == 1 and all(held[f"rare {i}"] == 1 for i in range(1500)) and kept.columns == df.columns


def test_linededup_of_nothing(spark):
    assert linededup.line_bitmaps(spark.createDataFrame([], "doc_id long, text string")).count() == 0
