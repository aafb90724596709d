"""Language identification of mixed-language text.

A word is a run of letters. Ranges of code points give each word's scripts, and
only languages that the training texts write in those scripts stay candidates.
A candidate's word score is the sum of log-probabilities of the word's letter
trigrams (word ends included), hashed into a table of fixed size. A Viterbi pass
over the words, with a penalty for each change of language, labels spans; the
document's language is the one with most letters, and its score that language's
share of all letters in labelled spans.

Training counts cover every labelled text that is handed in. The model has
BUCKETS floats per language, whatever the corpus size; more than MOST_LANGS
languages are an error. A text longer than LETTERS is read in pieces cut between
words, with the same result.

Cases: a null text, or one without letters, is ``und`` with score 0; words in
scripts of no known language carry no evidence and join the spans around them;
a text of only such words gets the alphabetically first language with score 0;
without any training text all is ``und``; equal texts get equal labels; ties go
to the alphabetically first language; repeated rows stay; an empty table gives
an empty result; other columns stay, and those named like an added column are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import trim, written

#: Hash buckets of letter trigrams; a power of two.
BUCKETS = 1 << 16
#: Log-likelihood that a change of language costs, and what a trigram's count gets added.
SWITCH, SMOOTHING = 8.0, 0.5
#: Share of a language's letters from which a script counts as its own.
OWN_SCRIPT = 0.01
#: Letters handled at a time, scores (words times languages) of one Viterbi pass, and bytes of a batch's texts taken out of it at a time.
LETTERS, CELLS, SLICE_BYTES = 1 << 18, 1 << 22, 4 << 20
#: Languages that a model can hold: a task holds BUCKETS floats for each.
MOST_LANGS = 500
UND = "und"

#: First code points of ranges and the script of each range up to the next one; "" is none of these.
RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, ""), (0x0750, "arabic"), (0x0780, ""), (0x08A0, "arabic"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1380, ""), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, ""), (0x1C80, "cyrillic"),
    (0x1C90, "georgian"), (0x1CC0, ""), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C60, "latin"),
    (0x2C80, ""), (0x2DE0, "cyrillic"), (0x2E00, ""), (0x3040, "kana"), (0x3100, ""), (0x3130, "hangul"),
    (0x3190, ""), (0x31F0, "kana"), (0x3200, ""), (0x3400, "han"), (0xA000, ""), (0xA640, "cyrillic"), (0xA6A0, ""),
    (0xA720, "latin"), (0xA800, ""), (0xAB30, "latin"), (0xAB70, ""), (0xAC00, "hangul"), (0xD800, ""),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, ""), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, ""), (0x20000, "han"),
    (0x323B0, ""),
]
SCRIPTS = sorted({name for _, name in RANGES})


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, its lower case (if one code point), the bit of its script."""
    top = 0x110000
    letter = np.fromiter((chr(c).isalpha() for c in range(top)), bool, top)
    lower = np.arange(top, dtype=np.uint32)
    for c in np.flatnonzero(letter):
        if len(low := chr(c).lower()) == 1:
            lower[c] = ord(low)
    starts = np.array([a for a, _ in RANGES])
    bits = np.array([SCRIPTS.index(name) for _, name in RANGES])
    return letter, lower, bits[np.searchsorted(starts, np.arange(top), side="right") - 1].astype(np.uint8)


def words_of(texts: list[str]) -> dict[str, np.ndarray]:
    """The words of several texts: arrays by word (doc, start, size, scripts) and by letter (bucket, script, first letters of words)."""
    letter, lower, script = tables()
    raw = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.append(0, np.cumsum(sizes + 1))[:-1]
    at = np.flatnonzero(letter[raw])
    cp = lower[raw[at]].astype(np.uint64)
    joined = np.diff(at) == 1
    first = np.append(True, ~joined)[: len(at)]
    mixed = cp * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed[1:] += np.where(joined, cp[:-1], 0) * np.uint64(0x9E3779B97F4A7C15)
    mixed[:-1] += np.where(joined, cp[1:], 0) * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)
    heads = np.flatnonzero(first)
    own = script[raw[at]]
    start = at[heads]
    doc = np.searchsorted(begins, start, side="right") - 1
    scripts = np.bitwise_or.reduceat(np.uint32(1) << own.astype(np.uint32), heads) if len(heads) else np.zeros(0, np.uint32)
    return {"bucket": bucket, "script": own, "heads": heads, "doc": doc, "start": start - begins[doc], "size": np.diff(np.append(heads, len(at))), "scripts": scripts}


def _pieces(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """The texts in order as (number, offset, piece), about LETTERS characters at a time; longer texts are cut between words."""
    part, size = [], 0
    for number, t in enumerate(texts):
        at = 0
        while at < len(t) or not t:
            # a text that fits in one piece stays whole, so that its last piece ends a batch
            end = at + LETTERS if len(t) - at > LETTERS else len(t)
            while end < len(t) and t[end].isalpha():
                end += 1
            part.append((number, at, t[at:end]))
            size += end - at
            at = end
            if size >= LETTERS:
                yield part
                part, size = [], 0
            if not t:
                break
    if part:
        yield part


def _slices(b: pa.RecordBatch | pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch | pa.Array]:
    """Slices of a batch, whose texts these are, of at most SLICE_BYTES of text or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(size):
        before = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right")))
        yield b.slice(first, last - first)
        first = last


def train(labelled: DataFrame) -> dict:
    """A model from the columns text and lang; rows in which either is null teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for b in _slices(batch, batch.column("text")):
                frame = pd.DataFrame({"lang": b.column("lang").to_pylist(), "text": b.column("text").to_pylist()})
                for lang, group in frame.groupby("lang"):
                    total = seen.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                    for part in _pieces(list(group["text"])):
                        w = words_of([piece for _, _, piece in part])
                        total[:BUCKETS] += np.bincount(w["bucket"], minlength=BUCKETS)
                        total[BUCKETS:] += np.bincount(w["script"], minlength=len(SCRIPTS))
                del frame, group, part, w
            trim()  # an idle worker keeps what it holds, beside those of the next stage
        for lang, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "slot", "n"])

    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    counts = written(counts, "letter-counts")
    langs = sorted(r.lang for r in counts.select("lang").distinct().limit(MOST_LANGS + 1).collect())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} different values of lang: clean them first")
    found = counts.toArrow()
    of = {x: i for i, x in enumerate(langs)}
    table = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    if langs:
        table[[of[x] for x in found.column("lang").to_pylist()], found.column("slot").to_numpy()] = found.column("n").to_numpy()
    grams, letters = table[:, :BUCKETS] + SMOOTHING, table[:, BUCKETS:]
    own = letters >= OWN_SCRIPT * np.maximum(letters.sum(1, keepdims=True), 1)
    own[:, SCRIPTS.index("")] = False
    masks = (own * (1 << np.arange(len(SCRIPTS)))).sum(1).astype(np.uint32)
    return {"langs": langs, "logp": np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32).copy(), "scripts": masks}


def _scores(model: dict, w: dict[str, np.ndarray]) -> np.ndarray:
    """Words by languages: scores relative to the word's best candidate; others are far below."""
    n_langs = len(model["langs"])
    if not len(w["heads"]):
        return np.zeros((0, n_langs), np.float32)
    score = np.stack([np.add.reduceat(model["logp"][:, k][w["bucket"]], w["heads"]) for k in range(n_langs)], 1)
    fits = (model["scripts"][None, :] & w["scripts"][:, None]) == w["scripts"][:, None]
    some = (model["scripts"][None, :] & w["scripts"][:, None]) != 0
    fits = np.where(fits.any(1, keepdims=True), fits, some)
    known = fits.any(1)
    score = np.where(fits, score, -np.inf)
    best = np.where(known, score.max(1), 0)[:, None]
    return np.where(known[:, None], np.maximum(score - best, -1e4), 0).astype(np.float32)


def viterbi(score: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """The best language index of each word. ``score`` has the words of all texts in order, ``sizes`` the words of each text.

    All texts step forward together, the long ones first, so a step costs a few array operations.
    """
    begins = np.append(0, np.cumsum(sizes))[:-1]
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    label = np.zeros(len(score), np.int16)
    if not len(score):
        return label
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts with more than t words
    moved = np.zeros(score.shape, bool)
    source = np.zeros(len(score), np.int16)
    value = score[begins[: active[0]]].astype(np.float64)
    last = np.zeros(len(sizes), np.int16)
    last[: active[0]] = value.argmax(1)
    for t in range(1, sizes[0]):
        n = active[t]
        at = begins[:n] + t
        value = value[:n]
        top = value.argmax(1)
        other = value[np.arange(n), top][:, None] - switch
        moved[at] = other > value
        source[at] = top
        value = np.maximum(value, other) + score[at]
        last[:n] = value.argmax(1)
    for t in range(sizes[0] - 1, -1, -1):
        n = active[t]
        at = begins[:n] + t
        label[at] = last[:n]
        if t:
            last[:n] = np.where(moved[at, last[:n]], source[at], last[:n])
    return label


def label_texts(model: dict, texts: list[str | None], with_spans: bool, switch: float = SWITCH) -> list[tuple]:
    """(language, score, spans) of each text; a span is (first character, end, language)."""
    out: list[tuple] = []
    langs = model["langs"]

    def flush(parts: list[dict], scores: list[np.ndarray], n: int) -> None:
        w = {k: np.concatenate([p[k] for p in parts]) for k in ("doc", "start", "size", "scripts")}
        score = np.concatenate(scores)
        sizes = np.bincount(w["doc"], minlength=n)
        label = viterbi(score, sizes, switch)
        known = (model["scripts"][None, :] & w["scripts"][:, None]).any(1)
        share = np.bincount(w["doc"] * len(langs) + label, weights=w["size"] * known, minlength=n * len(langs)).reshape(n, -1)
        begin = np.append(0, np.cumsum(sizes))
        change = np.append(True, (label[1:] != label[:-1]) | (w["doc"][1:] != w["doc"][:-1]))[: len(label)]
        for d in range(n):
            if begin[d] == begin[d + 1]:
                out.append((UND, 0.0, []))
                continue
            best = int(share[d].argmax())
            spans = []
            if with_spans:
                a = np.flatnonzero(change[begin[d] : begin[d + 1]]) + begin[d]
                z = np.append(a[1:], begin[d + 1]) - 1
                spans = [(int(w["start"][i]), int(w["start"][j] + w["size"][j]), langs[label[i]]) for i, j in zip(a, z, strict=True)]
            out.append((langs[best], float(share[d, best] / max(share[d].sum(), 1)), spans))

    if not langs:
        return [(UND, 0.0, [])] * len(texts)
    parts, scores, done, cells = [], [], 0, 0
    whole = ["" if t is None else t for t in texts]
    for part in _pieces(whole):
        w = words_of([piece for _, _, piece in part])
        number, offset = (np.array(x, np.int64) for x in zip(*((n, at) for n, at, _ in part), strict=True))
        w["start"] = w["start"] + offset[w["doc"]]
        w["doc"] = number[w["doc"]] - done
        parts.append(w)
        scores.append(_scores(model, w))
        cells += scores[-1].size
        for k in ("bucket", "script", "heads"):
            del w[k]
        n, at, piece = part[-1]
        if cells >= CELLS and at + len(piece) == len(whole[n]):
            flush(parts, scores, n + 1 - done)
            parts, scores, done, cells = [], [], n + 1, 0
    if parts:
        flush(parts, scores, len(whole) - done)
    return out


def labelled(model: dict, texts: pa.Array, with_spans: bool) -> pa.Array:
    """A struct of lang_pred, score and, if asked for, spans for each text of a batch."""
    rows = [r for part in _slices(texts, texts) for r in label_texts(model, part.to_pylist(), with_spans)]
    columns = {"lang_pred": pa.array([r[0] for r in rows], pa.string()), "score": pa.array([r[1] for r in rows], pa.float64())}
    if with_spans:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        columns["spans"] = pa.array([[{"start": a, "end": z, "lang": x} for a, z, x in r[2]] for r in rows], kind)
    trim()
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def identify(docs: DataFrame, model: dict, with_spans: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score and, unless left out, spans (array of start, end, lang in characters of text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    @F.arrow_udf(T.StructType(fields + [T.StructField("spans", span)] * with_spans))
    def label(texts: pa.Array) -> pa.Array:
        return labelled(held.value, texts, with_spans)

    names = ["lang_pred", "score"] + ["spans"] * with_spans
    own = docs.drop(*names)
    return own.withColumn("__found", label(F.col("text").cast("string"))).select(*own.columns, *(F.col(f"__found.{n}").alias(n) for n in names))


def remainder(mod: int):
    """crc32(doc_id as text) mod ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(remainder(4) != 2).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), model, with_spans=False)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")
