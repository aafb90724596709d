"""Spelling correction against the index's vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import SHORTEST, STOPWORDS, stem
from quarry.operators.index import Index
from quarry.plans.query import LEXER


#: Words up to which a batch is broadcast; and the longest ones that are joined by deletions.
FEW, LONGEST = 10_000, 24


def allowed_distance(term: Column) -> Column:
    return F.when(F.length(term) <= 4, 1).otherwise(2)


def _shortened(word: Column) -> Column:
    """The word without one of its characters, for each of them."""
    size = F.length(word)
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, size)))


def _pairs(unknown: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Pairs of unknown stems and terms within two edits, and others: those that lack the same characters after at most two deletions each.

    Such keys are many and short-lived, so no key gathers a large share of the rows.
    Words longer than LONGEST, which have too many, are joined by their lengths.
    """

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        once = _shortened(F.col(name))
        twice = F.flatten(F.transform(once, _shortened))
        return rows.where(F.length(name) <= LONGEST).withColumn("key", F.explode(F.array_distinct(F.concat(F.array(name), once, twice))))

    short = keyed(vocabulary, "term").join(keyed(unknown, "stem"), "key").drop("key").distinct()
    return short.union(_by_length(unknown, vocabulary).where((F.length("term") > LONGEST) | (F.length("stem") > LONGEST)).select(*short.columns))


def _by_length(unknown: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Pairs whose lengths are within two of each other."""
    near = unknown.withColumn("size", F.explode(F.sequence(F.length("stem") - 2, F.length("stem") + 2)))
    return vocabulary.withColumn("size", F.length("term")).join(near, "size").drop("size")


def nearest_terms(words: DataFrame, terms: DataFrame) -> DataFrame:
    """word, best, distance: the nearest vocabulary term of each unknown stem (words: word, stem).

    A few words are broadcast and meet the terms of lengths within two of theirs; many
    meet by shared deletions. The smallest (distance, term) wins.
    """
    vocabulary = terms.select("term", "surface")
    unknown = words.join(terms.select(F.col("term").alias("stem")), "stem", "left_anti")
    pairs = _by_length(F.broadcast(unknown), vocabulary) if words.count() <= FEW else _pairs(unknown, vocabulary)
    scored = pairs.withColumn("distance", F.levenshtein("stem", "term", 2)).where("distance >= 0").where(F.col("distance") <= allowed_distance(F.col("stem")))
    return scored.groupBy("word").agg(F.min(F.struct("distance", "term", "surface")).alias("m")).select("word", F.coalesce("m.surface", "m.term").alias("best"), "m.distance")


def _checked(word: str) -> bool:
    raw = word.lower()
    return not (len(raw) < SHORTEST or raw in STOPWORDS or raw == "or")


def _words_of(query: str) -> list[tuple[str, list[str]]]:
    """For each lexed span a template with {} and the words that a correction may replace in it."""
    out = []
    for m in LEXER.finditer(query):
        span = m.group()
        if m.lastgroup == "word":
            keep = span.lower() == "or" or span.lower().startswith("site:") or (span[0] == "-" and len(span) > 1)
            out.append((span, None) if keep else ("{}", [span]))
        else:
            sign, inner = ("-", span[2:-1]) if m.lastgroup == "without" else ("", span[1:-1])
            out.append((sign + '"{}"', inner.split()))
    return out


def did_you_mean(index: Index, queries: dict[int, str]) -> dict[int, str | None]:
    """A corrected string for each query of the batch, or None where nothing changes."""
    spans = {qid: _words_of(q or "") for qid, q in queries.items()}
    words = sorted({w for s in spans.values() for _, ws in s for w in ws or [] if _checked(w)})
    fixes: dict[str, str] = {}
    if words:
        asked = index.docs.sparkSession.createDataFrame([(w, stem(w.lower())) for w in words], "word string, stem string")
        fixes = {r.word: r.best for r in nearest_terms(asked, index.terms).collect()}
    out: dict[int, str | None] = {}
    for qid, parts in spans.items():
        told = [t if ws is None else t.replace("{}", " ".join(fixes.get(w, w) for w in ws)) for t, ws in parts]
        changed = any(fixes.get(w, w) != w for _, ws in parts for w in ws or [])
        out[qid] = " ".join(told) if changed else None
    return out
