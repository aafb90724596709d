"""Tokens and stems as column expressions.

The engine stems with a chain of patterns; the same rules as SQL CASE steps, which
serve as an oracle, are kept beside it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words without topical signal (fixed values).
STOPWORDS = """
a an the and or but if then else when at by for with about into
through during before after above below to from up down in out on off
over under again further once here there all any both each few more
most other some such no nor not only own same so than too very can
will just should now is are was were be been being have has had having
do does did doing would could ought i me my myself we our ours ourselves
you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who
whom this that these those am as of s t
""".split()
SHORTEST = 2


def raw_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order; null counts as empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def kept_tokens(text: Column) -> Column:
    """Raw tokens without stop words and without those of fewer than SHORTEST characters."""
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.filter(runs, lambda t: (F.length(t) >= SHORTEST) & ~t.isin(STOPWORDS))


#: The stemmer's steps as (pattern, replacement), each on the result of the one before; # marks that a suffix went.
PATTERNS = [
    ("sses$", "ss"),
    ("ies$", "i"),
    ("^(.{2,}[^su])s$", "$1"),
    ("^(.{3,})ing$", "$1#"),
    ("^(.{3,})ed$", "$1#"),
    (r"^(.+)([^aeiou])\2#$", "$1$2"),
    ("#$", ""),
    ("^(.{3,})e$", "$1"),
    ("^(.{4,})ly$", "$1"),
]


#: Endings that a word must have one of to be changed by PATTERNS.
ENDINGS = ("s", "ing", "ed", "e", "ly")


def stemmed(word: Column) -> Column:
    """The stem of a word. Words without any of the endings skip the patterns."""
    out, ends = word, F.lit(False)
    for pattern, replacement in PATTERNS:
        out = F.regexp_replace(out, pattern, replacement)
    for ending in ENDINGS:
        ends = ends | word.endswith(ending)
    return F.when(ends, out).otherwise(word)


def with_stem(rows: DataFrame, raw: str = "raw", name: str = "term") -> DataFrame:
    """``rows`` with the stem of the column ``raw`` under ``name``."""
    return rows.withColumn(name, stemmed(F.col(raw)))


#: The same as SQL for an oracle: (result, expression over the result before, which is written as {w}).
STEPS = [
    (
        "plural",
        "CASE WHEN {w} LIKE '%sses' THEN left({w}, length({w}) - 2) "
        "WHEN {w} LIKE '%ies' THEN concat(left({w}, length({w}) - 3), 'i') "
        "WHEN right({w}, 1) = 's' AND length({w}) > 3 AND right({w}, 2) NOT IN ('ss', 'us') THEN left({w}, length({w}) - 1) "
        "ELSE {w} END",
    ),
    (
        "suffix",
        "CASE WHEN right({w}, 3) = 'ing' AND length({w}) > 5 THEN concat(left({w}, length({w}) - 3), '#') "
        "WHEN right({w}, 2) = 'ed' AND length({w}) > 4 THEN concat(left({w}, length({w}) - 2), '#') ELSE {w} END",
    ),
    (
        "doubled",
        "CASE WHEN right({w}, 1) <> '#' THEN {w} "
        "WHEN length({w}) >= 4 AND substr({w}, length({w}) - 1, 1) = substr({w}, length({w}) - 2, 1) "
        "AND substr({w}, length({w}) - 1, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left({w}, length({w}) - 2) "
        "ELSE left({w}, length({w}) - 1) END",
    ),
    ("final_e", "CASE WHEN right({w}, 1) = 'e' AND length({w}) > 3 THEN left({w}, length({w}) - 1) ELSE {w} END"),
    ("adverb", "CASE WHEN right({w}, 2) = 'ly' AND length({w}) > 5 THEN left({w}, length({w}) - 2) ELSE {w} END"),
]


def stem_sql(source: str, raw: str = "raw", name: str = "term") -> str:
    """A SELECT of all columns of ``source`` and the stem of ``raw``, as nested subqueries."""
    before, inner = raw, source
    for step, expression in STEPS:
        inner = f"(SELECT *, {expression.format(w=before)} AS {step}_ FROM {inner})"
        before = f"{step}_"
    return f"SELECT * EXCLUDE ({', '.join(s + '_' for s, _ in STEPS)}), {before} AS {name} FROM {inner}"


def stem(word: str) -> str:
    """The stem of one word, for query strings on the driver."""
    for pattern, replacement in PATTERNS:
        word = re.sub(pattern, replacement.replace("$", "\\"), word)
    return word
