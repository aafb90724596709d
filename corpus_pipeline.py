"""A pipeline over ``documents``: language ID, line dedup, near-dedup, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; columns beside doc_id,
text and lang are carried along, whatever their names. A null or empty text has no
letters and goes in the first stage; a null doc_id counts as an id of its own, after
all others; repeated rows end as one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import langid, linededup, packing, simhash
from quarry.llm.shared import written

#: Share of a document's letters that its main language needs.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, most of them in one language of the labelled documents."""
    model = langid.train(docs.select("text", "lang"))
    # whole rows apart from the text, so that columns named like the result's stay as they are
    rows = docs.select("text", F.struct(*docs.columns).alias("row__"))
    found = langid.identify(rows, model, with_spans=False)
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SHARE)).select("row__.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more of them hold; n_chars follows the text."""
    kept = linededup.without_dropped_lines(docs, min_docs=10, min_key_chars=1)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: a link is an exact Jaccard similarity of at least 0.8
    of the sets of five-word shingles; SimHash fingerprints propose 0.998 of the pairs at 0.8, more above."""
    return simhash.one_of_each(docs, words_per_shingle=5, max_bits=4, least=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.packed_documents(docs)


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("packing", packed)]

#: SQL has neither the language model nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
