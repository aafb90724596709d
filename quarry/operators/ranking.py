"""Retrieval and ranking of a batch of queries as one relational plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarry.operators.index import Index
from quarry.plans.query import parsed_rows, relations

K1, B = 1.5, 0.75
TITLE_WEIGHT, PHRASE_BOOST = 2.0, 1.5
TEXT_SHARE, PAGERANK_SHARE = 0.7, 0.3
#: Rows of a parsed batch up to which it is broadcast; larger batches are joined as Spark plans it.
BROADCAST_ROWS = 50_000
#: Different terms up to which a filter on terms is pushed into the scan of postings.
PUSHED_TERMS = 1_000
FIELDS = ("title", "body")


def idf(n_docs: int, df: Column) -> Column:
    return F.log1p((n_docs - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, mean: float) -> Column:
    """Saturated term frequency of one field; 0 where the field has no mean length."""
    if mean <= 0:
        return F.lit(0.0)
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class Batch:
    """One batch of queries {qid: text} over an index.

    A batch's terms meet the postings once. All postings of a (query, document) pair
    are gathered by one shuffle, summed up on the map side where they only add to the
    score; clauses, groups, exclusions and phrases are then expressions over the few
    postings of the pair.
    """

    def __init__(self, index: Index, queries: dict[int, str]):
        self.index, self.queries = index, queries
        spark = index.docs.sparkSession
        rows = parsed_rows(queries)
        self.small = len(rows) <= BROADCAST_ROWS
        self.parsed, self.asked = relations(spark, queries, rows)
        words = sorted({r[-1] for r in rows})
        pushed = 0 < len(words) <= PUSHED_TERMS
        self.postings, self.terms = (t.where(F.col("term").isin(words)) if pushed else t for t in (index.postings, index.terms))
        self.phrases = any(r[3] for r in rows)
        self.excludes = any(r[4] for r in rows)

    def _held(self, df: DataFrame) -> DataFrame:
        """A side of the size of the batch, broadcast if the batch is small."""
        return F.broadcast(df) if self.small else df

    def pairs(self) -> DataFrame:
        """qid, doc_id, bm25, found: the sum over the wanted terms' postings, and what of each clause occurs where."""
        n, body, title = self.index.stats()
        asked = self.terms.select("term", "df").join(self._held(self.parsed), "term")
        hits = self.postings.join(self._held(asked), "term")
        in_title = F.col("field") == "title"
        part = F.when(in_title, TITLE_WEIGHT * bm25(F.col("tf"), F.col("len"), title)).otherwise(bm25(F.col("tf"), F.col("len"), body))
        # positions matter to phrases only, and there relative to the place in the phrase
        starts = F.when(F.col("phrase"), F.transform("positions", lambda p: p - F.col("place")))
        found = F.struct("grp", "clause", "clauses", "phrase", "neg", "n_terms", "place", "field", starts.alias("starts"))
        score = F.when(~F.col("neg"), idf(n, F.col("df")) * part).otherwise(0.0)
        return hits.groupBy("qid", "doc_id").agg(F.sum(score).alias("bm25"), F.collect_list(found).alias("found"))

    def matched(self, found: Column) -> Column:
        """The clauses that the document matches: all terms, for phrases in a row in one field."""
        fields = ("grp", "clause", "clauses", "phrase", "neg", "n_terms")
        clauses = F.array_distinct(F.transform(found, lambda f: F.struct(*(f[c].alias(c) for c in fields))))

        def places(hits: Column) -> Column:
            return F.size(F.array_distinct(F.transform(hits, lambda f: f.place)))

        def in_a_row(hits: Column, n_terms: Column) -> Column:
            common = F.aggregate(F.slice(hits, 2, F.size(hits)), F.get(hits, F.lit(0)).starts, lambda acc, f: F.array_intersect(acc, f.starts))
            return (places(hits) == n_terms) & (F.size(common) > 0)

        def holds(c: Column) -> Column:
            own = F.filter(found, lambda f: f.clause == c.clause)
            loose = places(own) == c.n_terms
            if not self.phrases:
                return loose
            tight = F.lit(False)
            for field in FIELDS:
                tight = tight | in_a_row(F.filter(own, lambda f: f.field == field), c.n_terms)
            return F.when(c.phrase, tight).otherwise(loose)

        return F.filter(clauses, holds)

    def scores(self) -> DataFrame:
        """qid, doc_id, bm25 of the documents that match: all clauses of a group, the site, no excluded clause.

        Terms count as often as the query has them; a phrase that matches, of whatever
        group, raises the whole score once.
        """
        pairs = self.pairs().withColumn("matched", self.matched(F.col("found"))).drop("found")
        wanted = F.filter("matched", lambda c: ~c.neg)
        whole = F.exists(wanted, lambda c: F.size(F.filter(wanted, lambda d: d.grp == c.grp)) == c.clauses)
        good = whole & ~F.exists("matched", lambda c: c.neg) if self.excludes else whole
        boost = F.when(F.exists(wanted, lambda c: c.phrase), PHRASE_BOOST).otherwise(1.0) if self.phrases else F.lit(1.0)
        out = pairs.where(good).select("qid", "doc_id", (F.col("bm25") * boost).alias("bm25"))
        if not any("site:" in text.lower() for text in self.queries.values()):
            return out
        sites = self._held(self.asked.select("qid", "site"))
        url = self.index.docs.select("doc_id", F.lower("url").alias("url"))
        fits = "site IS NULL OR contains(url, concat('/', site, '/'))"
        return out.join(sites, "qid").join(url, "doc_id").where(fits).select("qid", "doc_id", "bm25")

    def blended(self, scores: DataFrame) -> DataFrame:
        """qid, doc_id, score: text score and PageRank, each scaled to its range over the query's candidates.

        The ranges are aggregates joined back, so that a query with very many
        candidates is not one task's; both uses of the scores read one shuffle.
        """
        ranked = scores.join(self.index.pagerank, "doc_id", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
        ends = ranked.groupBy("qid").agg(*(f(c).alias(f"{n}_{c}") for c in ("bm25", "pagerank") for f, n in ((F.min, "lo"), (F.max, "hi"))))
        both = ranked.join(self._held(ends), "qid")
        return both.select("qid", "doc_id", (TEXT_SHARE * scaled("bm25") + PAGERANK_SHARE * scaled("pagerank")).alias("score"))

    def ranked(self, n: int = 10) -> DataFrame:
        """qid, doc_id, score, rank: the best n, equal scores by document."""
        return top(self.blended(self.scores()), n)


def scaled(column: str) -> Column:
    """A column between its lo_ and hi_; 1 where these are equal."""
    lo, hi = F.col(f"lo_{column}"), F.col(f"hi_{column}")
    return F.when(lo == hi, 1.0).otherwise((F.col(column) - lo) / (hi - lo))


def top(scores: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
