"""The pipeline against a brute-force version on a small table, and the registered queries."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quarry.llm import packing, simhash
from tests.llm.test_operators import brute_lines

P = pytest.importorskip("public_tokenizers")


def words(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x:x}o" for x in rng.integers(0, 1 << 20, n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = []
    for i in range(40):
        text = words(i, 120 if i % 3 else 3000)
        if i % 4 == 0:
            text = words(i - 1, 120) if i % 8 else text[:-1] + ["changed"]
        rows.append((i, " ".join(text) + ("\nShared notice of all\n" if i % 2 else "\n") + "end", ("en", "de")[i % 2], "src0", 1))
    rows += [(100 + i, rows[5][1], "en", "src0", 1) for i in range(5)] + [(200, None, "en", None, None), (201, "12 34", None, None, 5), (202, "", "en", None, 0), (5, rows[5][1], "de", "src0", 1)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    after = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, path), "stage")
        after.append(docs)
    assert all(d.columns == columns for d in after[:-1])
    assert {r.doc_id for r in after[0].collect()} == {r[0] for r in rows} - {200, 201, 202}
    kept = [r for r in rows if r[0] not in (200, 201, 202)]
    want = Counter((d, t) for d, _, _, t in brute_lines(kept, 10))
    assert Counter((r.doc_id, r.text) for r in after[1].collect()) == want and all(r.n_chars == len(r.text) for r in after[1].collect())
    texts = sorted(want)
    sets = [set(simhash.shingle_set(t, 5).tolist()) for _, t in texts]
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                part = [part[j] if p == part[i] else p for p in part]
    assert sorted((r.doc_id, r.text) for r in after[2].collect()) == sorted(min(t for t, q in zip(texts, part, strict=True) if q == p) for p in set(part))
    encode = packing.encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    sizes = {r.doc_id: len(encode(r.text)) + 1 for r in after[2].collect()}
    placed = after[3].collect()
    held = Counter()
    for r in placed:
        held[r.doc_id] += r.length
    assert held == sizes
    assert sorted((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, path).collect()) == sorted((r.doc_id, r.start, r.length) for r in placed)


def test_near_copies_at_the_threshold(spark):
    """Pairs from 0.8 to 0.9 are linked, pairs under 0.8 are not; a chain of links is one component."""
    rows, want = [], set()
    for i in range(60):
        text = words(1000 + i, 200)
        other = list(text)
        for k in range(4 if i < 40 else 7):  # five shingles each: Jaccard 0.815, 0.697
            other[20 + 25 * k] = "changed"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
        want |= {2 * i} if i < 40 else {2 * i, 2 * i + 1}
    chain = words(5000, 200)
    for k in range(30):  # each next one is near the one before, the ends share nothing like 0.8
        chain = [*chain[:6 * k], *(f"x{k}y{j}" for j in range(6)), *chain[6 * k + 6 :]]
        rows.append((500 + k, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()}
    assert got == want | {500}


def test_extra_columns_and_empty_tables(spark, folder):
    """Columns named like helpers and results stay as they are; without documents there are no pieces."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    names = ("score", "lang_pred", "spans", "fp", "fps", "node", "key", "component", "n_dropped", "kept", "keep", "line", "row__", "no_id")
    extra = docs
    for name in names:
        extra = extra.withColumn(name, F.lit(f"own {name}"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = extra.columns
        extra = corpus_pipeline.written(stage(spark, extra, folder[0]), "stage")
        assert extra.columns == before
        assert all(r[name] == f"own {name}" for r in extra.select(*names).distinct().collect() for name in names) and extra.count()
    assert corpus_pipeline.STAGES[-1][1](spark, extra, folder[0]).count()
    nothing = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        nothing = corpus_pipeline.written(stage(spark, nothing, folder[0]), "stage")
        assert nothing.count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {n.split("_")[0] for n in names}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
