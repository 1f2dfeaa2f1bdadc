from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import language
from tests.llm.cases import empty, hard


def test_query_finds_held_out_languages(spark, sf):
    from tessera.llm.queries import op7_language_id

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    right = [r.language == docs[r.doc_id].lang for r in rows if r.accepted]
    assert np.mean(right) > 0.97 and np.mean([r.accepted for r in rows]) > 0.97


def test_text_overrules_a_wrong_declaration_and_host_helps_short_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("truth", F.col("lang"))
    wrong = F.col("doc_id") % 10 == 0
    none = F.col("doc_id") % 10 == 1
    docs = docs.withColumn("lang", F.when(wrong, "en").when(none, None).otherwise(F.col("lang"))).withColumn("source", F.concat(F.lit("www."), "truth", F.lit(".example."), "truth"))
    got = {r.doc_id: r for r in language.identified(docs).collect()}
    truth = {r.doc_id: r.truth for r in docs.collect()}
    assert np.mean([got[d].language == t for d, t in truth.items()]) > 0.99
    assert {got[d].suffix for d in truth} == set(truth.values())


def test_trigram_cells_stay_within_texts():
    texts = [b"ab", b"", b"abcd", b"1 2!", b"x y"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    cell = language.trigram_cells(data, off)
    none = 1 << language.TRIGRAM_BITS
    assert [int((cell[i:j] != none).sum()) for i, j in zip(off[:-1], off[1:])] == [0, 0, 2, 0, 1]


def test_host_priors_are_smoothed_level_by_level(spark):
    rows = [("a.x.org", 0)] * 6 + [("b.x.org", 1)] * 2 + [("y.com", 1)] * 3
    prior = {r.host: r.prior for r in language.host_priors(spark.createDataFrame(rows, "host string, vote int"), ["l", "m"]).collect()}
    root = np.array([6 + 1, 5 + 1]) / 13
    w = language.HOST_WEIGHT
    up = lambda n, p: (np.array(n) + w * p) / (sum(n) + w)
    org, x = up([6, 2], root), None
    x = up([6, 2], org)
    assert np.allclose(prior["a.x.org"], up([6, 0], x)) and np.allclose(prior["b.x.org"], up([0, 2], x))


def test_hard_rows(spark):
    rows = {r.doc_id: r for r in language.identified(hard(spark)).collect()}
    assert len(rows) == 10 and all(rows[d].language == "und" and not rows[d].accepted for d in (2, 3, 4))
    assert rows[5][1:] == rows[6][1:]
    kept = language.accepted_documents(hard(spark))
    assert kept.columns == hard(spark).columns and {r.doc_id for r in kept.collect()} == {d for d, r in rows.items() if r.accepted}
    assert language.identified(empty(spark)).count() == 0 and language.accepted_documents(empty(spark)).count() == 0
    twice = language.accepted_documents(hard(spark).union(hard(spark)))
    assert all(n == 2 for n in Counter(r.doc_id for r in twice.collect()).values())
