from __future__ import annotations

import math
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import simhash
from tests.llm.cases import empty, hard


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """{doc: smallest doc reachable} by comparing all pairs."""
    docs = sorted(fps)
    x = np.array([fps[d] for d in docs], np.uint64)
    name = dict(zip(docs, docs, strict=True))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    changed = True
    while changed:
        changed = False
        for i, d in enumerate(docs):
            low = min(name[docs[j]] for j in np.flatnonzero(near[i]))
            if low < name[d]:
                name[d], changed = low, True
    return name


@given(st.text(alphabet="aAbÉ \t\n\x0b\x85 ", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_matches_definition(text):
    assert simhash.simhash(text.encode()) == [plain(text)]


def check(rows, docs):
    fps = {d: plain(t) for d, t in docs.items()}
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in rows}
    want = components(fps)
    assert got == {d: (fps[d], want[d]) for d in docs} and len(rows) == len(docs)


def test_query(spark, sf):
    from tessera.llm.queries import op2_simhash

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_simhash(spark, sf).collect()
    want = components({d: plain(t) for d, t in docs.items()})
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{plain(t):016x}", want[d]) for d, t in docs.items()}


def test_hard_rows(spark):
    docs = hard(spark)
    check(simhash.near_duplicates(docs).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert simhash.near_duplicates(empty(spark)).count() == 0


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 12, np.uint64)
    fp = centres[rng.integers(0, 12, n)]
    for _ in range(5):
        flip = np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        fp = np.where(rng.random(n) < 0.45, fp ^ flip, fp)
    return np.unique(np.r_[fp, rng.integers(0, 2**63, n // 2, np.uint64)])


def test_links_leave_components_whole(spark):
    """Clusters whose buckets are searched breadth-first, against all pairs."""
    from tessera.operators.graph import connected_components

    for parts in (2, 3, 5, None):
        fp = clustered(1500, parts or 1)
        nodes = spark.createDataFrame([(int(x), int(x)) for x in fp.view(np.int64)], "node long, fp long")
        found = simhash.links(nodes, parts=parts)
        assert found.count() < 60 * len(fp)
        got = {r.node: r.component for r in connected_components(found, "a", "b").collect()}
        want = components(dict(zip(fp.view(np.int64).tolist(), fp.tolist(), strict=True)))
        assert {k: got.get(k, k) for k in want} == want


def test_large_buckets_are_dealt_to_tasks_and_pass_by_in_batches(spark, monkeypatch):
    from tessera.operators import joins
    from tessera.operators.graph import connected_components

    monkeypatch.setattr(simhash, "BLOCK_NODES", 20)
    monkeypatch.setattr(simhash, "SMALL_BUCKET", 4)
    fp = clustered(1500, 9)
    nodes = spark.createDataFrame([(int(x), int(x)) for x in fp.view(np.int64)], "node long, fp long")
    want = components(dict(zip(fp.view(np.int64).tolist(), fp.tolist(), strict=True)))
    for held in (simhash.HELD_ROWS, 10):
        monkeypatch.setattr(simhash, "HELD_ROWS", held)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        got = {r.node: r.component for r in connected_components(simhash.links(nodes, parts=3), "a", "b").collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {k: got.get(k, k) for k in want} == want
    monkeypatch.setattr(joins, "MANY_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_KEYS", 5)
    docs = hard(spark)
    check(simhash.near_duplicates(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_plans_for_no_fingerprints_probe_few_buckets():
    for radius in (4, 13):
        groups, thresholds = simhash.cheapest_plan(np.zeros((64, 64)), 0, radius, None)
        assert sum(t + 1 for t in thresholds) == radius + 1
        assert sum(math.comb(len(g), r) for g, t in zip(groups, thresholds, strict=True) for r in range(t + 1)) < 100


def test_number_of_parts_follows_the_number_of_fingerprints():
    both = np.full((64, 64), 0.25) + np.eye(64) * 0.25
    few, many = (len(simhash.cheapest_plan(both * n, n, 4, None)[0]) for n in (10_000, 10**9))
    assert few > many


def test_thresholds_follow_the_pigeonhole_rule():
    rng = np.random.default_rng(1)
    bits = (rng.random((4000, 64)) < np.linspace(0.02, 0.5, 64)).astype(float)
    both = bits.T @ bits
    for parts in (2, 3, 4, 5):
        groups = simhash.correlated_parts(both, 4000, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(t + 1 for t in simhash.allocate(groups, both, 4000, 4)[1]) == 5


def jaccard(a, b):
    def of(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    a, b = of(a), of(b)
    return len(a & b) / len(a | b)


def test_near_copies_of_similarity_are_grouped_and_others_left_alone(spark):
    from corpus_pipeline import NEAR

    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    rows, family = [], {}
    for base in range(60):
        words = rng.choice(vocabulary, 300).tolist()
        for copy in range(4):
            x = list(words)
            for at in rng.choice(300, 0 if copy == 0 else 5, replace=False):
                x[at] = str(rng.choice(vocabulary))
            family[len(rows)] = base
            rows.append((len(rows), " ".join(x)))
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **NEAR).collect()}
    assert jaccard(rows[0][1], rows[1][1]) >= 0.8
    assert all(family[c] == family[d] for d, c in found.items())
    assert np.mean([c == 4 * family[d] for d, c in found.items()]) > 0.97


def test_representatives(spark):
    docs = hard(spark)
    kept = simhash.representatives(docs.union(docs))
    assert kept.columns == docs.columns
    want = set(components({r.doc_id: plain(r.text) for r in docs.collect()}).values())
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
