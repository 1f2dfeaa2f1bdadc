from __future__ import annotations

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import phrases
from tests.llm.cases import empty, hard


def names(text, level):
    sym, start = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1), np.zeros(1, int)
    for _ in range(level):
        sym, start = phrases.next_level(sym, start)
    return sym


@given(st.lists(st.integers(0, 3), min_size=1, max_size=200), st.lists(st.integers(0, 3), min_size=1, max_size=200))
@settings(max_examples=150, deadline=None)
def test_levels_shrink_and_documents_do_not_mix(a, b):
    for level in (1, 2, 3):
        x, y = names(bytes(a), level), names(bytes(b), level)
        both = np.array([*a, *b], np.uint64) + np.uint64(1)
        start = np.array([0, len(a)])
        for _ in range(level):
            both, start = phrases.next_level(both, start)
        assert np.array_equal(both[: start[1]], x) and np.array_equal(both[start[1] :], y)
    assert len(names(bytes(a), 1)) <= max(1, len(a) // 2)


def test_equal_substrings_share_interior_names_at_any_offset():
    rng = np.random.default_rng(5)
    common = rng.integers(97, 123, 3000).astype(np.uint8).tobytes()
    for k in range(1, 40):
        a = rng.integers(97, 123, 50 + k).astype(np.uint8).tobytes() + common
        b = rng.integers(97, 123, 200 - k).astype(np.uint8).tobytes() + common
        for level, edge in ((1, 12), (2, 12), (3, 12)):
            x, y = names(a, level).tolist(), names(b, level).tolist()
            n = len(names(common, level)) - edge
            assert x[-n:] == y[-n:]


def check(rows, docs):
    """docs: (doc_id, text) in descending order of doc_id."""
    texts = [(d, t or "") for d, t in docs]
    want = {}
    for i, (d, t) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        p, q, e = phrases.fingerprints([t.encode(), after.encode(), edited.encode()])
        hexed = lambda x: x.astype(">u2").tobytes().hex()
        want[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(p), hexed(e), float((p == e).mean()), float((p == q).mean()))
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(texts)


def test_query(spark, sf):
    from tessera.llm.queries import op1_phrases

    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    rows = op1_phrases(spark, sf).collect()
    check(rows, docs)
    long = [r for r in rows if r.n_chars > 300]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97
    assert 0.3 < np.mean([r.near_edited for r in long]) < 0.7


def test_hard_rows(spark):
    docs = hard(spark)
    want = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    for buckets in (1, 3, 50):
        check(phrases.edited_fingerprints(docs.repartition(3), buckets=buckets).collect(), want)
    assert phrases.edited_fingerprints(empty(spark)).count() == 0
    check(phrases.edited_fingerprints(docs.filter("doc_id = 1")).collect(), want[-1:])
    null = spark.createDataFrame([(None, "abc"), (None, "xyz")], "doc_id long, text string")
    assert phrases.edited_fingerprints(null).count() == 2
