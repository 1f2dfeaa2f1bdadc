from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import repeats
from tests.llm.cases import empty, hard


def plain(texts, length):
    """[(n_bytes, n_removed, n_spans, sha)] from all strings of ``length`` bytes."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def check(spark, rows, length=400, gram=96, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = defaultdict(list)
    for r in repeats.removed_repeats(docs, length=length, gram=gram).collect():
        if "é" not in (dict(rows).get(r.doc_id) or ""):
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    want = defaultdict(list)
    for (d, _), w in zip(rows, plain([t for _, t in rows], length), strict=True):
        want[d].append(w)
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}


def corpus(seed, n, alphabet, pieces, size):
    rng = random.Random(seed)
    shared = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(*size))) for _ in range(pieces)]
    rows = []
    for d in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.6:
                p = rng.choice(shared)
                i = rng.randrange(len(p))
                parts.append(p[i:] if rng.random() < 0.5 else p)
            else:
                parts.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(*size))))
        t = "".join(parts)
        if rng.random() < 0.3 and t:
            i = rng.randrange(len(t))
            t = t[:i] + "#" + t[i + 1 :]
        rows.append((d, t))
    return rows


def test_small_lengths_many_borders(spark):
    check(spark, corpus(1, 120, "abcdefgh", 12, (5, 90)), length=40, gram=12)


def test_periodic_texts_and_repeats_inside_one_document(spark):
    rows = [(1, "ab" * 300), (2, "ab" * 21 + "c"), (3, "x" * 39), (4, "x" * 41), (5, "y" * 500), (6, "abc" * 50 + "q" + "abc" * 13), (7, None), (8, ""), (9, "z" * 40)]
    check(spark, rows, length=40, gram=12)


@pytest.mark.parametrize("seed", range(4))
def test_pieces_shorter_than_the_length_are_not_repeats(spark, seed):
    """Triggers recur everywhere, strings of the length hardly anywhere."""
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(16, 39))) for _ in range(40)]
    rows = [(d, "".join(rng.choice(pieces) for _ in range(rng.randrange(2, 60)))) for d in range(40)]
    check(spark, rows, length=40, gram=12)
    check(spark, rows, length=90, gram=16)


def test_production_length_with_repeated_ids_and_rows(spark):
    rows = corpus(2, 30, "abcdé ", 4, (300, 900))
    check(spark, [*rows, *rows[:3], (0, "other text"), (None, "n" * 900)])


def test_query(spark, sf):
    from tessera.llm.queries import op8_repeats

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], plain([r.text for r in docs], 400), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op8_repeats(spark, sf).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 0


def test_query_equals_its_sql(spark, sf):
    from tessera.llm.queries import ORACLES, op8_repeats
    from tests.oracle import compare, connection

    assert compare(connection(sf), op8_repeats(spark, sf), ORACLES["op8_repeats"]) == ""


def test_hard_rows(spark):
    docs = hard(spark)
    want = dict(zip([r.doc_id for r in docs.collect()], plain([r.text for r in docs.collect()], 400), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removed_repeats(docs).collect()}
    assert got == want
    assert repeats.removed_repeats(empty(spark)).count() == 0


@given(st.binary(min_size=0, max_size=80))
@settings(max_examples=100, deadline=None)
def test_every_string_has_one_trigger_by_content(tail):
    import numpy as np

    a = b"0123456789abcdefghijklmnopqrstuvwxyz" * 2
    one, two = a + tail, tail + a
    data = np.frombuffer(one + two, np.uint8)
    off = np.array([0, len(one), len(one) + len(two)])
    at, first, last, h = repeats.triggers(data, off, 30, 8, repeats._Powers())
    owner = {}
    for p, i, j in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
        for s in range(i, j + 1):
            assert s not in owner and 0 <= p - s <= 22
            owner[s] = p - s
    strings = [s for d in range(2) for s in range(off[d], off[d + 1] - 29)]
    assert sorted(owner) == strings
    by = {}
    for s in strings:
        assert by.setdefault(data[s : s + 30].tobytes(), owner[s]) == owner[s]


def plain_runs(texts, n):
    """[(runs, words in them)] of the words covered by runs of n words met twice."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        inside = bytearray(len(w))
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                inside[i : i + n] = b"\1" * n
        out.append((sum(1 for i, g in enumerate(inside) if g and not (i and inside[i - 1])), sum(inside)))
    return out


@pytest.mark.parametrize("words", [1, 3, 16, 20, 51])
def test_runs_of_words_equal_brute_force(spark, words):
    """Runs shorter than a block and longer, with one word changed, periodic, at both ends, and in any white space."""
    rng = random.Random(words)
    pieces = [[rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 2 * words + 9))] for _ in range(6)]
    texts = [None, "", " \t ", "a " * 3 * words, "a " * words, "b", "c"]
    for d in range(40):
        got = [w for _ in range(rng.randrange(1, 4)) for w in (rng.choice(pieces) if rng.random() < 0.7 else [f"{d}x{i}" for i in range(rng.randrange(9))])]
        if got and rng.random() < 0.5:
            got[rng.randrange(len(got))] = f"only{d}"
        texts.append("".join(w + rng.choice([" ", "  ", "\n"]) for w in got))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = dict(enumerate(plain_runs(texts, words)))
    assert {r.doc_id: (r.n_word_runs, r.n_run_words) for r in repeats.removed_word_runs(docs, words=words).collect()} == want


def test_query_reports_passages_of_over_50_words(spark, sf):
    from tessera.llm.queries import op8_repeats

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: (r.n_word_runs, r.n_run_words) for r in op8_repeats(spark, sf).collect()}
    assert got == dict(zip([r.doc_id for r in docs], plain_runs([r.text for r in docs], 51), strict=True)) and any(a for a, _ in got.values())


def test_hot_phrases_are_joined_by_broadcast_with_the_same_result(spark, monkeypatch):
    from tessera.operators import joins

    monkeypatch.setattr(joins, "MANY_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_KEYS", 8)
    rows = [(d, f"{d} " * 30 + "the same line of text again and again " * 3 + "q" * (d % 3)) for d in range(60)]
    check(spark, rows, length=40, gram=12)
