"""Sharding, mixing and packing against brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import mixing, packing, queries, sharding
from tests.llm.cases import empty, hard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_sharding_query(spark, sf):
    docs = docs_of(spark, sf)
    rows = queries.op3_sharding(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by = defaultdict(list)
    for r in rows:
        data = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 24)
        by[r.shard].append(r)
    assert set(by) <= set(range(24))
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    again = {r.doc_id: (r.shard, r.slot) for r in queries.op3_sharding(spark, sf).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_sharding_small_buckets_and_hard_rows(spark):
    docs = hard(spark).union(hard(spark))
    rows = sharding.shuffled_shards(docs, shards=3, bucket_bytes=1000).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    clash = sharding.shuffled_shards(hard(spark).withColumnsRenamed({"_id": "_bucket", "_size": "_in", "word": "_base"}), shards=3)
    assert {"_bucket", "_in", "_base"} <= set(clash.columns) and {r._in for r in clash.collect()} == {1}
    assert len(rows) == 20 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shuffled_shards(empty(spark)).count() == 0


def test_sharding_moves_whole_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for more buckets than may be broadcast
    try:
        placed = sharding.shuffled_shards(hard(spark).select("doc_id", "text"), shards=3, bucket_bytes=1000)
        todo, moves = [placed._jdf.queryExecution().executedPlan().initialPlan()], 0
        while todo:
            node = todo.pop()
            moves += node.nodeName().endswith("Exchange") and "text#" in node.output().mkString(",")
            todo += [node.children().apply(i) for i in range(node.children().size())]
        assert moves == 1 and placed.count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shards_written_in_slot_order(spark, tmp_path):
    sharding.write_shards(hard(spark).select("doc_id", "text"), str(tmp_path / "out"), shards=2, bucket_bytes=4000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def filled(sizes: dict, weights=(3, 1, 2), budget=1.5, cap=2.0):
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    left, open_, out = budget * sum(sizes.values()), set(keys), {}
    while open_:
        level = left / sum(w[k] for k in open_)
        over = {k for k in open_ if level * w[k] > cap * sizes[k]}
        if not over:
            return out | {k: level * w[k] for k in open_}
        for k in over:
            out[k] = cap * sizes[k]
            left -= out[k]
        open_ -= over
    return out


def check_mix(docs, rows):
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += size(text)
    target = filled({s: sizes[s] for s in {d[2] for d in docs}})
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((d[0], size(d[1])) for d in docs)
    source = {d[0]: d[2] for d in docs}
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(1, 0.01 * t), (s, taken[s], t)


def test_mixing_query(spark, sf):
    rows = queries.op6_mixing(spark, sf).collect()
    check_mix([(r.doc_id, r.text, r.source) for r in docs_of(spark, sf).values()], rows)
    assert sorted(map(tuple, queries.op6_mixing(spark, sf).collect())) == sorted(map(tuple, rows))


def test_mixing_query_equals_its_sql(spark, sf):
    from tests.oracle import compare, connection

    assert compare(connection(sf), queries.op6_mixing(spark, sf), queries.ORACLES["op6_mixing"]) == ""


def test_mixing_hard_rows(spark):
    check_mix([(r.doc_id, r.text, r.source) for r in hard(spark).collect()], mixing.mixed_documents(hard(spark)).collect())
    assert mixing.mixed_documents(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "a b c", None)], "doc_id long, text string, source string")
    assert mixing.mixed_documents(one).collect()[0].taken == 4 or mixing.mixed_documents(one).collect()[0].taken == 5


def test_mixed_rows_hold_what_is_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.mixed_documents(docs).collect()}
    got = Counter()
    for r in mixing.mixed_rows(docs).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert got == Counter({k: v for k, v in taken.items() if v})


def test_schedule_spreads_sources(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sized = mixing.sized_documents(docs, "doc_id", "text", "source", 1)
    targets = mixing.source_targets(sized)
    quota = {r._key: r.quota for r in targets.collect()}
    slots = sorted(mixing.slot_schedule(targets).collect(), key=lambda r: r.slot)
    assert Counter(r._key for r in slots) == Counter(quota) and [r.slot for r in slots] == list(range(len(slots)))
    total, seen = sum(quota.values()), Counter()
    for i, r in enumerate(slots, 1):
        seen[r._key] += 1
        if i % 97 == 0:
            assert all(abs(seen[k] - i * q / total) < 12 for k, q in quota.items())


def test_the_golden_sequence_decides_the_order(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = {r.doc_id: r.first_slot for r in mixing.mixed_documents(docs).collect()}
    rows = mixing.mixed_rows(docs).collect()
    place = {}
    for i, r in enumerate(rows):
        place.setdefault(r.doc_id, i)
    assert set(place) == {d for d, s in first.items() if s is not None}
    in_order = sorted(place, key=place.get)
    assert [first[d] for d in in_order] == sorted(first[d] for d in in_order)
    source = {r.doc_id: r.source for r in docs.collect()}
    assert len({source[r.doc_id] for r in rows[:60]}) > 10
    monkeypatch.setattr(mixing, "golden_multiplier", lambda n: 1)
    other = {r.doc_id: r.first_slot for r in mixing.mixed_documents(docs).collect()}
    assert other != first


def test_golden_multiplier_has_no_common_factor():
    from math import gcd

    for n in [1, 2, 3, 30030, 510510, 9699690, 2**31 - 1, 2**31]:
        g = mixing.golden_multiplier(n)
        assert gcd(g, n) == 1 and g * n < 2**63


def check_pieces(texts, rows, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 2] for d, x in texts.items()}
    by, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(by) == set(ids)
    for d, rs in by.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d]) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    for rs in windows.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    return sum(len(v) for v in ids.values()) / (4096 * len(windows))


def test_packing_query(spark, sf):
    texts = {r.doc_id: r.text for r in docs_of(spark, sf).values()}
    fill = check_pieces(texts, queries.op10_packing(spark, sf).collect(), queries.tokenizer_path())
    assert fill > 0.95


def test_packing_hard_rows_over_partitions(spark):
    docs = hard(spark)
    rows = packing.packed_pieces(docs.repartition(7), queries.tokenizer_path(), merged_partitions=3, open_windows=2).collect()
    check_pieces({r.doc_id: r.text for r in docs.collect()}, rows, queries.tokenizer_path())
    assert packing.packed_pieces(empty(spark), queries.tokenizer_path()).count() == 0


def test_packer_keeps_a_fixed_number_of_windows():
    p = packing.Packer(10, 2)
    done = [w for n in (6, 7, 8, 9, 4, 3) for w in p.place(n, n)]
    assert len(p.open) <= 2 and sorted(x for w in [*done, *p.rest()] for x in w) == [3, 4, 6, 7, 8, 9]


def test_word_tokenizer_small_table_and_odd_runs(spark, monkeypatch):
    """Tables that overflow, runs with apostrophes, marks, digits and special tokens."""
    import pyarrow as pa

    from tessera.llm.arrow import chunks

    monkeypatch.setattr(packing, "TABLE_SLOTS", 64)
    monkeypatch.setattr(packing, "POOL_IDS", 300)
    monkeypatch.setattr(packing, "POOL_BYTES", 900)
    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    t = packing.WordTokenizer(queries.tokenizer_path())
    rng = np.random.default_rng(3)
    parts = ["it's", "l'été!!", "ét", "A1b2", "<|endoftext|>", "x<|endoftext|>$", "中文", "Groß$$$", " ", " z", "''", "word", "...", "a" * 300, "İ", "İ"]
    for _ in range(40):
        texts = ["".join(rng.choice([*parts, " ", "\n", "\t"], rng.integers(0, 60))) for _ in range(5)]
        for _, _, data, off in chunks(pa.array(texts), 400):
            ids, stops = t.packed(data, off)
            raw = data.tobytes()
            for k in range(len(off) - 1):
                want = t.tokenizer.encode(raw[off[k] : off[k + 1]].decode(), add_special_tokens=False).ids
                assert ids[stops[k] : stops[k + 1]].tolist() == want


def thue_morse(bits):
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_runs_that_share_a_hash_get_their_own_ids(spark):
    """A Thue-Morse word and its complement collide under any polynomial modulo 2^64, new and known ones alike."""
    one = thue_morse(11)
    two = one.translate(str.maketrans("ab", "ba"))
    t = packing.WordTokenizer(queries.tokenizer_path())
    for texts in ([one, two, "x " + one], [two, one + " y", two], [f"{two} {one} {two}"]):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        off = np.cumsum([0, *map(len, texts)])
        start, _, h, _ = t._runs(data, off)
        assert len(set(h.tolist())) < len({x for text in texts for x in text.split()})
        ids, stops = t.packed(data, off)
        for k, text in enumerate(texts):
            assert ids[stops[k] : stops[k + 1]].tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_of_letters_are_encoded_once_whatever_follows_them(spark, monkeypatch):
    class Counting:
        def __init__(self, inner):
            self.inner, self.seen = inner, Counter()

        def encode_batch_fast(self, texts, **kw):
            self.seen.update(w for t in texts for w in t.split())
            return self.inner.encode_batch_fast(texts, **kw)

    monkeypatch.setattr(packing, "CACHED_WORDS", 10)
    t = packing.WordTokenizer(queries.tokenizer_path())
    plain, t.tokenizer = t.tokenizer, Counting(t.tokenizer)
    rng = np.random.default_rng(8)
    cores = ["".join(rng.choice([*"abcdeéß"], 7)) for _ in range(300)]
    for tail in ("", ",", "!!", "", "·", "'s", "'", ")("):
        texts = [c + tail for c in cores] + ["× a×b ÷é é÷, ,a a,b .a. ", "end" + tail, tail + "begin"]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        off = np.cumsum([0, *(len(x.encode()) for x in texts)])
        ids, stops = t.packed(data, off)
        for k, text in enumerate(texts):
            assert ids[stops[k] : stops[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert {t.tokenizer.seen[c] for c in cores} == {1}
