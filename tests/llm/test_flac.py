from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import flac
from tests.llm.cases import empty, hard


def back(streams):
    parts, blocks = flac.decode(streams)
    for p, b in zip(parts, blocks, strict=True):
        assert [at for at, _ in b] == list(range(0, len(p), flac.BLOCK)) and sum(n for _, n in b) == len(p)
    return [(p.view(np.uint8) ^ np.uint8(0x80)).tobytes() for p in parts]


@given(st.lists(st.binary(max_size=300), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_round_trip(texts):
    payloads = [flac.padded(t) for t in texts]
    assert back(flac.encode(payloads)) == payloads
    assert flac.encode(payloads)[-1] == flac.encode(payloads[-1:])[0]


def test_all_subframe_kinds_and_long_unary_runs():
    rng = random.Random(3)
    wave = bytes(int(128 + 90 * np.sin(i / 9)) for i in range(5000))
    jump = b"a" * 900 + b"\xff" + b"a" * 900 + b"\x00" * 10
    noise = rng.randbytes(4000)
    payloads = [flac.padded(x) for x in (wave, jump, noise, b"", b"q" * 3000, b"ab" * 1500)]
    streams = flac.encode(payloads)
    assert back(streams) == payloads
    kinds = set()
    for s in streams:
        for _, off, _ in flac.read_metadata(s)[2]:
            kinds.add(s[flac._read_header(s, flac.read_metadata(s)[3] + off)[2]] >> 1)
    assert {0, 1} <= kinds and any(k >= 32 for k in kinds) and any(8 <= k <= 12 for k in kinds)
    assert len(streams[0]) < 0.5 * len(payloads[0])


def test_reads_without_seek_table():
    payload = flac.padded(b"some text " * 700)
    s = flac.encode([payload])[0]
    _, _, _, first = flac.read_metadata(s)
    bare = s[:4] + b"\x80" + s[5:42] + s[first:]
    assert back([bare]) == [payload]


def test_damage_is_found():
    s = flac.encode([flac.padded(b"some text " * 700)])[0]
    _, _, _, first = flac.read_metadata(s)
    for at in (first + 1, first + 4, first + 300, len(s) - 1):
        bad = s[:at] + bytes((s[at] ^ 0x10,)) + s[at + 1 :]
        with pytest.raises(ValueError):
            flac.decode([bad])


def test_fixed_and_partitioned_residuals():
    """A frame written by hand: fixed order 3, four Rice partitions."""
    x = [int(20 * np.sin(i / 5)) for i in range(64)]
    res = np.diff(np.array(x, np.int64), 3)
    bits = "".join(f"{v & 255:08b}" for v in x[:3]) + "00" + f"{2:04b}"
    at = 0
    for part in range(4):
        n, k = (13, 1) if part == 0 else (16, part)
        bits += f"{k:04b}"
        for r in res[at : at + n].tolist():
            u = r << 1 if r >= 0 else -2 * r - 1
            bits += "0" * (u >> k) + "1" + (f"{u & (1 << k) - 1:0{k}b}" if k else "")
        at += n
    bits = f"{(8 + 3) << 1:08b}" + bits
    bits += "0" * (-len(bits) % 8)
    frame = flac.frame_header(0, 64) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    whole = np.frombuffer(frame, np.uint8)
    crc = int(flac.crc16(whole, np.array([0]), np.array([len(whole)]))[0])
    samples, size, _ = flac.decode_frames(frame + crc.to_bytes(2, "big"), np.array([0]))
    assert samples.tolist() == x and size.tolist() == [64]


def check(rows, docs):
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        text = (docs[r.doc_id] or "").encode()
        payload = text + b"\0" * (-len(text) % 64 or (0 if text else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.feature


def test_query(spark, sf):
    from tessera.llm.queries import op4_flac

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(op4_flac(spark, sf).collect(), docs)


def test_hard_rows(spark):
    docs = hard(spark)
    stored = flac.stored_media(docs)
    check(flac.media_digests(stored).collect(), {r.doc_id: r.text for r in docs.collect()})
    blocks = flac.pcm_blocks(stored.filter("doc_id = 5")).collect()
    pcm = b"".join(bytes(b.pcm) for b in sorted(blocks, key=lambda b: b.sample_offset))
    assert bytes(x ^ 0x80 for x in pcm).rstrip(b"\0").decode() == docs.filter("doc_id = 5").first().text
    assert flac.media_digests(flac.stored_media(empty(spark))).count() == 0
