"""Document fingerprints by locally consistent parsing.

Runs of equal symbols become one symbol.  Deterministic coin tossing then turns
every symbol into a label from {0..5} by the lowest bit in which it differs from
its left neighbour, a few times over; local maxima of the labels start phrases of
2 to 12 symbols.  A phrase's name is a hash of its symbols' names, and the names
are the symbols of the next level.  A cut depends on a bounded neighbourhood only,
so equal substrings get the same names inside, wherever they stand.

A fingerprint is a min-hash of the names of three levels: short, middle and long
phrases.  Likeness is the share of equal positions.  Null and empty texts have one
fingerprint of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Level: positions of the fingerprint that hold min-hashes of that level's names.
LEVELS = {2: 16, 3: 24, 4: 24}
SLOTS = sum(LEVELS.values())
CHUNK_BYTES = 1 << 20
U = np.uint64

_rng = np.random.default_rng(11)
_MULTIPLY = _rng.integers(1, 2**63, SLOTS, np.uint64) * U(2) + U(1)
_ADD = _rng.integers(0, 2**63, SLOTS, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (multiply and xor-shift), one to one."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def _labels(sym: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Coin tossing until labels are below 6; neighbours in a document always differ."""
    x = sym
    for _ in range(4):
        one = x.dtype.type(1)
        prev = np.empty_like(x)
        prev[1:] = x[:-1]
        prev[start] = x[start] ^ one
        differ = x ^ prev
        low = differ & (~differ + one)
        place = np.bitwise_count(low - one)
        x = (place << np.uint8(1)) | ((x & low) != 0)
    return x


def _runs(sym: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal symbols as one symbol each, and the documents' new starts."""
    head = np.empty(len(sym), bool)
    head[0] = True
    np.not_equal(sym[1:], sym[:-1], out=head[1:])
    head[start] = True
    at = np.flatnonzero(head)
    if len(at) == len(sym):
        return sym, start
    length = np.diff(np.r_[at, len(sym)])
    out = sym[at]
    many = length > 1
    out[many] = mix(out[many] + U(0x9E3779B97F4A7C15) * length[many].astype(U))
    return out, np.searchsorted(at, start)


def next_level(sym: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each document; documents of one symbol keep it."""
    sym, start = _runs(sym, start)
    n = len(sym)
    lab = _labels(sym, start)
    cut = np.zeros(n, bool)
    cut[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:])
    last = np.r_[start[1:], n] - 1
    second = start + 1
    cut[last] = False
    cut[second[second < n]] = False
    cut[start] = True
    at = np.flatnonzero(cut)
    length = np.diff(np.r_[at, n])
    place = np.arange(n) - np.repeat(at, length)
    name = mix(np.add.reduceat(mix(sym + place.astype(U) * U(0xE7037ED1A0B428DB)), at) + length.astype(U))
    alone = length == 1
    name[alone] = sym[at[alone]]
    return name, np.searchsorted(at, start)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """(texts x SLOTS) uint16 fingerprints; empty texts have all zeros."""
    out = np.zeros((len(texts), SLOTS), np.uint16)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    data = np.frombuffer(b"".join([texts[i] for i in full]), np.uint8)
    sizes = np.array([len(texts[i]) for i in full])
    start = np.cumsum(sizes) - sizes
    sym = data.astype(U) + U(1)
    slot = 0
    for level in range(1, max(LEVELS) + 1):
        sym, start = next_level(sym, start)
        for _ in range(LEVELS.get(level, 0)):
            least = np.minimum.reduceat(sym * _MULTIPLY[slot] + _ADD[slot], start)
            out[full, slot] = (mix(least) >> U(48)).astype(np.uint16) | np.uint16(1)
            slot += 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _bucket_of(bounds: np.ndarray):
    """Bucket of an id among descending runs, doubled, plus 1 for the first id of a run."""

    @F.pandas_udf("long")
    def bucket(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        at = np.full(len(ids), len(bounds) - 1, np.int64)
        top = np.zeros(len(ids), bool)
        if known.any():
            x = ids[known].to_numpy().astype(np.int64)
            up = np.searchsorted(bounds, x, "left")
            at[known] = len(bounds) - 1 - up
            top[known] = bounds[up] == x
        return pd.Series(at * 2 + top)

    return bucket


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with the one after it; rows come by bucket, guests last, in order."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def done(rows: list[tuple]) -> pa.RecordBatch:
        own = [r[2] for r in rows]
        edited = []
        for t, after in zip(own[:-1], own[1:], strict=True):
            k = len(t) // 3
            edited.append((t[: len(t) - k] + after[:k]).encode())
        prints = fingerprints([t.encode() for t in own])
        changed = fingerprints(edited)
        n = len(edited)
        hexed = lambda x: [r.astype(">u2").tobytes().hex() for r in x]
        cols = [
            pa.array([r[1] for r in rows[:-1]], pa.int64()),
            pa.array([len(t) for t in own[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            pa.array(hexed(prints[:n])),
            pa.array(hexed(changed)),
            pa.array(likeness(prints[:n], changed)),
            pa.array(likeness(prints[:n], prints[1:])),
        ]
        return pa.RecordBatch.from_arrays(cols, names=names)

    held: list[tuple] = []
    size, closed = 0, False
    for batch in batches:
        for bucket, guest, doc, text in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3), strict=True):
            if held and held[0][0] != bucket:
                held, size, closed = [], 0, False
            if closed:
                continue
            text = text.as_py() or ""
            held.append((bucket, doc, text))
            size += len(text)
            closed = bool(guest)
            if len(held) > 1 and (closed or size >= CHUNK_BYTES):
                yield done(held)
                held, size = held[-1:], len(text)


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form (its end replaced by the
    beginning of the next document's, in descending id order, the first after the last).

    Ids are cut into runs at quantiles; a document that starts a run also goes to
    the run before it as a guest, so each run finds every successor and the texts
    move once.  Rows with one id stand in the order of their texts, null ids last.
    """
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 4 * width
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    row = rows.agg(F.max("doc_id"), F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], F.lit(10_000))).first()
    bounds = np.array(sorted({row[0], *(row[1] or [])} - {None}) or [0], np.int64)
    last = len(bounds) - 1
    code = rows.withColumn("code", _bucket_of(bounds)(F.col("doc_id")))
    own = F.floor(F.col("code") / 2).cast("int")
    before = F.when(own > 0, own - 1).otherwise(F.lit(last))
    first = (F.col("code") % 2 == 1) if row[0] is not None else F.lit(True)
    place = lambda b, g: F.struct(b.alias("bucket"), F.lit(g).alias("guest"))
    placed = code.withColumn("at", F.explode(F.when(first, F.array(place(own, 0), place(before, 1))).otherwise(F.array(place(own, 0)))))
    dealt = placed.select("at.bucket", "at.guest", "doc_id", "text").repartition(width, "bucket")
    dealt = dealt.sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
