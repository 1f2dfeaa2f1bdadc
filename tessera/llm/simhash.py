"""SimHash near-duplicates, linked by the generalised pigeonhole principle.

Texts get a 64-bit SimHash over word shingles.  Two fingerprints within ``radius``
differing bits agree, in at least one part of a partition of the 64 bits, up to
that part's own threshold, whenever the thresholds sum to radius - parts + 1.
Correlated bits share a part, and a dynamic program gives each part the threshold
that makes the estimated work least; the number of parts is the one whose plan costs
least for the number of fingerprints at hand.  Every fingerprint is filed once per part
and probes that part's buckets within its threshold; members of a bucket are verified
bit by bit, and what leaves a bucket is each of its components as a star around its
smallest node, which is mostly the same star from bucket to bucket.  A bucket with many
filed fingerprints is dealt to several tasks, each with some of these and all of its
rows, which pass by in batches.

Equal fingerprints are one node from the start, so exact copies cost nothing here.

Where a ``similarity`` is given, bits only propose: the texts of each proposed group
are compared by the Jaccard similarity of their whole sets of distinct shingles (as
64-bit hashes), and only pairs that reach it are links.  A pair is left out only where
both already hang together by such links.

Null, empty and blank texts have fingerprint 0 and are linked like any other; texts
with fewer words than a shingle hash as one.  Repeated rows share a component, an
empty table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from tessera.llm.arrow import returned_after, text_parts
from tessera.operators.graph import connected_components
from tessera.operators.joins import join_with_hot_keys
from tessera.sources.shared import written

BITS = 64
RADIUS = 4
#: Numbers of parts to choose from, and the work of a probe in comparisons of two fingerprints.
PARTS = range(2, 13)
PROBE_WORK = 100
SHINGLE = 4
SEED = 42
PAIRS_AT_ONCE = 1 << 20
SMALL_BUCKET = 64
STARS_AT_ONCE = 1 << 18
#: Filed fingerprints of a bucket, or texts of a proposed group, that one task compares with the others.
BLOCK_NODES = 4096
#: Shingles of a proposed group's texts that one task compares; larger groups go to a task per pair of blocks.
BLOCK_SHINGLES = 1 << 20
#: Rows of a bucket that are held at once.
HELD_ROWS = 1 << 16

#: Columns of a fingerprint that describe the text's set of shingles.
SETS = ["shingles", "set_size", "text_hash"]

_LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Odd multipliers that turn one shingle hash into further, independent ones.
_FURTHER = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> bytes:
    """XXH64 of the shingles one after another, big-endian; A-Z folded, words between ASCII white space."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return b""
    line = b" ".join(words)
    if n <= shingle:
        return xxh64_digest(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return b"".join([xxh64_digest(line[i:j], SEED) for i, j in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)])


def _majority(hashes: bytes) -> int:
    n = len(hashes) // 8
    lanes = np.frombuffer(hashes, np.uint8).reshape(n, 8) + _LANES
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits((counts.ravel() * 2 > n).astype(np.uint8)).tobytes(), "big")


def simhash(text: bytes, shingle: int = SHINGLE, words: int = 1) -> list[int]:
    """Unsigned 64-bit fingerprints of one UTF-8 text: its SimHash, and ``words`` - 1 further ones."""
    return _words_of(shingle_hashes(text, shingle), words)


def shingle_set(hashes: bytes) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(np.frombuffer(hashes, np.uint64))


def _words_of(hashes: bytes, words: int) -> list[int]:
    if not hashes:
        return [0] * words
    out = [_majority(hashes)]
    h = np.frombuffer(hashes, ">u8").astype(np.uint64)
    for k in range(words - 1):
        x = h * np.uint64(_FURTHER[k])
        x = (x ^ (x >> np.uint64(31))) * np.uint64(_FURTHER[k])
        out.append(_majority((x ^ (x >> np.uint64(29))).astype(">u8").tobytes()))
    return out


def _columns(words: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, words))]


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int, words: int, sets: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_parts(batch.column(1))
        raw = data.tobytes()
        found, names, sizes = [], [], []
        for i, j in itertools.pairwise(off.tolist()):
            hashes = shingle_hashes(raw[i:j], shingle)
            found.append(_words_of(hashes, words))
            if sets:
                own = shingle_set(hashes)
                names.append(xxh64_digest(own.tobytes(), SEED))
                sizes.append(len(own))
        out = np.array(found, np.uint64).reshape(-1, words)
        cols = [pa.array(np.ascontiguousarray(out[:, k]).view(np.int64)) for k in range(words)]
        if sets:
            cols += [pa.array(np.frombuffer(b"".join(names), np.int64)), pa.array(sizes, pa.int64()), batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *_columns(words), *(SETS if sets else [])])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, words: int = 1, sets: bool = False) -> DataFrame:
    """(doc_id, fp...): the fingerprints of every whole text as signed longs.

    With ``sets`` also ``shingles``, a hash of the text's set of shingles, ``set_size``, and ``text_hash``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if sets:
        rows = rows.withColumn("text_hash", _text_hash("text"))
    schema = ", ".join(f"{c} long" for c in ["doc_id", *_columns(words), *(SETS if sets else [])])
    return rows.mapInArrow(lambda it: returned_after(_fingerprint_batches(it, shingle, words, sets)), schema)


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _bit_matrix(fp: np.ndarray) -> np.ndarray:
    """Rows of bits; bit b of the fingerprint is column b."""
    return ((fp[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS))
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for i in range(0, len(fp), 1 << 16):
            bits = _bit_matrix(fp[i : i + (1 << 16)])
            total += bits.T @ bits
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "n"])


def bit_statistics(nodes: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints with both bits set, over all fingerprints."""
    rows = nodes.select("fp").mapInArrow(_pair_counts, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r.i, r.j] = r.n
    return both


def correlated_parts(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal size; each takes the bits most correlated with it."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda b: (corr[b, list(free)].sum(), -b))]
        free -= set(group)
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def _within(parts_bits: list[int], p: np.ndarray) -> np.ndarray:
    """Chance that two fingerprints differ in at most t of the bits, for each t, bits taken apart."""
    dist = np.array([1.0])
    for b in parts_bits:
        d = 2 * p[b] * (1 - p[b])
        dist = np.convolve(dist, [1 - d, d])
    return np.cumsum(dist)


def allocate(groups: list[list[int]], both: np.ndarray, n: int, radius: int) -> tuple[float, list[int]]:
    """Estimated work, and thresholds (-1: part unused) that sum to radius - parts + 1 with the least of it."""
    p = both.diagonal() / max(n, 1)
    cost = []
    for g in groups:
        within = _within(g, p)
        probes = np.cumsum([comb(len(g), t) for t in range(radius + 1)])
        cost.append([0.0] + [PROBE_WORK * n * float(probes[t]) + n * n / 2 * float(within[min(t, len(g))]) for t in range(radius + 1)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, chosen) in best.items():
            for take in range(radius + 2 - used):
                new = (so_far + c[take], [*chosen, take - 1])
                if used + take not in nxt or new < nxt[used + take]:
                    nxt[used + take] = new
        best = nxt
    return best[radius + 1]


def cheapest_plan(both: np.ndarray, n: int, radius: int, parts: int | None) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds; without ``parts`` in the number that costs least (for no fingerprints, as for one)."""
    plans, n = [], max(n, 1)
    for k in [parts] if parts else [k for k in PARTS if k <= radius + 1]:
        groups = correlated_parts(both, n, k)
        work, thresholds = allocate(groups, both, n, radius)
        plans.append((work, k, groups, thresholds))
    _, _, groups, thresholds = min(plans)
    return groups, thresholds


def _own_keys(fp: np.ndarray, k: int, bits: list[int]) -> np.ndarray:
    """The bucket of part ``k`` in which each fingerprint is filed."""
    own = np.full(len(fp), k << 56, np.uint64)
    for at, b in enumerate(bits):
        own |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(at)
    return own


def _filed_keys(batches: Iterator[pa.RecordBatch], groups: list[list[int]], thresholds: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for k, (bits, t) in enumerate(zip(groups, thresholds, strict=True)):
            if t >= 0:
                yield pa.RecordBatch.from_arrays([pa.array(_own_keys(fp, k, bits).view(np.int64))], names=["key"])


def _file_and_probe(batches: Iterator[pa.RecordBatch], groups: list[list[int]], thresholds: list[int]) -> Iterator[pa.RecordBatch]:
    """(key, filed, node, fp...): where each fingerprint is filed, and the buckets it probes."""
    plans = []
    for k, (bits, t) in enumerate(zip(groups, thresholds, strict=True)):
        if t >= 0:
            flips = [sum(1 << b for b in c) for r in range(1, t + 1) for c in itertools.combinations(range(len(bits)), r)]
            plans.append((k, bits, np.array([0, *flips], np.uint64)))
    for batch in batches:
        names = ["key", "filed", *batch.schema.names]
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            fp = part.column(1).to_numpy().view(np.uint64)
            for k, bits, flips in plans:
                keys = _own_keys(fp, k, bits)[:, None] ^ flips[None, :]
                filed = np.zeros(keys.shape, bool)
                filed[:, 0] = True
                rest = [pa.array(np.repeat(c.to_numpy(), len(flips))) for c in part.columns]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(filed.ravel()), *rest], names=names)


def _near(fps: list[np.ndarray], u: np.ndarray, v: np.ndarray, radius: int, whole_radius: int | None) -> np.ndarray:
    """Which pairs (index arrays that broadcast) are links."""
    near = np.bitwise_count(fps[0][u] ^ fps[0][v]) <= radius
    if whole_radius is not None and near.any():
        at = np.nonzero(near)
        u, v = np.broadcast_to(u, near.shape)[at], np.broadcast_to(v, near.shape)[at]
        near[at] = sum(np.bitwise_count(f[u] ^ f[v]).astype(np.int64) for f in fps) <= whole_radius
    return near


def _settle(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Lets both ends of every link take the smaller label until nothing changes."""
    while len(u):
        low = np.minimum(label[u], label[v])
        changed = (label[u] != low) | (label[v] != low)
        if not changed.any():
            return
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)


def _join_filed(filed: int, lo: int, hi: int, fps: list[np.ndarray], label: np.ndarray, radius: int, whole_radius: int | None) -> None:
    """Labels of a large bucket: its filed rows against all its rows, in blocks."""
    everything = np.arange(lo, hi)
    if (label[lo:hi] == label[lo]).all():
        return
    step = max(1, PAIRS_AT_ONCE // (hi - lo))
    for i in range(lo, lo + filed, step):
        rows = np.arange(i, min(i + step, lo + filed))
        near = _near(fps, rows[:, None], everything[None, :], radius, whole_radius)
        for r in np.flatnonzero(near.sum(axis=1) > 1).tolist():
            mine = np.unique(label[lo + np.flatnonzero(near[r])])
            if len(mine) > 1:
                part = label[lo:hi]
                part[np.isin(part, mine)] = mine[0]
        if (label[lo:hi] == label[lo]).all():
            return


def _verify(columns: list[np.ndarray], radius: int, whole_radius: int | None) -> np.ndarray:
    """(node, smallest node it is joined to) within complete buckets; rows sorted by key, filed ones first."""
    key, filed, node, *fps = columns
    fps = [f.view(np.uint64) for f in fps]
    label = node.copy()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end = np.r_[first[1:], len(key)]
    size = end - first
    end_of = np.repeat(end, size)
    small = np.repeat(size <= SMALL_BUCKET, size)
    rows = np.flatnonzero(filed & small & (end_of - np.arange(len(key)) > 1))
    partners = end_of[rows] - rows - 1
    stops = np.cumsum(partners)
    at, found = 0, []
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        r, n = rows[at:to], partners[at:to]
        u = np.repeat(r, n)
        v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)
        open_pairs = node[u] != node[v]
        u, v = u[open_pairs], v[open_pairs]
        near = _near(fps, u, v, radius, whole_radius)
        found.append((u[near], v[near]))
        at = to
    if found:
        u, v = (np.concatenate(c) for c in zip(*found, strict=True))
        _settle(label, u, v)
    count = np.add.reduceat(filed.astype(np.int64), first)
    large = (size > SMALL_BUCKET) & (count > 0)
    for n, i, j in zip(count[large].tolist(), first[large].tolist(), end[large].tolist(), strict=True):
        _join_filed(n, i, j, fps, label, radius, whole_radius)
    moved = label != node
    return np.unique(np.column_stack([node[moved], label[moved]]), axis=0)


class _LargeBucket:
    """A bucket's filed fingerprints, with which its other rows are compared as they pass by."""

    def __init__(self, columns: list[np.ndarray], radius: int, whole_radius: int | None):
        _, filed, node, *fps = columns
        self.node, self.fps = node[filed], [f[filed].view(np.uint64) for f in fps]
        first, place = np.unique(self.node, return_index=True, return_inverse=True)[1:]
        self.label = first[place]
        self.limits = radius, whole_radius
        self.apart = len(first) > 1

    def links(self, columns: list[np.ndarray]) -> np.ndarray:
        """(node, a filed node near it) for the rows that have one."""
        _, _, node, *fps = columns
        m = len(self.node)
        if not m or not len(node):
            return np.zeros((0, 2), np.int64)
        both = [np.r_[f, g.view(np.uint64)] for f, g in zip(self.fps, fps, strict=True)]
        out = []
        step = max(1, PAIRS_AT_ONCE // m)
        for i in range(0, len(node), step):
            rows = np.arange(m + i, m + min(i + step, len(node)))
            near = _near(both, np.arange(m)[:, None], rows[None, :], *self.limits)
            hit = np.flatnonzero(near.any(axis=0))
            out.append(np.column_stack([node[rows[hit] - m], self.node[near[:, hit].argmax(axis=0)]]))
            for k in hit[near[:, hit].sum(axis=0) > 1].tolist() if self.apart else ():
                mine = np.unique(self.label[near[:, k]])
                if len(mine) > 1:
                    self.label[np.isin(self.label, mine)] = mine[0]
            self.apart = bool((self.label != self.label[0]).any())
        return np.concatenate(out)

    def own(self) -> np.ndarray:
        return np.column_stack([self.node, self.node[self.label]])


def _verify_batches(batches: Iterator[pa.RecordBatch], radius: int, whole_radius: int | None) -> Iterator[pa.RecordBatch]:
    """Stars of the components of each bucket; a star that many buckets show goes out once per flush."""
    held: list[list[np.ndarray]] = []
    large: _LargeBucket | None = None
    large_key = None
    ready: list[np.ndarray] = []

    def flushed() -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(ready), axis=0)
        ready.clear()
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if large is not None:
            same = int(np.searchsorted(columns[0], large_key, "right"))
            ready.append(large.links([c[:same] for c in columns]))
            columns = [c[same:] for c in columns]
            if len(columns[0]):
                ready.append(large.own())
                large = None
        if len(columns[0]):
            key = columns[0]
            cut = int(np.searchsorted(key, key[-1]))
            if held and held[-1][0][-1] != key[0] or cut:
                done = [*held, [c[:cut] for c in columns]]
                done = [np.concatenate(c) for c in zip(*done, strict=True)]
                if len(done[0]):
                    ready.append(_verify(done, radius, whole_radius))
                held = []
            held.append([c[cut:] for c in columns])
            if sum(len(c[0]) for c in held) > HELD_ROWS and not held[-1][1][-1]:  # filed rows come first
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                large, large_key, held = _LargeBucket(rows, radius, whole_radius), rows[0][0], []
                ready.append(large.links(rows))
        if sum(map(len, ready)) > STARS_AT_ONCE:
            yield flushed()
    if large is not None:
        ready.append(large.own())
    if held:
        ready.append(_verify([np.concatenate(c) for c in zip(*held, strict=True)], radius, whole_radius))
    if ready:
        yield flushed()


def _found_in_buckets(nodes: DataFrame, groups: list[list[int]], thresholds: list[int], radius: int, whole_radius: int | None) -> DataFrame:
    """(a, b): links among nodes (node, fp...) that leave the components of all links within buckets whole; rows of one node hang together."""
    filed = nodes.select("fp").mapInArrow(lambda it: _filed_keys(it, groups, thresholds), "key long")
    heavy = written(filed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK_NODES), "heavy-buckets")
    fps = [c for c in nodes.columns if c.startswith("fp")]
    schema = "key long, filed boolean, node long, " + ", ".join(f"{c} long" for c in fps)
    probes = nodes.select("node", *fps).mapInArrow(lambda it: returned_after(_file_and_probe(it, groups, thresholds)), schema)
    if not heavy.isEmpty():
        tasks = F.ceil(F.col("n") / BLOCK_NODES).cast("int")
        probes = probes.join(heavy.select("key", tasks.alias("tasks")), "key", "left").withColumn("tasks", F.coalesce("tasks", F.lit(1)))
        probes = probes.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
        mine = F.col("filed") & (F.pmod(F.xxhash64(*fps), F.col("tasks")) == F.col("task"))
        probes = probes.select(F.when(F.col("tasks") == 1, F.col("key")).otherwise(F.xxhash64("key", "task")).alias("key"), mine.alias("filed"), "node", *fps)
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = probes.repartition(width, "key").sortWithinPartitions("key", F.col("filed").desc())
    return dealt.mapInArrow(lambda it: returned_after(_verify_batches(it, radius, whole_radius)), "a long, b long").distinct()


def links(nodes: DataFrame, radius: int = RADIUS, parts: int | None = None, whole_radius: int | None = None) -> DataFrame:
    """(a, b): links among nodes (node, fp...), by way of others, that leave their components whole.

    Nodes are linked when ``fp`` differs in at most ``radius`` bits and, if that is
    given, all fingerprints together in at most ``whole_radius``.  First nodes that share
    a bucket are linked.  Then fingerprints probe other buckets as members of the
    components so far: pairs within one need no comparison and no further links.
    """
    both = bit_statistics(nodes)
    groups, thresholds = cheapest_plan(both, nodes.count(), radius, parts)
    found = _found_in_buckets(nodes, groups, [min(t, 0) for t in thresholds], radius, whole_radius)
    if max(thresholds) <= 0:
        return found
    found = written(found, "links")
    groups_so_far = connected_components(found, "a", "b").withColumnRenamed("node", "linked")
    fps = [c for c in nodes.columns if c.startswith("fp")]
    members = nodes.join(groups_so_far, nodes["node"] == groups_so_far["linked"], "left").select(F.coalesce("component", "node").alias("node"), *fps)
    return found.unionByName(_found_in_buckets(written(members, "members"), groups, thresholds, radius, whole_radius))


def _similar(node: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """(node, node) links that leave whole the components of all pairs with that Jaccard similarity."""
    m = len(node)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    tokens = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owners = np.repeat(np.arange(m), sizes)[np.argsort(tokens, kind="stable")]
    count = np.bincount(tokens)
    first = np.cumsum(count) - count
    label = np.arange(m)
    for i in range(m - 1):
        near = np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-6
        rest = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & near[i + 1 :])
        if not len(rest):
            continue
        mine = tokens[ends[i] - sizes[i] : ends[i]]
        n = count[mine]
        at = np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owners[at], minlength=m)[rest]
        hits = rest[both / np.maximum(sizes[i] + sizes[rest] - both, 1) >= similarity]
        if len(hits):
            joined = np.unique(label[np.r_[i, hits]])
            label[np.isin(label, joined)] = joined[0]
    moved = np.flatnonzero(node != node[label])
    return np.column_stack([node[moved], node[label[moved]]])


def _similar_batches(batches: Iterator[pa.RecordBatch], similarity: float, shingle: int) -> Iterator[pa.RecordBatch]:
    """Links within runs of rows (key, node, text) of one key, which may go over several batches."""
    key, nodes, sets, out = None, [], [], []

    def flushed() -> pa.RecordBatch:
        pairs = np.concatenate(out)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        for k, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if k != key:
                if len(nodes) > 1:
                    out.append(_similar(np.array(nodes), sets, similarity))
                key, nodes, sets = k, [], []
            nodes.append(node)
            sets.append(shingle_set(shingle_hashes((text.as_py() or "").encode(), shingle)))
        if out:
            yield flushed()
    if len(nodes) > 1:
        out.append(_similar(np.array(nodes), sets, similarity))
        yield flushed()


def similar_links(docs: DataFrame, members: DataFrame, similarity: float, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): links by exact similarity within the components of members (node, component, set_size, doc_id, text_hash).

    A component above BLOCK_NODES nodes or BLOCK_SHINGLES shingles is dealt in blocks, each pair of blocks to a task.
    """
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("set_size") / BLOCK_SHINGLES)).cast("int")
    large = written(members.groupBy("component").agg(blocks.alias("blocks")).filter("blocks > 1"), "large-groups")
    dealt = members.join(large, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), _text_hash(text_col).alias("_hash"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(dealt, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = found.select(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "node", "text")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = keyed.repartition(width, "key").sortWithinPartitions("key")
    return runs.mapInArrow(lambda it: returned_after(_similar_batches(it, similarity, shingle)), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, parts: int | None = None, words: int = 1, whole_radius: int | None = None, searched: int = 1, similarity: float | None = None
) -> DataFrame:
    """(doc_id, fp..., component_id): the smallest doc_id that a document reaches over links.

    Links join distinct fingerprints, documents only look up theirs, so the work
    follows the number of different texts, not the square of a group of copies.
    With several ``words``, candidates come from the first ``searched`` of them and
    ``whole_radius`` bounds the differing bits of all, a closer estimate of
    similarity.  With ``similarity`` these links only propose groups, in which whole
    texts are compared.
    """
    fps = _columns(words)
    exact = similarity is not None
    keys = [*fps, "shingles"] if exact else fps
    prints = written(fingerprints(docs, id_col, text_col, shingle, words, exact), "simhash")
    node = F.col("fp") if keys == ["fp"] else F.xxhash64(*keys)
    sample = [F.min(F.struct("doc_id", "text_hash")).alias("sample"), F.max("set_size").alias("set_size")] if exact else []
    nodes = written(prints.groupBy(*keys).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), *sample).withColumn("node", node), "simhash-nodes")
    found = None
    for k in range(searched):
        turned = nodes.select("node", *[F.col(c).alias(name) for c, name in zip([fps[k], *fps[:k], *fps[k + 1 :]], fps, strict=True)])
        linked = links(turned, radius, parts, whole_radius)
        linked = written(linked, "links") if searched > 1 else linked
        found = linked if found is None else found.unionByName(linked)
    groups = connected_components(found, "a", "b")
    if exact:
        members = nodes.join(groups.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"))
        members = written(members.select("node", "component", "set_size", "sample.doc_id", "sample.text_hash"), "proposed")
        groups = connected_components(written(similar_links(docs, members, similarity, shingle, id_col, text_col), "links"), "a", "b")
    groups = groups.withColumnRenamed("node", "linked")
    named = nodes.join(groups, nodes["node"] == groups["linked"], "left").select(*keys, "first_id", "copies", F.coalesce("component", "node").alias("component"))
    named = written(named, "named")
    lowest = written(named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")), "lowest")
    lookup = join_with_hot_keys(named, lowest, ["component"], "members", named.count()).select(*keys, "component_id", "copies")
    found = join_with_hot_keys(prints, written(lookup, "lookup"), keys, "copies", prints.count())
    return found.select("doc_id", *fps, "component_id")


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id.

    Rows that repeat that id and text leave one row; rows without id stay once per
    text where their group has no id at all.  Column names that start with
    ``__tessera`` are reserved.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__tessera_id")).distinct()
    joined = docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__tessera_id")), "left_semi")
    return joined.dropDuplicates([id_col, text_col])
