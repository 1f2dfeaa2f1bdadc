"""Bounded-space online packing of tokenized documents into fixed-length sequences.

Each input partition is one online packer with a fixed number of open windows.  A
document is cut into pieces of at most the window length; a piece goes to the open
window it fills best, and when it fits none, the fullest window is emitted.  What
is still open at the end is merged by the same rule: windows of neighbouring
partitions meet in one small task, are poured into each other largest first, and
only pieces' descriptions travel, never token ids.

Null text is empty: such a document is its end token alone.  Repeated rows are
packed like any others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import string
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import chunks, memory_returned
from tessera.sources.shared import written

WINDOW = 4096
OPEN_WINDOWS = 48
MERGED_PARTITIONS = 16
CACHED_WORDS = 60_000
TABLE_SLOTS = 1 << 19
POOL_IDS = 6 << 20
POOL_BYTES = 12 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
TOKENIZED_BYTES = 1 << 18

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
OPEN = PIECES.replace("offset long", "offset long, open boolean, merge_group long")


def _bytes_of(characters: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters.encode())] = True
    return found


LETTERS = _bytes_of(string.ascii_letters)
TAILS = _bytes_of(string.punctuation.replace("'", ""))


def _latin(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters from A to z or À to ÿ."""
    found = LETTERS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    after = data[lead + 1]
    lead = lead[(after != 0x97) & (after != 0xB7)]  # × and ÷
    found[lead] = found[lead + 1] = True
    return found


class WordTokenizer:
    """Whole-text ids of a tokenizer whose words never span white space.

    The vocabulary's normalizer and pre-tokenizer act within runs of non-space
    characters, so ids of a text are the ids of its runs one after another.  A run
    of Latin letters with trailing punctuation is two words, each with ids of its own,
    and is cut in two; all other runs stay whole.  Words are found and hashed (64 bits)
    as arrays and looked up in a two-way table of fixed size; what is found counts only
    if its bytes are the word's, as different words may share a hash.  Unknown words of
    letters are encoded together and their ids told apart by the tokens that end a
    word.  Only other words become strings; they are encoded one by one and kept in two
    generations of bounded size.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}
        self.power = self.inverse = np.zeros(0, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros((2, TABLE_SLOTS), np.uint64)
        self.at = np.zeros((2, TABLE_SLOTS), np.int32)
        self.count = np.zeros((2, TABLE_SLOTS), np.int32)
        self.bytes_at = np.zeros((2, TABLE_SLOTS), np.int32)
        self.bytes_count = np.zeros((2, TABLE_SLOTS), np.int32)
        self.pool, self.used = np.zeros(POOL_IDS, "<u4"), 0
        self.letters, self.used_bytes = np.zeros(POOL_BYTES, np.uint8), 0

    def _runs(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of every word within a text, and the words' bytes one after another."""
        word = ~((data == 32) | ((data >= 9) & (data <= 13)))
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        opens[cut] = word[cut]
        closes[cut - 1] = word[cut - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        letter, tail = _latin(data), TAILS[data]
        whole = word & ~(letter | tail)  # bytes that keep their run from being cut
        whole |= opens & ~letter
        whole[1:] |= tail[:-1] & letter[1:] & ~opens[1:]
        seen = np.zeros(len(data) + 1, np.int32)
        np.cumsum(whole, out=seen[1:])
        inner = np.flatnonzero(letter[:-1] & tail[1:]) + 1
        run = np.searchsorted(start, inner, "right") - 1
        inner = inner[seen[start[run]] == seen[end[run]]]
        start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
        n = len(data) + 1
        if len(self.power) < n:
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)])
                self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(int(BASE), -1, 1 << 64), np.uint64)])
        sums = np.zeros(n, np.uint64)
        np.cumsum(data * self.power[: len(data)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return start, end, h | np.uint64(1), data[word]

    def _look_up(self, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Found or not, place and number of ids, place and number of bytes."""
        slot = (h >> np.uint64(20)).astype(np.int64) & (TABLE_SLOTS - 1)
        way = (self.keys[1][slot] == h).astype(np.int64)
        return self.keys[way, slot] == h, *(x[way, slot] for x in (self.at, self.count, self.bytes_at, self.bytes_count))

    def _others(self, own: np.ndarray, size: np.ndarray, bytes_at: np.ndarray, bytes_count: np.ndarray) -> np.ndarray:
        """Indexes of words whose bytes are not those of the entry with their hash."""
        stop = np.cumsum(size, dtype=np.int32)
        place = np.repeat(bytes_at - (stop - size).astype(np.int32), size)
        place += np.arange(len(own), dtype=np.int32)
        np.minimum(place, POOL_BYTES - 1, out=place)
        wrong = np.flatnonzero(self.letters[place] != own)
        return np.unique(np.r_[np.searchsorted(stop, wrong, "right"), np.flatnonzero(size != bytes_count)])

    def packed(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, one after another, and n+1 offsets into them."""
        start, end, h, own = self._runs(data, off)
        hit, at, count, bytes_at, bytes_count = self._look_up(h)
        miss = np.flatnonzero(~hit)
        pool = self.pool
        if len(miss):
            new, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
            starts, length = start[miss[first]], (end - start)[miss[first]]
            fresh, places, sizes, letters = self._ids_of(data, starts, length)
            if self.used + len(fresh) > POOL_IDS or self.used_bytes + len(letters) > POOL_BYTES:
                self._clear()
                if len(new) != len(np.unique(h)) or len(fresh) > POOL_IDS or len(letters) > POOL_BYTES:
                    return self._plain(data, off)
            pool = self.pool
            pool[self.used : self.used + len(fresh)] = fresh
            self.letters[self.used_bytes : self.used_bytes + len(letters)] = letters
            slot = (new >> np.uint64(20)).astype(np.int64) & (TABLE_SLOTS - 1)
            way = (self.keys[0][slot] != 0).astype(np.int64)
            entries = (self.used + places, sizes, self.used_bytes + np.cumsum(length) - length, length)
            self.keys[way, slot] = new
            for table, found, value in zip((self.at, self.count, self.bytes_at, self.bytes_count), (at, count, bytes_at, bytes_count), entries, strict=True):
                table[way, slot] = value
                found[miss] = value[which]
            self.used, self.used_bytes = self.used + len(fresh), self.used_bytes + len(letters)
        other = self._others(own, end - start, bytes_at, bytes_count)
        if len(other):
            ids, places, sizes, _ = self._ids_of(data, start[other], (end - start)[other])
            pool = np.concatenate([pool[: self.used], ids])
            at[other], count[other] = self.used + places, sizes
        total = np.cumsum(count) if len(count) else np.zeros(0, np.int64)
        ids = pool[np.repeat(at - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        stops = np.r_[0, total][np.searchsorted(start, off)]
        return ids, stops

    def _ids_of(self, data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ids of words, place and number of each word's, and the words' bytes one after another."""
        stop = np.cumsum(length)
        own = data[np.repeat(starts - (stop - length), length) + np.arange(stop[-1])]
        letter = np.logical_and.reduceat(_latin(own), stop - length)
        places, sizes = np.zeros((2, len(starts)), np.int64)
        ids = np.zeros(0, "<u4")
        if letter.any():
            n = int(letter.sum())
            size = length[letter]
            spaced = np.full(int(size.sum()) + n, 32, np.uint8)
            spaced[np.arange(len(spaced) - n) + np.repeat(np.arange(n), size)] = own[np.repeat(letter, length)]
            ids = np.array(self.tokenizer.encode_batch_fast([spaced.tobytes().decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == n and ends[-1] == len(ids):
                sizes[letter] = np.diff(ends, prepend=0)
                places[letter] = ends - sizes[letter]
            else:
                ids, letter = ids[:0], np.zeros(len(letter), bool)
        if not letter.all():
            rest, raw = np.flatnonzero(~letter), own.tobytes()
            found = self._each([raw[b - n : b].decode() for b, n in zip(stop[rest].tolist(), length[rest].tolist(), strict=True)])
            sizes[rest] = np.fromiter(map(len, found), np.int64, len(found))
            places[rest] = len(ids) + np.cumsum(sizes[rest]) - sizes[rest]
            ids = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(found), "<u4", int(sizes[rest].sum()))])
        return ids, places, sizes, own

    def _each(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, encoded by itself."""
        if len(self.known) > CACHED_WORDS:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        known.update({w: old[w] for w in words if w not in known and w in old})
        new = list({w for w in words if w not in known})
        known.update(zip(new, (e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return [known[w] for w in words]

    def _plain(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, text by text, for the chunk that finds the pool full."""
        raw, off = data.tobytes(), off.tolist()
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([raw[i:j].decode() for i, j in itertools.pairwise(off)], add_special_tokens=False)]
        return np.array(list(itertools.chain.from_iterable(ids)), "<u4"), np.cumsum([0, *map(len, ids)])


class Packer:
    """A fixed number of open windows; best fit, else the fullest goes."""

    def __init__(self, size: int, windows: int):
        self.size, self.windows = size, windows
        self.open: list[tuple[int, int]] = []  # (room, number), ascending
        self.content: dict[int, list] = {}
        self.number = 0

    def place(self, length: int, item) -> Iterator[list]:
        """Put an item; yields a window that is done."""
        i = bisect_left(self.open, (length, -1))
        if i == len(self.open):
            if len(self.open) >= self.windows:
                _, n = self.open.pop(0)
                yield self.content.pop(n)
            self.number += 1
            room, n = self.size, self.number
            self.content[n] = []
        else:
            room, n = self.open.pop(i)
        self.content[n].append(item)
        if room == length:
            yield self.content.pop(n)
        else:
            insort(self.open, (room - length, n))

    def rest(self) -> Iterator[list]:
        """The windows still open, fullest first."""
        for _, n in self.open:
            yield self.content[n]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


_NAMES = [c.split()[0] for c in OPEN.split(", ")]
_KINDS = [{"long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in OPEN.split(", ")]


def _pack_partition(batches: Iterator[pa.RecordBatch], tokenize: Callable[[], object], end_id: int, window: int, windows: int, merged: int) -> Iterator[pa.RecordBatch]:
    tokenizer, end = tokenize(), np.array([end_id], "<u4").tobytes()
    part = TaskContext.get().partitionId()
    packer, done, rows = Packer(window, windows), 0, []

    def finish(pieces: list, still_open: bool) -> None:
        nonlocal done
        at = 0
        for p in pieces:
            rows.append((*p, (part << 32) | done, at, still_open, part // merged))
            at += p[2]
        done += 1

    for batch in batches:
        for lo, hi, data, off in chunks(batch.column(1), TOKENIZED_BYTES):
            all_ids, stops = tokenizer.packed(data, off)
            raw, stops = all_ids.tobytes(), (stops * 4).tolist()
            for doc, (i, j) in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), itertools.pairwise(stops), strict=True):
                ids = raw[i:j] + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    for full in packer.place(len(piece) // 4, (doc, start, len(piece) // 4, zlib.crc32(piece), n)):
                        finish(full, False)
            if len(rows) >= 8192:
                yield _batch(rows, _NAMES, _KINDS)
                rows.clear()
    for left in packer.rest():
        finish(left, True)
    if rows:
        yield _batch(rows, _NAMES, _KINDS)
    del tokenizer
    memory_returned()


def _merge_windows(key, table: pa.Table, window: int) -> pa.Table:
    """Pour the open windows of one group into each other, fullest first, best fit."""
    group = key[0].as_py()
    bins: dict[int, list] = {}
    for row in zip(*[table.column(c).to_pylist() for c in _NAMES], strict=True):
        bins.setdefault(row[5], []).append(row)
    packer = Packer(window, len(bins) + 1)
    windows: list[list] = []
    for pieces in sorted(bins.values(), key=lambda b: (-sum(p[2] for p in b), b[0][5])):
        for full in packer.place(sum(p[2] for p in pieces), sorted(pieces, key=lambda p: p[6])):
            windows.append(full)
    windows += packer.rest()
    rows = []
    for n, content in enumerate(windows):
        at = 0
        for p in (p for pieces in content for p in pieces):
            rows.append((*p[:5], (1 << 62) | (group << 32) | n, at))
            at += p[2]
    return pa.Table.from_batches([_batch(rows, _NAMES[:7], _KINDS[:7])])


def packed_pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, merged_partitions: int = MERGED_PARTITIONS) -> DataFrame:
    """One row per piece with its place: every token id lies in exactly one piece.

    The texts are read and tokenized once; the pieces' descriptions are written to
    the shared folder.  The merge sees at most ``open_windows * merged_partitions``
    windows per task, whatever the input's size.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokenize = lambda: WordTokenizer(tokenizer_path)
    packed = written(rows.mapInArrow(lambda it: _pack_partition(it, tokenize, end_id, window, open_windows, merged_partitions), OPEN), "packed")
    cols = _NAMES[:7]
    left = packed.filter("open").groupBy("merge_group").applyInArrow(lambda key, table: _merge_windows(key, table, window), PIECES)
    return packed.filter("NOT open").select(*cols).unionByName(left)
