"""Exact removal of long repeated byte strings over a prefix-free parse.

Every byte covered by a ``length``-byte string that also starts anywhere else in the
corpus is removed.  As in prefix-free parsing, a rolling hash picks trigger
positions by content alone, the text between and around triggers becomes phrases,
equal phrases are stored once in a dictionary, and a text is the parse over it.

Triggers: the leftmost smallest rolling hash within any ``length`` bytes.  So every
string of that length has exactly one trigger, at the same offset wherever the string
occurs, and phrases are bounded.  The phrase of a trigger spans all strings it
serves.  A phrase that occurs twice settles all its strings at once; a phrase whose
trigger occurs in no other phrase settles none.  Only the rest, phrases that share a
trigger but differ somewhere, are compared inside: first by blocks of neighbouring
strings (their common core and the few bytes at either side), then string by string
where blocks differ.

Full prefix-free parsing sorts dictionary suffixes and parse ranks to get the order
of all suffixes.  Here only equality up to ``length`` bytes counts, so suffixes are
put into classes by 128-bit hashes instead of being sorted: classes are counted with
map-side combination and no class has to fit into a task.

Runs of words instead of bytes go the same way: ``removed_word_runs`` writes a text as
four bytes of hash per word and takes these codes as the units of strings, so that a
run of n words is a string of n units whatever its words' lengths, and cuts the words
that the strings found cover.  Lengths, positions and counts below are in units.
``removed_repeats`` can count such runs beside its strings: passages of n words may be
shorter than ``length`` bytes.

Matches never cross documents.  Null text is empty, repeated rows count as
repetitions, texts shorter than ``length`` keep everything, an empty table gives no
rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest, xxh32_digest

from tessera.llm.arrow import chunks, returned_after
from tessera.operators.joins import join_with_hot_keys
from tessera.sources.shared import forgotten, written

LENGTH = 400
GRAM = 64
BLOCK = 16
PLACE_BITS = 28
CHUNK_BYTES = 1 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Words are between ASCII white space; each becomes so many bytes.
WORD = re.compile(rb"\S+")
CODE = 4
WORD_GRAM = 8
OUTPUTS = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "n_word_runs", "n_run_words"]


class _Powers:
    """Powers of the rolling hash's base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.zeros(0, U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES + 1)
            self.up = np.cumprod(np.r_[U(1), np.full(n, BASE, U)])
            self.down = np.cumprod(np.r_[U(1), np.full(n, pow(BASE, -1, 1 << 64), U)])
        return self.up, self.down


def _rolling(data: np.ndarray, gram: int, powers: _Powers) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes from each position on."""
    n = len(data)
    up, down = powers.of(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values: running minima within blocks, both ways."""
    n = len(x)
    pad = -n % width
    full = np.r_[x, np.full(pad, np.iinfo(np.uint64).max, U)].reshape(-1, width)
    fore = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], fore[width - 1 : n])


def triggers(data: np.ndarray, off: np.ndarray, length: int, gram: int, powers: _Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first string, last string, hash) of a chunk's texts; positions in the chunk."""
    size = np.diff(off)
    none = np.zeros(0, np.int64)
    if len(data) < length or not (size >= length).any():
        return none, none, none, none.astype(U)
    h = _rolling(data, gram, powers)
    mask = U((1 << PLACE_BITS) - 1)
    least = _sliding_min((h & ~mask) | np.arange(len(h), dtype=U), length - gram + 1)
    valid = np.zeros(len(data) + 1, np.int32)
    long = size >= length
    np.add.at(valid, off[:-1][long], 1)
    np.add.at(valid, off[1:][long] - length + 1, -1)
    string = np.flatnonzero(np.cumsum(valid)[: len(least)])
    at = (least[string] & mask).astype(np.int64)
    head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (string[1:] != string[:-1] + 1)])
    last = np.r_[head[1:], len(at)] - 1
    return at[head], string[head], string[last], h[at[head]]


def _longs(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def _parse_batches(batches: Iterator[pa.RecordBatch], length: int, gram: int, unit: int) -> Iterator[pa.RecordBatch]:
    powers = _Powers()
    for batch in batches:
        doc, text_hash = batch.column(0), batch.column(1)
        for lo, _, data, off in chunks(batch.column(2), CHUNK_BYTES):
            raw = memoryview(data.tobytes())
            data, off = np.frombuffer(raw, f"<u{unit}"), off // unit
            at, first, last, h = triggers(data, off, length, gram, powers)
            if not len(at):
                continue
            names = [xxh3_128_digest(raw[i:j], seed=s) for i, j, s in zip((first * unit).tolist(), ((last + length) * unit).tolist(), (at - first).tolist(), strict=True)]
            row = np.searchsorted(off, at, "right") - 1
            c1, c2 = _longs(names)
            who = pa.array(row + lo)
            cols = [doc.take(who), text_hash.take(who), pa.array(h.view(np.int64)), c1, c2, pa.array((at - off[row]).astype(np.int32)), pa.array((at - last).astype(np.int32)), pa.array((at - first).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "trigger", "p1", "p2", "at", "d_low", "d_high"])


PARSE = "doc_id long, text_hash long, trigger long, p1 long, p2 long, at int, d_low int, d_high int"
BLOCKS = "doc_id long, text_hash long, k1 long, k2 long, sides binary, base int, weight int"


def _side(length: int) -> int:
    """Strings of a block less one; their common core has one unit at least."""
    return min(BLOCK, length) - 1


def _block_batches(batches: Iterator[pa.RecordBatch], length: int, unit: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the phrases to compare, clipped to the strings that a phrase serves.

    So each string of a text is in one block only.  ``sides`` holds the clip and the
    bytes at either side of the core that the block's strings reach.
    """
    side = _side(length)
    block, core_size, side_bytes = side + 1, (length - side) * unit, side * unit
    for batch in batches:
        rows: list[tuple] = []
        keys: list[bytes] = []
        for doc, text_hash, text, phrases in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            data = text.as_py()
            data = data.encode() if isinstance(data, str) else data
            for at, low, high, weight in zip(phrases["at"], phrases["d_low"], phrases["d_high"], phrases["weight"], strict=True):
                for k in range(low // block, high // block + 1):
                    base = at - block * k - side
                    j_low, j_high = max(0, side - (high - block * k)), min(side, side - (low - block * k))
                    core, after = (base + side) * unit, (base + length) * unit
                    left, right = data[(base + j_low) * unit : core], data[after : after + j_high * unit]
                    sides = bytes((j_low, j_high)) + left.rjust(side_bytes, b"\0") + right.ljust(side_bytes, b"\0")
                    keys.append(xxh3_128_digest(data[core : core + core_size]))
                    rows.append((doc, text_hash, sides, base, weight))
            if len(rows) > 20_000:
                yield _blocks(rows, keys)
                rows, keys = [], []
        if rows:
            yield _blocks(rows, keys)


def _blocks(rows: list[tuple], keys: list[bytes]) -> pa.RecordBatch:
    doc, text_hash, sides, base, weight = zip(*rows, strict=True)
    k1, k2 = _longs(keys)
    cols = [pa.array(doc, pa.int64()), pa.array(text_hash, pa.int64()), k1, k2, pa.array(sides, pa.binary()), pa.array(base, pa.int32()), pa.array(weight, pa.int32())]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "k1", "k2", "sides", "base", "weight"])


def _word_codes(text: str) -> bytes:
    return b"".join(map(xxh32_digest, WORD.findall(text.encode())))


def _code_batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Word codes of the texts that have at least ``least`` words."""
    for batch in batches:
        codes = pa.array([_word_codes(x.as_py() or "") for x in batch.column(2)], pa.binary())
        coded = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes], names=["doc_id", "text_hash", "text"])
        yield coded.filter(pc.greater_equal(pc.binary_length(codes), least * CODE))


def _spans_of_words(data: bytes, runs: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Byte spans of runs of words."""
    words = [m.span() for m in WORD.finditer(data)] if runs else []
    return [words[i][0] for i, _ in runs], [words[j - 1][1] for _, j in runs]


def _merged(start: list[int] | None, count: list[int] | None, length: int) -> tuple[list[int], list[int]]:
    """Maximal spans covered by runs of ``count`` strings from ``start`` on."""
    if not start:
        return [], []
    s = np.array(start)
    order = np.argsort(s, kind="stable")
    s = s[order]
    e = np.maximum.accumulate(s + np.array(count)[order] - 1 + length)
    head = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return s[head].tolist(), e[np.r_[head[1:], len(s)] - 1].tolist()


def _cut_batches(batches: Iterator[pa.RecordBatch], length: int, runs: int | None, texts: bool, cut_words: bool) -> Iterator[pa.RecordBatch]:
    """Applies marked strings: what is kept of each text, how much went, and how many words are in repeated runs."""
    for batch in batches:
        out = []
        marks = zip(*[batch.column(k).to_pylist() for k in range(1, 5)], strict=True)
        for text, (start, count, word_start, word_count) in zip(batch.column(0), marks, strict=True):
            data = (text.as_py() or "").encode()
            starts, ends = _merged(start, count, length)
            words = list(zip(*_merged(word_start, word_count, runs or 0), strict=True))
            if cut_words:
                starts, ends = _spans_of_words(data, words)
            kept, at = [], 0
            for i, j in zip(starts, ends, strict=True):
                kept.append(data[at:i])
                at = j
            kept.append(data[at:])
            left = b"".join(kept)
            out.append((len(data), len(data) - len(left), len(starts), hashlib.sha256(left).hexdigest(), left.decode(errors="ignore") if texts else None, len(words), sum(j - i for i, j in words)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
        rest = [batch.column(i) for i in range(5, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*cols, *rest], names=[*OUTPUTS, *batch.schema.names[5:]])


def repeated_word_runs(texts: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, start, count): runs of ``words`` words that also start elsewhere, counted in words.

    Texts are coded and parsed by one worker: two in a row would double the Python workers of an executor.
    """
    gram, texts = min(words, WORD_GRAM), texts.select("doc_id", "text_hash", "text")
    parse = texts.mapInArrow(lambda it: returned_after(_parse_batches(_code_batches(it, words), words, gram, CODE)), PARSE)
    codes = texts.mapInArrow(lambda it: returned_after(_code_batches(it, words)), "doc_id long, text_hash long, text binary")
    return _repeated(codes, parse, words, CODE)


def repeated_strings(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, unit: int = 1) -> DataFrame:
    """(doc_id, text_hash, start, count): runs of strings of ``length`` units that also start elsewhere.

    ``texts`` has doc_id, text_hash and text, of a multiple of ``unit`` bytes (1, 2 or 4).
    """
    parse = texts.select("doc_id", "text_hash", "text").mapInArrow(lambda it: returned_after(_parse_batches(it, length, gram, unit)), PARSE)
    return _repeated(texts, parse, length, unit)


def _repeated(texts: DataFrame, parse: DataFrame, length: int, unit: int) -> DataFrame:
    parse = written(parse, "parse")
    # The dictionary: distinct phrases with their number of occurrences.
    phrase = ["trigger", "p1", "p2"]
    place = F.xxhash64("doc_id", "text_hash", "at")  # one occurrence, the least by hash, stands for its phrase
    first = F.min(place)
    dictionary = written(parse.groupBy(*phrase).agg(F.count("*").alias("n"), first.alias("first")), "dictionary")
    shared = dictionary.groupBy("trigger").agg(F.count("*").alias("phrases"), F.sum("n").alias("all")).filter("all > 1").select("trigger", "phrases", F.col("phrases").alias("rows"))
    shared = written(shared, "shared-triggers")
    open_phrases = join_with_hot_keys(dictionary, shared, ["trigger"], "rows", dictionary.count()).filter("n > 1 OR phrases > 1")
    open_phrases = written(open_phrases.withColumn("rows", F.col("n")), "open-phrases")
    opened = join_with_hot_keys(parse, open_phrases, phrase, "rows", parse.count())
    seen = written(opened.select("doc_id", "text_hash", "at", "d_low", "d_high", "n", "phrases", (place == F.col("first")).alias("is_first")), "opened")
    for table in (parse, dictionary, shared, open_phrases):
        forgotten(table)
    settled = seen.filter("n > 1").select("doc_id", "text_hash", (F.col("at") - F.col("d_high")).alias("start"), (F.col("d_high") - F.col("d_low") + 1).alias("count"))

    # Blocks of phrases that share their trigger with other phrases, one per distinct phrase.
    asked = seen.filter("phrases > 1 AND is_first").groupBy("doc_id", "text_hash")
    fields = {"at": F.col("at"), "d_low": F.col("d_low"), "d_high": F.col("d_high"), "weight": F.when(F.col("n") > 1, 2).otherwise(1)}
    asked = asked.agg(F.collect_list(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("list"))
    asked = asked.select("doc_id", "text_hash", F.struct(*[F.col("list")[k].alias(k) for k in fields]).alias("phrases"))
    both = (texts["doc_id"].eqNullSafe(asked["doc_id"])) & (texts["text_hash"] == asked["text_hash"])
    to_cut = texts.join(asked, both).select(texts["doc_id"], texts["text_hash"], texts["text"], "phrases")
    blocks = written(to_cut.mapInArrow(lambda it: returned_after(_block_batches(it, length, unit)), BLOCKS), "blocks")
    core, block = ["k1", "k2"], ["k1", "k2", "sides"]
    classes = written(blocks.groupBy(*block).agg(F.sum("weight").alias("weight")), "block-classes")
    cores = classes.groupBy(*core).agg(F.sum("weight").alias("all"), F.count("*").alias("classes")).filter("all > 1").select(*core, "classes", F.col("classes").alias("rows"))
    classes = written(join_with_hot_keys(classes, written(cores, "block-cores"), core, "rows", classes.count()), "shared-classes")
    low, high = (F.conv(F.hex(F.substring("sides", i, 1)), 16, 10).cast("int") for i in (1, 2))
    whole = classes.filter("weight > 1").select(*block, F.explode(F.sequence(low, high)).alias("j"))

    # String by string where a core has several classes.
    single = classes.filter("classes > 1").withColumn("j", F.explode(F.sequence(low, high)))
    side = _side(length)
    left = F.expr(f"substring(sides, 3 + {unit} * j, {unit} * ({side} - j))")
    right = F.expr(f"substring(sides, {3 + side * unit}, {unit} * j)")
    key: list[Column] = [F.xxhash64(F.lit(s), "k1", "k2", "j", left, right) for s in (1, 2)]
    single = single.withColumns({"s1": key[0], "s2": key[1]})
    twice = single.groupBy("s1", "s2").agg(F.sum("weight").alias("all")).filter("all > 1").select("s1", "s2")
    found = single.filter("weight = 1").join(twice, ["s1", "s2"]).select(*block, "j").unionByName(whole)
    hits = blocks.filter("weight = 1").join(found, block).select("doc_id", "text_hash", (F.col("base") + F.col("j")).alias("start"), F.lit(1).alias("count"))
    return settled.unionByName(hits)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def removed_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, texts: bool = True, run_words: int | None = None) -> DataFrame:
    """``docs`` without texts, with n_bytes, n_removed, n_spans, kept_sha256, kept_text, n_word_runs and n_run_words.

    Counts and digest are of bytes; ``kept_text`` leaves out characters that lost
    some of their bytes only, and is null unless ``texts`` are asked for.  With
    ``run_words`` the last two count, without removing them, the maximal runs of words
    that are covered by runs of so many words met twice, and the words in them; they
    are 0 without it.
    Ids need not be unique: texts are told apart by id and hash.  Input columns named
    as an output are replaced; names that start with ``__tessera`` are reserved.
    """
    return _removed(docs, id_col, text_col, length, gram, run_words, texts, False)


def removed_word_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int, texts: bool = True) -> DataFrame:
    """As ``removed_repeats``, for every run of ``words`` words that also starts anywhere else; the white space inside goes with them."""
    return _removed(docs, id_col, text_col, None, GRAM, words, texts, True)


def _removed(docs: DataFrame, id_col: str, text_col: str, length: int | None, gram: int, run_words: int | None, texts: bool, cut_words: bool) -> DataFrame:
    docs = docs.drop(*OUTPUTS)
    keyed = docs.withColumns({"__tessera_id": F.col(id_col).cast("long"), "__tessera_hash": text_key(F.col(text_col)), "__tessera_text": F.col(text_col).cast("string")})
    long = keyed.select(F.col("__tessera_id").alias("doc_id"), F.col("__tessera_hash").alias("text_hash"), F.col("__tessera_text").alias("text"))
    found = []
    if length:
        found.append(repeated_strings(long.filter(F.octet_length("text") >= length), length, gram).withColumn("words", F.lit(False)))
    if run_words:
        found.append(repeated_word_runs(long, run_words).withColumn("words", F.lit(True)))
    found = [written(f, "marks") for f in found]
    marks = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    lists = [F.collect_list(F.when(F.col("words") == w, F.struct("start", "count"))).alias(k) for w, k in ((False, "bytes"), (True, "codes"))]
    marks = marks.groupBy(F.col("doc_id").alias("__tessera_doc"), F.col("text_hash").alias("__tessera_key")).agg(*lists)
    joined = keyed.join(marks, keyed["__tessera_id"].eqNullSafe(marks["__tessera_doc"]) & (keyed["__tessera_hash"] == marks["__tessera_key"]), "left")
    rest = [c for c in docs.columns if c != text_col]
    places = [F.col(f"{k}.{part}").alias(f"__tessera_{k}_{part}") for k in ("bytes", "codes") for part in ("start", "count")]
    rows = joined.select("__tessera_text", *places, *rest)
    schema = ", ".join(f"{c} {'string' if c.startswith('kept') else 'long'}" for c in OUTPUTS)
    fields = [f for f in rows.schema.fields if f.name in rest]
    return rows.mapInArrow(lambda it: returned_after(_cut_batches(it, length or 0, run_words, texts, cut_words)), T.StructType([*T._parse_datatype_string(schema).fields, *fields]))
