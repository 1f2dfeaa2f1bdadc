"""Language identification by Bayesian evidence fusion.

The posterior of a document's language multiplies four pieces of evidence:

* the text's likelihood under letter-trigram models, one per language, tempered
  because neighbouring trigrams are not independent;
* the declared language, through a confusion table P(declared | language);
* the address suffix, through a table P(suffix | language);
* a prior of the host, smoothed towards its parent domains and at last towards all
  documents; counts come from grouped aggregation of what the texts alone say.

Every declared language gets a trigram model.  They are fitted on about ``sample_rows``
documents with a declared language, dealt evenly to the languages but not below
``LEAST_PER_LANGUAGE`` each, drawn by a hash of their ids; all tables of counts cover
all documents.

A document is rejected when its text gives no evidence (null, empty, no letters),
when a background model of evenly spread trigrams explains it best (``und``), or
when no language reaches ``min_posterior``.  Missing declarations and hosts leave
their factor out.  Ties go to the language first in order.  Repeated rows get equal
results, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrow import chunks, memory_returned, returned_after
from tessera.sources.shared import written

SAMPLE_ROWS = 20_000
LEAST_PER_LANGUAGE = 500
LANGUAGES_AT_ONCE = 32
SCORED_BYTES = 1 << 18
TRIGRAM_BITS = 15
TEMPER = 0.25
SMOOTHING = 0.05
HOST_WEIGHT = 20.0
MIN_POSTERIOR = 0.5
LEVELS = 3
SALTS = 64
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[np.r_[97:123]] = np.r_[97:123]
_FOLD[np.r_[65:91]] = np.r_[97:123]
_FOLD[128:] = np.r_[128:256]


def trigram_cells(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hashed trigram from each byte on; letters folded, all else a space.

    The last cell of the table stands for no evidence: trigrams of one letter or
    less and those over a text's end.
    """
    x = _FOLD[data].astype(np.uint32)
    none = np.uint32(1 << TRIGRAM_BITS)
    cell = np.full(len(x), none, np.uint32)
    if len(x) > 2:
        a, b, c = x[:-2], x[1:-1], x[2:]
        mixed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        letters = (a != 32).astype(np.uint8) + (b != 32) + (c != 32)
        cell[:-2] = np.where(letters > 1, mixed >> np.uint32(32 - TRIGRAM_BITS), none)
    for back in (1, 2):
        at = off[1:] - back
        cell[at[(at >= off[:-1]) & (np.diff(off) > 0)]] = none
    return cell


def _count_batches(batches, languages: list[str]):
    index = {name: i for i, name in enumerate(languages)}
    width = (1 << TRIGRAM_BITS) + 1
    total = np.zeros((len(languages), width), np.int64)
    for batch in batches:
        which = [index.get(x, -1) for x in batch.column(0).to_pylist()]
        for lo, hi, data, off in chunks(batch.column(1), SCORED_BYTES):
            cell = trigram_cells(data, off)
            for i in range(lo, hi):
                if which[i] >= 0:
                    total[which[i]] += np.bincount(cell[off[i - lo] : off[i - lo + 1]], minlength=width)
    lang, cell = np.nonzero(total[:, :-1])
    yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[lang, cell])], names=["lang", "cell", "n"])


def text_model(docs: DataFrame, text: Column, declared: Column, key: Column, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of trigram cells; the last row is ``und``.

    ``sample_rows`` bounds the expected number of documents the models are fitted on,
    as long as it leaves LEAST_PER_LANGUAGE to each language.
    """
    rows = docs.select(declared.alias("lang"), text.alias("text"), key.alias("key")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().collect()
    languages = sorted(r.lang for r in sizes)
    each = max(sample_rows / max(1, len(languages)), LEAST_PER_LANGUAGE)
    share = {r.lang: min(1.0, each / r["count"]) for r in sizes}
    draw = F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = F.create_map(*[F.lit(x) for pair in sorted(share.items()) for x in pair])[F.col("lang")] if share else F.lit(0.0)
    sample = rows.filter(draw < limit).select("lang", "text")
    counts = sample.mapInArrow(lambda it: returned_after(_count_batches(it, languages)), "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(languages) + 1, 1 << TRIGRAM_BITS), SMOOTHING)
    table[counts["lang"].to_numpy(), counts["cell"].to_numpy()] += counts["n"].to_numpy()
    log = np.log(table / table.sum(1, keepdims=True))
    log = np.concatenate([log, np.zeros((len(log), 1))], axis=1)
    return languages, log.astype(np.float32)


def text_scores(model: np.ndarray):
    """Arrow function: tempered log likelihoods per language, null without evidence."""
    width = len(model)
    tables = [np.ascontiguousarray(model[i : i + LANGUAGES_AT_ONCE].T) for i in range(0, width, LANGUAGES_AT_ONCE)]
    none = 1 << TRIGRAM_BITS

    def scored(text: pa.Array) -> pa.Array:
        parts = []
        for _, _, data, off in chunks(text, SCORED_BYTES):
            cell = trigram_cells(data, off)
            n = len(off) - 1
            sums = np.zeros((n, width), np.float32)
            seen = np.zeros(n, np.int64)
            full = np.flatnonzero(np.diff(off))
            if len(full):
                for k, table in enumerate(tables):
                    at = k * LANGUAGES_AT_ONCE
                    sums[full, at : at + table.shape[1]] = np.add.reduceat(table[cell], off[:-1][full], axis=0)
                seen[full] = np.add.reduceat((cell != none).astype(np.int64), off[:-1][full])
            sums[seen == 0] = np.nan
            parts.append(sums * np.float32(TEMPER))
        flat = np.concatenate(parts) if parts else np.zeros((0, width), np.float32)
        rows = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), width).cast(pa.list_(pa.float32()))
        return pa.array([None], rows.type).take(pa.array([], pa.int64())) if not len(flat) else rows

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(scored, texts)
        memory_returned()

    return scores


def host_of(address: Column) -> Column:
    """Lower-case host of a URL or bare host name."""
    host = F.regexp_extract(F.lower(address), r"^(?:[a-z][a-z0-9+.\-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1)
    return F.when(host != "", host)


def _parent(host: Column) -> Column:
    return F.when(F.instr(host, ".") > 0, F.regexp_replace(host, r"^[^.]*\.", ""))


def _log_table(votes: DataFrame, column: str, languages: list[str]) -> DataFrame:
    """``column``, array of log P(value | language), Dirichlet-smoothed over the values seen."""
    k = range(len(languages))
    values = votes.filter(F.col(column).isNotNull()).groupBy(column).agg(*[F.sum((F.col("vote") == i).cast("double")).alias(f"n{i}") for i in k])
    total = values.agg(F.count("*").alias("v"), *[F.coalesce(F.sum(f"n{i}"), F.lit(0.0)).alias(f"t{i}") for i in k]).first()
    logs = [F.log((F.col(f"n{i}") + 0.5) / F.lit(total[f"t{i}"] + 0.5 * max(1, total.v))) for i in k]
    return values.select(column, F.array(*logs).alias(f"{column}_log"))


def host_priors(votes: DataFrame, languages: list[str]) -> DataFrame:
    """(host, prior): P(language | host), each level smoothed towards its parent."""
    k = range(len(languages))
    counted = [F.sum((F.col("vote") == i).cast("double")).alias(f"n{i}") for i in k]
    overall = [x or 0.0 for x in votes.agg(*counted).first()]
    root = F.array(*[F.lit((x + 1.0) / (sum(overall) + len(languages))) for x in overall])
    chains = votes.filter("host IS NOT NULL").groupBy("host").agg(*counted).withColumn("l0", F.col("host"))
    for d in range(1, LEVELS):
        chains = chains.withColumn(f"l{d}", _parent(F.col(f"l{d - 1}")))
    prior = chains.withColumn("prior", root)
    for d in reversed(range(LEVELS)):
        level = chains.filter(F.col(f"l{d}").isNotNull()).groupBy(F.col(f"l{d}").alias("at")).agg(*[F.sum(f"n{i}").alias(f"s{i}") for i in k])
        prior = prior.join(level, prior[f"l{d}"] == level["at"], "left").drop("at")
        size = sum(F.col(f"s{i}") for i in k)
        smooth = F.array(*[(F.col(f"s{i}") + HOST_WEIGHT * F.col("prior")[i]) / (size + HOST_WEIGHT) for i in k])
        prior = prior.withColumn("prior", F.coalesce(F.when(F.col("s0").isNotNull(), smooth), F.col("prior"))).drop(*[f"s{i}" for i in k])
    return prior.select("host", "prior")


def _joined_salted(rows: DataFrame, table: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """Left join of documents with a table of one row per key; a hot key is spread over ``salts`` tasks."""
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "text_hash"), F.lit(salts)).cast("int"))
    return salted.join(spread, [key, "_salt"], "left").drop("_salt")


def identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", address_col: str | None = "source", sample_rows: int = SAMPLE_ROWS, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """Per document: id, text_hash, declared, host, suffix, text_language, language, posterior, accepted.

    Texts are read twice (fitting, scoring) and never moved; what follows works on
    one small row per document.
    """
    none = F.lit(None).cast("string")
    text = F.col(text_col).cast("string")
    declared = F.lower(F.regexp_extract(F.col(declared_col).cast("string"), r"^\s*([A-Za-z]+)", 1)) if declared_col else none
    declared = F.when(declared != "", declared)
    host = host_of(F.col(address_col).cast("string")) if address_col else none
    languages, model = text_model(docs, text, declared, F.col(id_col))
    names = [*languages, UNKNOWN]
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), declared.alias("declared"), host.alias("host"), text_scores(model)(text).alias("scores"))
    rows = rows.withColumn("suffix", F.when(F.instr("host", ".") > 0, F.regexp_extract("host", r"([^.]+)$", 1)))
    seen = ~F.isnan(F.col("scores")[0])
    best = (F.array_position("scores", F.array_max("scores")) - 1).cast("int")
    rows = written(rows.withColumn("vote", F.when(seen, best)), "language-scores")
    votes = rows.filter(F.col("vote") < len(languages)) if languages else rows.filter("false")
    uniform = float(-np.log(len(names)))
    k = range(len(languages))
    out = _joined_salted(rows, host_priors(votes, languages), "host") if languages else rows.withColumn("prior", F.lit(None).cast("array<double>"))
    for column in ("declared", "suffix"):
        if languages:
            out = _joined_salted(out, _log_table(votes, column, languages), column)
    if languages:
        score = [F.col("scores")[i].cast("double") + F.coalesce(F.log(F.col("prior")[i]), F.lit(uniform)) + F.coalesce(F.col("declared_log")[i], F.lit(0.0)) + F.coalesce(F.col("suffix_log")[i], F.lit(0.0)) for i in k]
        back = F.col("scores")[len(languages)].cast("double") + F.lit(uniform)
        out = out.withColumn("fused", F.array(*score, back + F.coalesce(F.array_max("declared_log"), F.lit(0.0)) + F.coalesce(F.array_max("suffix_log"), F.lit(0.0))))
    else:
        out = out.withColumn("fused", F.array(F.lit(0.0)))
    top = F.array_max("fused")
    at = (F.array_position("fused", top) - 1).cast("int")
    mass = F.aggregate("fused", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max(F.col("fused"))))
    label = F.array(*[F.lit(n) for n in names])
    has_text = F.col("vote").isNotNull()
    language = F.when(has_text, label[at]).otherwise(UNKNOWN)
    posterior = F.when(has_text, F.round(1.0 / mass, 6)).otherwise(0.0)
    out = out.withColumns({"language": language, "posterior": posterior, "text_language": F.when(has_text, label[F.col("vote")]).otherwise(UNKNOWN)})
    accepted = (F.col("language") != UNKNOWN) & (F.col("posterior") >= min_posterior)
    return out.select(F.col("_id").alias(id_col), "text_hash", "declared", "host", "suffix", "text_language", "language", "posterior", accepted.alias("accepted"))


def accepted_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rejected; ``lang`` becomes the language found.

    Column names that start with ``__tessera`` are reserved."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = identified(docs, **options).filter("accepted").groupBy(F.col(id_col).alias("__tessera_id"), F.col("text_hash").alias("__tessera_hash")).agg(F.first("language").alias("__tessera_language"))
    keyed = docs.withColumn("__tessera_key", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    kept = keyed.join(found, keyed[id_col].eqNullSafe(found["__tessera_id"]) & (keyed["__tessera_key"] == found["__tessera_hash"]))
    lang = options.get("declared_col", "lang")
    return kept.select(*[F.col("__tessera_language").alias(c) if c == lang else docs[c] for c in docs.columns])
