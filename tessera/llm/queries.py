"""The queries of this subpackage's operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import flac, html_text, language, mixing, packing, phrases, quality, repeats, sharding, simhash

#: The shortest run of words that counts as a repeated passage: more than 50.
REPEATED_WORDS = 51


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shuffled_shards(docs, shards=24)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return placed.select("doc_id", sharding.record_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(flac.stored_media(_table(spark, sf_dir, "documents")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(_table(spark, sf_dir, "documents")).drop("text_hash")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal by strings of 400 bytes; ``n_word_runs`` and ``n_run_words`` report repeated runs of over 50 words beside it."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeats.removed_repeats(docs, texts=False, run_words=REPEATED_WORDS)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_word_runs", "n_run_words")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").filter("quality = 1")
    return quality.scored_documents(_table(spark, sf_dir, "documents"), trusted)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(_table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_phrases": op1_phrases,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_flac": op4_flac,
    "op5_html_text": op5_html_text,
    "op6_mixing": op6_mixing,
    "op7_language_id": op7_language_id,
    "op8_repeats": op8_repeats,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
}
#: The mix with its schedule: points of the slots, ranks per source, blocks of the shuffled line.
OP6_SQL = r"""WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
keyed AS (SELECT *, md5(concat_ws('/', '20240601', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR))) AS rnd, coalesce('s' || source, 'null') AS k FROM sized),
src AS (SELECT k, source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY 1, 2),
w AS (SELECT *, list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)) AS weight, source_size * 2.0::DOUBLE AS cap FROM src),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER prev, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER prev, 0)) AS level
  FROM w WINDOW prev AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(cap, max(level) OVER () * weight) AS target FROM l),
b AS (SELECT *, CAST(greatest(ceil(source_size / greatest(ceil(source_size / 4096), least(source_size, 256), 1)), 1) AS BIGINT) AS len FROM t),
q AS (SELECT *, CAST(ceil(source_size / len) AS BIGINT) AS blocks, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS passes FROM b),
z AS (SELECT *, CASE WHEN source_size > 0 THEN least(passes * blocks + CAST(round((target - passes * source_size) / len) AS BIGINT), 2 * blocks) ELSE 0 END AS quota FROM q),
c AS (SELECT *, CAST(sum(quota) OVER (ORDER BY source NULLS LAST) AS BIGINT) AS hi, CAST(sum(quota) OVER () AS BIGINT) AS n FROM z),
g AS (SELECT n, (SELECT min(x) FROM range(500) r(i), LATERAL (SELECT greatest(1, n * 2654435769 // 4294967296) + i AS x) WHERE gcd(x, n) = 1) AS g FROM (SELECT greatest(max(n), 1) AS n FROM c)),
slots AS (SELECT slot, k, blocks, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS rank
  FROM (SELECT slot, CAST(slot * g.g % g.n AS BIGINT) AS u FROM g, range((SELECT coalesce(max(n), 0) FROM c)) r(slot)) JOIN c ON u >= hi - quota AND u < hi),
times AS (SELECT k, rank % blocks AS block, count(*) AS times, min(slot) AS slot FROM slots GROUP BY 1, 2),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY k ORDER BY rnd, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM keyed),
spans AS (SELECT doc_id, k, off, size, len, unnest(range(CAST(off // len AS BIGINT), CAST((off + size - 1) // len + 1 AS BIGINT))) AS block FROM placed JOIN c USING (k) WHERE size > 0),
got AS (SELECT doc_id, k, off, sum((least(off + size, (block + 1) * len) - greatest(off, block * len)) * times) AS taken, min(slot) AS first_slot FROM spans JOIN times USING (k, block) GROUP BY 1, 2, 3)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE coalesce(taken, 0) END AS BIGINT) AS taken, CASE WHEN size > 0 THEN first_slot END AS first_slot
FROM placed JOIN c USING (k) LEFT JOIN got USING (doc_id, k, off)"""

#: Every 400-byte string of every text, on the bytes as hexadecimal digits; and every run of 51 words.
OP8_SQL = r"""WITH n AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, length(h) // 2 AS n, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, greatest(n - 399, 0))) AS i FROM n)),
s AS (SELECT r, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM s),
sp AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS sid FROM g),
runs AS (SELECT r, sid, min(i) AS a, max(i) + 400 AS b FROM sp GROUP BY 1, 2),
k AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY sid), 0) AS before FROM runs),
seg AS (SELECT r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY sid) AS kept, max(b) AS last, sum(b - a) AS removed, count(*) AS spans FROM k JOIN n USING (r) GROUP BY 1),
pw AS (SELECT r, i, md5(array_to_string(words[i:i + 50], ' ')) AS k FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 49, 1))) AS i FROM n)),
ps AS (SELECT r, i FROM pw SEMI JOIN (SELECT k FROM pw GROUP BY k HAVING count(*) > 1) USING (k)),
pg AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 51 THEN 0 ELSE 1 END AS new FROM ps),
pp AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS sid FROM pg),
pr AS (SELECT r, count(*) AS word_runs, sum(size) AS run_words FROM (SELECT r, sid, max(i) + 51 - min(i) AS size FROM pp GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256,
  CAST(coalesce(word_runs, 0) AS BIGINT) AS n_word_runs, CAST(coalesce(run_words, 0) AS BIGINT) AS n_run_words FROM n LEFT JOIN seg USING (r) LEFT JOIN pr USING (r)"""

ORACLES: dict[str, str] = {"op6_mixing": OP6_SQL, "op8_repeats": OP8_SQL}
