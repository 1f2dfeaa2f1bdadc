"""Column expressions over text: hashing, keyed tokens, phonetic codes, chat cleaning."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Soundex digits by letter (others are vowels and silent), the default salt.
SOUNDEX_FROM, SOUNDEX_TO = "BFPVCGJKQSXZDTLMNR", "111122222222334556"
SALT = "governance_salt_2024"
CHAT_PREFIX = r"(?im)^(Agent|Customer|Bot|System|Support|User)\s*:\s*"


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns as text, nulls marked."""
    return F.sha2(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("__NULL__")) for c in columns]), 256)


def hmac_sha256(key: str, value: Column) -> Column:
    """HMAC-SHA256 of a string column as lower-case hex, from two plain digests."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)
    first = F.sha2(F.concat(F.lit(inner), F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def hashed(value: Column, salt: str = SALT) -> Column:
    """Prefix of a salted SHA-256 in hex, as long as the value and 8 characters at least."""
    return F.substring(F.sha2(F.concat(F.lit(salt), value), 256), F.lit(1), F.greatest(F.length(value), F.lit(8)))


def tokenized(value: Column, salt: str = SALT) -> Column:
    """Format-preserving one-way token: digits become digits, letters letters of their case."""
    mac = hmac_sha256(salt, value)

    def step(acc: Column, ch: Column) -> Column:
        digit, letter = ch.rlike("^[0-9]$"), ch.rlike(r"^\p{L}$")
        nibble = F.conv(F.substring(mac, acc["i"] % 64 + 1, F.lit(1)), 16, 10).cast("int")
        base = F.when(ch.rlike(r"^\p{Lu}$"), 65).otherwise(97)
        new = F.when(digit, (nibble % 10).cast("string")).when(letter, F.char(base + nibble)).otherwise(ch)
        moved = (acc["i"] + F.when(digit | letter, 1).otherwise(0)).cast("int")
        return F.struct(moved.alias("i"), F.concat(acc["o"], new).alias("o"))

    start = F.struct(F.lit(0).cast("int").alias("i"), F.lit("").alias("o"))
    return F.when(value == "", "").otherwise(F.aggregate(F.split(value, ""), start, step, lambda acc: acc["o"]))


def soundex_variant(name: Column) -> Column:
    """Soundex in which vowels do not part equal codes; the whole name is one word."""
    up = F.upper(F.trim(name))
    first = F.substring(up, 1, 1)
    digits = F.translate(F.regexp_replace(up, f"[^{SOUNDEX_FROM}]", ""), SOUNDEX_FROM, SOUNDEX_TO)
    runs = F.regexp_replace(digits, r"(.)\1+", "$1")
    tail = F.when(first.rlike(f"^[{SOUNDEX_FROM}]"), F.substring(runs, F.lit(2), F.lit(8))).otherwise(runs)
    return F.when(F.coalesce(up, F.lit("")) == "", "").otherwise(F.rpad(F.concat(first, tail), 4, "0"))


def chat_clean(text: Column) -> Column:
    """Speaker prefixes off, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, CHAT_PREFIX, ""), r"\s+", " "))
