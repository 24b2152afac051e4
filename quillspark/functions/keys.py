"""Hashes and keys as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_units(text: Column) -> Column:
    """The UTF-16 code units of a text, in order."""
    pairs = F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")
    return F.transform(F.sequence(F.lit(1), (F.octet_length(pairs) / F.lit(2)).cast("int")), lambda i: F.conv(F.hex(F.substring(pairs, i * 2 - 1, F.lit(2))), 16, 10).cast("long"))


def fnv1a32(text: Column, seed: int = 0x811C9DC5) -> Column:
    """FNV-1a over UTF-16 units, 32 bits, as an unsigned long."""
    prime = 0x01000193
    units = F.when(F.coalesce(F.octet_length(text), F.lit(0)) > 0, utf16_units(text)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(units, F.lit(seed).cast("long"), lambda h, u: F.pmod(h.bitwiseXOR(u) * prime, F.lit(1 << 32)))


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def hash_key(text: Column) -> Column:
    return base36(fnv1a32(text))


def strong_hash_key(text: Column) -> Column:
    """Two differently seeded hashes, joined by a dot."""
    return F.concat(base36(fnv1a32(text)), F.lit("."), base36(fnv1a32(text, 0x9747B28C)))


def hash31(text: Column) -> Column:
    """The 31-multiplier hash as a signed 32-bit number."""
    units = F.when(F.coalesce(F.octet_length(text), F.lit(0)) > 0, utf16_units(text)).otherwise(F.array().cast("array<bigint>"))
    wrap = lambda v: F.pmod(v + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    return F.aggregate(units, F.lit(0).cast("long"), lambda h, u: wrap(h * 31 + u))


def row_id(prefix: str, text: Column) -> Column:
    """A stable id: a prefix and the base-36 form of the hash's absolute value."""
    return F.concat(F.lit(prefix), base36(F.abs(hash31(text))))


def call_signature(name: Column, args: Column) -> Column:
    """A tool call's identity: its name and its arguments (a map) by sorted key."""
    entries = F.array_sort(F.map_entries(args))
    return F.concat(name, F.lit(":"), F.to_json(F.map_from_entries(entries)))


def translation_identity(*parts: Column) -> Column:
    """The cache identity of a request: its settings joined by bars, hashed."""
    return strong_hash_key(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
