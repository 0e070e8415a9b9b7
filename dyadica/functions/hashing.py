"""Seeded draws that depend only on (stream, purpose, row number).

They do not depend on partitioning, so a lost task redraws the same values, and any SQL
engine can draw them too: pairs by Murmur3 hashes of their numbers, texts by md5.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

# 12 hex digits of the digest make a 48-bit number.
HEX_DIGITS = 12
HEX_BASE = 16
DRAWS_KEY, MURMUR3, MD5 = "spark.dyadica.draws", "murmur3", "md5"
HALF, MASK = 32, (1 << 32) - 1


def hash48(prefix: str, key: Column) -> Column:
    digest = F.md5(F.concat(F.lit(prefix), key.cast("string")))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), HEX_BASE, 10).cast("bigint")


def stream_words(stream: str) -> list[int]:
    """Four 32-bit numbers that stand for a stream's name."""
    digest = hashlib.md5(stream.encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def draw_numbers(df: DataFrame, stream: str, key: str, first: str, second: str | None = None) -> DataFrame:
    """Add one or two uniform numbers of 48 bits, drawn from the whole numbers in ``key``: Murmur3
    hashes of 32 bits, each under a word of the stream; both numbers share one of them.

    With ``spark.dyadica.draws`` set to ``md5`` they are md5 digests of (stream, end, key) as text,
    as in earlier versions: far slower, but seeds then give the pairs they gave there.
    """
    if df.sparkSession.conf.get(DRAWS_KEY, MURMUR3) == MD5:
        ends = zip("ab", [first] if second is None else [first, second])
        return df.select("*", *[hash48(f"{stream}:{end}:", F.col(key)).alias(name) for end, name in ends])
    a, b, c = (
        F.hash(F.lit(w - (w >> 31 << HALF)).cast("int"), F.col(key)).cast("bigint").bitwiseAND(F.lit(MASK))
        for w in stream_words(stream)[:3]
    )
    part = F.lit(1 << HALF // 2)
    numbers = [a * part + b.bitwiseAND(part - 1)]
    if second is not None:
        numbers.append(c * part + F.shiftrightunsigned(b, HALF // 2))
    return df.select("*", *[v.alias(name) for v, name in zip(numbers, (first, second))])


def index_of(number: str, n: int) -> Column:
    """A uniform index in 0..n-1 from a drawn number."""
    # Never NULL; saying so keeps joins from hashing a second time to filter NULLs out.
    return F.coalesce(F.col(number) % F.lit(n).cast("bigint"), F.lit(0).cast("bigint"))


def draw_bucket(prefix: str, key: Column, buckets: int) -> Column:
    return hash48(prefix, key) % F.lit(buckets).cast("bigint")
