"""Hashes that stand for something else: vectors without meaning, for tests of the plumbing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest_bytes(text: Column, bits: int = 512) -> Column:
    """The bytes of the text's SHA-2 digest as an array of ints."""
    digest = F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), bits)
    return F.transform(F.sequence(F.lit(0), F.lit(bits // 8 - 1)), lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))


def digest_embedding(text: Column, dimensions: int) -> Column:
    """Each number is the sum of two bytes of the digest over 255, less one, to six places."""
    n = 64
    b = digest_bytes(text)
    places = F.array(*[F.struct(F.lit(i % n).alias("p"), F.lit((i * 7 + 13) % n).alias("q")) for i in range(dimensions)])
    return F.transform(F.transform(F.array(b), lambda x: F.transform(places, lambda k: F.round((F.get(x, k["p"]) + F.get(x, k["q"])) / 255 - 1, 6)))[0], lambda v: v)
