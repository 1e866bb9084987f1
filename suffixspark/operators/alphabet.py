"""Alphabet histogram, order-preserving codes and compression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(chars: DataFrame) -> DataFrame:
    """(chr, n) of (pos, chr)."""
    return chars.groupBy("chr").agg(F.count("*").alias("n"))


def codes(chars: DataFrame, limit: int = 255) -> DataFrame:
    """(chr, code): codes 1..sigma in the order of characters. More than ``limit`` distinct ones are refused: 0 is for padding.

    The alphabet has at most limit + 1 rows here, so its window is small.
    """
    found = chars.select("chr").distinct().limit(limit + 1)
    if found.count() > limit:
        raise ValueError(f"the alphabet has over {limit} characters")
    return found.select("chr", F.row_number().over(Window.orderBy("chr")).alias("code"))


def compress(chars: DataFrame, limit: int = 255) -> DataFrame:
    """(pos, chr) with characters replaced by their codes."""
    return chars.join(F.broadcast(codes(chars, limit)), "chr").select("pos", F.col("code").cast("long").alias("chr"))


def bits_per_code(sigma: int) -> int:
    """Width that holds codes 0..sigma: 3, 5 or 8 bits."""
    return 3 if sigma <= 7 else 5 if sigma <= 31 else 8


def packing(bits: int, modulus: int) -> dict[str, int | float]:
    """How many characters of a width a 64-bit word holds, and words, characters and ratio for keys of ``modulus``."""
    per_word = 64 // bits
    words = -(-modulus // per_word)
    return {"chars_per_word": per_word, "words": words, "packed_chars": words * per_word, "ratio": words * per_word / modulus}


def packed(key, bits: int, chars: int):
    """One number of the first ``chars`` codes of a binary key, the first in the highest bits; missing ones are 0."""
    value = F.lit(0).cast("long")
    for i in range(chars):
        byte = F.coalesce(F.conv(F.hex(F.substring(key, i + 1, 1)), 16, 10).cast("long"), F.lit(0))
        value = F.shiftleft(value, bits).bitwiseOR(byte)
    return value
