"""Bloom filters as tables of words (word, bits), built by partial bit_or and probed inside rows.

A filter's size is set beforehand, so it is small whatever the number of keys: tasks send one row for each
word at most. Probing joins one broadcast row that holds the words as an array (``MOST_BITS`` bounds it), so that
rows which can't match are gone before the shuffle of a join. Positions come from md5, which other engines have too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a word (the sign isn't used), and the greatest filter: 9 MB as an array.
WORD_BITS, MOST_BITS = 62, 1 << 26


def size_for(keys: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) for so many distinct keys and this rate of false positives."""
    bits = max(WORD_BITS, math.ceil(-max(1, keys) * math.log(rate) / math.log(2) ** 2))
    return min(bits, MOST_BITS), max(1, round(bits / max(1, keys) * math.log(2)))


def positions(key: Column, bits: int, hashes: int) -> Column:
    """The bits of a key, from two halves of its text's md5; null for a null key."""
    text = F.md5(key.cast("string").cast("binary"))
    half = lambda at: F.conv(F.substring(text, at, 15), 16, 10).cast("long") % bits
    return F.when(key.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (half(1) + i * half(16)) % bits))


def _bit(position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(1 << k) for k in range(WORD_BITS)]), (position % WORD_BITS).cast("int") + 1)


def build(rows: DataFrame, key: Column, bits: int, hashes: int) -> DataFrame:
    """word, bits of the filter of ``key`` over all rows; null keys are in no filter."""
    if not 0 < bits <= MOST_BITS or hashes < 1:
        raise ValueError(f"a filter has 1 to {MOST_BITS} bits and a hash or more")
    spots = rows.select(F.explode(positions(key, bits, hashes)).alias("p"))
    return spots.groupBy((F.col("p") / WORD_BITS).cast("int").alias("word")).agg(F.bit_or(_bit(F.col("p"))).alias("bits"))


def merge(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of filters of one size."""
    every = filters[0]
    for other in filters[1:]:
        every = every.unionByName(other)
    return every.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def probe(rows: DataFrame, key: Column, words: DataFrame, bits: int, hashes: int, name: str = "maybe") -> DataFrame:
    """``rows`` with ``name``: false where the key is surely not among the filter's, true where it may be, null for a null key."""
    every = rows.sparkSession.range(math.ceil(bits / WORD_BITS)).select(F.col("id").cast("int").alias("word"))
    dense = every.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    one = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("_words"))
    spots = positions(key, bits, hashes)
    found = F.forall(spots, lambda p: F.element_at("_words", (p / WORD_BITS).cast("int") + 1).bitwiseAND(_bit(p)) != 0)
    return rows.crossJoin(F.broadcast(one)).withColumn(name, found).drop("_words")


def reduce_join(rows: DataFrame, key: str, other: DataFrame, other_key: str, rate: float = 0.01) -> DataFrame:
    """Rows of ``rows`` whose ``key`` is in ``other``, the filter sized by a count of ``other`` and probed before the join."""
    keys = other.select(F.col(other_key).alias(key)).where(F.col(key).isNotNull()).distinct()
    bits, hashes = size_for(keys.count(), rate)
    likely = probe(rows, F.col(key), build(keys, F.col(key), bits, hashes), bits, hashes, "_maybe").where("_maybe").drop("_maybe")
    return likely.join(keys, key, "left_semi")
