"""Text, JSON and search helpers as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_zone(text: Column) -> Column:
    """A date-time text without a trailing zone (``Z``, ``+hh:mm``), its T turned into a space."""
    return F.regexp_replace(F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", ""), "T", " ")


def human_duration(seconds: Column, glue: str = ", ") -> Column:
    """``3 days, 4 hours, 5 minutes, 6 seconds``; parts of zero are left out, zero is "0 seconds"."""
    parts, rest = [], seconds
    for name, size in (("day", 86400), ("hour", 3600), ("minute", 60), ("second", 1)):
        n = F.floor(rest / size)
        rest = rest % size
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n > 1, "s").otherwise(""))))
    text = F.concat_ws(glue, *parts)
    return F.when(text == "", "0 seconds").otherwise(text)


def file_extension(name: Column) -> Column:
    """Extension with its dot; names that begin with their only dot have none."""
    return F.regexp_extract(F.regexp_extract(name, r"([^/]*)$", 1), r"[^.].*?(\.[^.]*)$", 1)


def host(url: Column) -> Column:
    return F.parse_url(url, F.lit("AUTHORITY"))


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a part that don't overlap; none for an empty part."""
    if not part:
        return F.lit(0)
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def significant(x: Column, digits: int) -> Column:
    """Rounded to significant digits; 0 stays 0."""
    shift = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x * shift) / shift)


def query_words(text: Column) -> Column:
    """A search text cleaned to words: all but letters, digits and underscores become spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\w]+", " "), " +", " "))


# Full-text search


def terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term for each word (lower-cased runs of a-z, 0-9 and underscores), repeats included."""
    return docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))).alias("term"))


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf."""
    return terms(docs, key, text).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, docs that hold it, occurrences.

    A row's words are told apart inside the row: one shuffle, of counts that are summed before it.
    A document is a row of ``docs``.
    """
    words = F.sort_array(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)))
    first = lambda x, k: F.when((k == 0) | (F.get("w", k - 1) != x), 1).otherwise(0)
    rows = docs.select(words.alias("w")).select(F.explode(F.transform("w", lambda x, k: F.struct(x.alias("term"), first(x, k).alias("d")))).alias("x"))
    return rows.groupBy("x.term").agg(F.sum("x.d").alias("docs"), F.count("*").alias("n"))


def bm25(docs: DataFrame, key: str, text: str, words: list[str], k: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of the documents that hold any of the words; better is more negative.

    idf is clamped to at least 1e-6. Corpus figures (a row) and document frequencies (a row for each
    word sought) are the only broadcast sides.
    """
    found_words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    base = docs.select(key, found_words.alias("words"))
    corpus = base.agg(F.count("*").alias("total"), F.avg(F.size("words")).alias("mean_length"))
    sought = F.explode(F.filter("words", lambda w: w.isin([x.lower() for x in words])))  # before any shuffle
    hits = base.select(key, F.size("words").alias("length"), sought.alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    found = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(found), "term").crossJoin(F.broadcast(corpus))
    idf = F.greatest(F.ln((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("length") / F.col("mean_length")))
    return rows.groupBy(key).agg((-F.sum(idf * part)).alias("score"))


def simple_rank(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """key, score: minus the document's share of each word's occurrences."""
    hits = inverted_index(docs, key, text).where(F.col("term").isin([w.lower() for w in words]))
    total = hits.groupBy("term").agg(F.sum("tf").alias("all"))
    return hits.join(F.broadcast(total), "term").groupBy(key).agg((-F.sum(F.col("tf") / F.col("all"))).alias("score"))


def binary_round(value: Column, digits: int) -> Column:
    """``value`` to ``digits`` decimals, halves away from zero, by binary arithmetic as DuckDB rounds; ``F.round`` rounds the decimal text."""
    return F.signum(value) * F.floor(F.abs(value) * float(10**digits) + 0.5) / float(10**digits)


def search(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """rank (from 1), key, score to five decimals of the documents that hold any word of ``query``, best first; ties by key.

    A score is rounded to eight decimals, as it is listed elsewhere, and then to five. The rows found are dealt by ranges of their score and numbered there.
    """
    from catchment.sources.writers import numbered

    words = sorted({w for w in re.findall(r"[a-z0-9_]+", query.lower())})
    scored = bm25(docs, key, text, words).select(key, binary_round(binary_round(F.col("score"), 8), 5).alias("score"))
    return numbered(scored, ["score", key], "rank")
