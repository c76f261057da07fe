"""Keyword search over an inverted index of trigrams (O-22, O-25).

The index is two stored tables: the texts, range-partitioned and sorted by key,
and one row per (trigram, key). Texts are dealt by key into parts of bounded
size, and each part writes the rows of its own trigrams, sorted by trigram: they
are taken from the text once and never shuffled, a trigram that nearly every
text has is spread over all files, and a look-up skips the other trigrams in
each file. Trigrams are kept as 64-bit hashes, which sort as numbers. A
keyword's texts hold all its trigrams; those candidates are looked up by key and
verified on the text, so results equal a scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.columns import contains_literal
from revlens.session import materialize

__all__ = ["TrigramIndex", "build_index", "search"]

GRAM = 3
PART_BYTES = 1 << 24  # text that one task takes trigrams from; stored files pack far more into one split
LISTED = 1000  # candidates whose keys are written into the filter; more are joined


@dataclass(frozen=True)
class TrigramIndex:
    """Stored tables: texts (key, text, ...) and grams (gram, key); gram is the xxhash64 of a trigram."""

    texts: DataFrame
    grams: DataFrame
    key: str
    text: str


def _grams(text: Column) -> Column:
    """The distinct trigrams of a lower-cased text; a look ahead at each place, one pass."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def build_index(df: DataFrame, key: str, text: str) -> TrigramIndex:
    """Index the texts of a table with one row per key; null texts have no trigrams and are never found."""
    texts = materialize(df.repartitionByRange(key).sortWithinPartitions(key))
    size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    grams = texts.repartition(parts, key).select(F.explode(_grams(F.col(text))).alias("gram"), key).select(F.xxhash64("gram").alias("gram"), key)
    return TrigramIndex(texts, materialize(grams.sortWithinPartitions("gram")), key, text)


def candidates(index: TrigramIndex, keyword: str) -> DataFrame | None:
    """Keys of the texts that hold all trigrams of the keyword; None for a keyword without any."""
    low = keyword.lower()
    wanted = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not wanted:
        return None
    hashes = [F.xxhash64(F.lit(gram)) for gram in wanted]  # constants, which reach the scan
    hits = index.grams.filter(F.col("gram").isin(hashes)).groupBy(index.key).agg(F.count(F.lit(1)).alias("_n"))
    return hits.filter(F.col("_n") >= len(wanted)).select(index.key)  # more: another trigram of the text has an equal hash


def search(index: TrigramIndex, keyword: str) -> DataFrame:
    """O-22: rows of ``index.texts`` that hold the keyword (literal, case-insensitive); keywords of fewer than 3 characters scan."""
    found = candidates(index, keyword)
    rows = index.texts
    if found is not None:
        found = materialize(found)
        few = found.limit(LISTED + 1).collect()
        if len(few) <= LISTED:  # the keys reach the scan, which skips what lies between them
            rows = rows.filter(F.col(index.key).isin([r[0] for r in few]))
        else:
            rows = rows.join(found, index.key, "left_semi")
    return rows.filter(contains_literal(index.text, keyword))
