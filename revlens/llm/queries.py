"""The numbered queries over the driver's tables; SQL twins are in :mod:`revlens.llm.oracle`."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import decontaminate, html, jaccard, langid, mixing, quality, sharding, simhash, spelling, substring, tokens, warc, whitening
from revlens.llm.store import ship, stored

SHARDS = {f"shard-{i:03d}": 1 for i in range(64)}
TARGET = mixing.Target(max_repeat=1.25)
MAX_TOKENS = 512
TYPO_EVERY = 31


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as read back from the bundles it was written to."""
    index = warc.write_bundles(_table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a similarity of 0.9 or more."""
    return jaccard.similar_sets(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    rows = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS).select("doc_id", "slot", "shard")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    counts = tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter, by CRC, is held out from learning."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    found = langid.identify(_table(spark, sf_dir, "documents"), learn=fold != 2)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is taken, once for each time."""
    return mixing.mix(_table(spark, sf_dir, "documents"), TARGET).select("doc_id", "source", "block", "position_key")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier document's windows of 13, and a digest of what is kept."""
    rows = substring.drop_repeats(_table(spark, sf_dir, "documents"), target=13)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, bits=3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on up to 16 components; a deviation that no bigint holds is null here, a decimal in the operator."""
    rows = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=16)
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of 7 letters or more with its form and root; one run in 31 is misspelt on purpose."""
    words = spelling.vocabulary(_table(spark, sf_dir, "documents"), min_len=7, min_count=2, drop_every=TYPO_EVERY)
    return spelling.variants(stored(words, "vocabulary"), factor=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_warc, op3_jaccard, op4_quality, op5_sharding, op6_tokens, op7_html, op8_langid, op9_mixing, op10_substring,
                            op11_simhash, op12_whitening, op13_spelling)}
