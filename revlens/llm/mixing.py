"""Operator 9 [native]: temperature mixing of sources to target weights.

Source token shares p are raised to an exponent t and normalised. t = 1 keeps
the shares, t = 0 makes all sources equal. The least t in [0, 1] is bisected
whose weights meet the target: an entropy of at most so many nats, and no
source repeated more than so many times for the budget. (Both fall with t.)

The weights are realised as block permutations: a source's quota of tokens is
filled with whole permutations of its documents, blocks 0, 1, ..., and then
with the beginning of the next one. In each block the order is a keyed hash of
the document id. The block that is cut is found by token sums over hash
buckets, and only the one bucket with the cut is put in order, so a source
that holds a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.store import stored

BUCKETS_HEX = 3  # hash digits of a bucket: 16^3 buckets of a source
STEPS = 30       # bisection steps: the exponent to about 1e-9
SPACE = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Target:
    """budget: tokens of the mix as a multiple of the input's; None: no such limit."""

    max_repeat: float | None = None
    entropy: float | None = None
    budget: float = 1.0


def n_tokens(text: Column) -> Column:
    """Words of a text (null: none); the token measure of the shares."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).otherwise(0).cast("long")


def _power(t: float) -> Column:
    return F.pow(F.col("share"), F.lit(float(t)))


def exponent(sources: DataFrame, target: Target) -> float:
    """The least exponent that meets the target, by bisection; 1 if none does.

    Each step is an aggregate over the table of sources (share, tokens) that
    returns one row.
    """
    def met(t: float) -> bool:
        z = sources.agg(F.sum(_power(t))).first()[0]
        weight = _power(t) / F.lit(z)
        row = sources.agg((-F.sum(weight * F.log(weight))).alias("entropy"), F.max(weight / F.col("share") * F.lit(target.budget)).alias("repeat")).first()
        return (target.entropy is None or row["entropy"] <= target.entropy + 1e-12) and (target.max_repeat is None or row["repeat"] <= target.max_repeat + 1e-12)

    if met(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        if met(mid):
            high = mid
        else:
            low = mid
    return high


def order_key(block: Column) -> Column:
    """Place of a document in a block's permutation."""
    return F.md5(F.concat_ws(":", block.cast("string"), F.col("mix_id")).cast("binary"))


def plan(narrow: DataFrame, target: Target) -> DataFrame:
    """(source_key, weight, quota, full, last_key): whole blocks, and the last key of the block that is cut (null: it is empty).

    ``narrow`` has source_key, mix_id and tokens.
    """
    sums = narrow.groupBy("source_key").agg(F.sum("tokens").alias("total")).filter("total > 0")
    sources = stored(sums.crossJoin(F.broadcast(sums.agg(F.sum("total").alias("all"))))  # one row: the sum
                     .select("source_key", "total", "all", (F.col("total") / F.col("all")).alias("share")), "sources")
    if sources.isEmpty():
        return sources.select("source_key", *[F.lit(None).cast(t).alias(c) for c, t in (("weight", "double"), ("quota", "long"), ("full", "long"), ("last_key", "string"))])
    t = exponent(sources, target)
    z = sources.agg(F.sum(_power(t))).first()[0]
    weight = _power(t) / F.lit(z)
    quota = F.floor(weight * F.col("all") * F.lit(target.budget) + F.lit(1e-6))
    quotas = (sources.withColumn("weight", weight).withColumn("quota", quota).withColumn("full", F.expr("quota div total"))
              .withColumn("rest", F.col("quota") - F.col("full") * F.col("total")).select("source_key", "weight", "quota", "full", "rest"))
    keyed = narrow.join(quotas.filter("rest > 0"), "source_key").withColumn("key", order_key(F.col("full"))).withColumn("bucket", F.substring("key", 1, BUCKETS_HEX))
    by_bucket = keyed.groupBy("source_key", "rest", "bucket").agg(F.sum("tokens").alias("tokens"))
    up_to = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 16^3 rows a source
    cut = (by_bucket.withColumn("before", F.coalesce(F.sum("tokens").over(up_to), F.lit(0)))
           .filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest"))).select("source_key", "bucket", "before"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    last = (keyed.join(cut, ["source_key", "bucket"]).withColumn("so_far", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
            .filter("so_far < rest").groupBy("source_key").agg(F.max("key").alias("last_key")))
    return stored(quotas.join(last, "source_key", "left").select("source_key", "weight", "quota", "full", "last_key"), "mix")


def mix(docs: DataFrame, target: Target, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` mixed: a row for each time a document is taken, with ``block`` and ``position_key``.

    Ordering a source by (block, position_key) gives its sequence of
    permutations. A document is in the cut block if the tokens before it are
    fewer than the rest of the quota, so a source exceeds its quota by less
    than one document.

    Nulls and edges: a null source is a source of its own; a row without an id
    is ordered by its text's hash; a text without words goes with its place in
    the order and weighs nothing; repeated rows share a place and go or stay
    together; a source without any token, and an empty table, give no row;
    columns of any name are kept, but ``block`` and ``position_key``, which are
    replaced.
    """
    row = F.struct(*[c for c in docs.columns if c not in ("block", "position_key")]).alias("row")  # own columns stay inside, whatever their names
    own = docs.select(
        row, n_tokens(F.col(text_col)).alias("tokens"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-")).alias("source_key"),
        F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))).alias("mix_id"))
    narrow = stored(own.select("source_key", "mix_id", "tokens"), "tokens")
    chosen = plan(narrow, target).select("source_key", "full", "last_key")
    taken = own.drop("tokens").join(chosen, "source_key").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full")))).withColumn("position_key", order_key(F.col("block")))
    return (taken.filter((F.col("block") < F.col("full")) | (F.col("position_key") <= F.col("last_key")))
            .select("row.*", "block", "position_key"))
