"""Ranking, top-k and windows (O-64..O-69e).

A window with no PARTITION BY moves the whole table into one task. For
tables that grow with the data, :func:`global_row_number` and
:func:`global_ranks` compute the same numbers distributed:

1. range-partition on the full sort key and sort inside each partition;
2. position inside the partition from ``monotonically_increasing_id``
   (partition index in the high bits) — a narrow projection, no shuffle;
   the positioned rows are stored once (range bounds come from a sample, so
   a second evaluation could place rows differently);
3. per-partition row counts (one row per partition, a bounded table) give
   each partition's offset; the offsets are broadcast back.

Ties: rank = first row number of the value group, dense_rank = row number
of the value among distinct values; both come from one aggregate per value
joined back (AQE splits a hot value on the join).

The input is stored once. There is one path for every size, and all
numbers are bigint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = [
    "global_row_number", "global_ranks", "window_ranks", "top_n", "top_n_per_group",
    "ranks_within", "sequential_rank", "rank_change",
]

_SHIFT = 33  # monotonically_increasing_id keeps the partition index above bit 33


def _order_exprs(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in order]


def global_row_number(df: DataFrame, order: list[tuple[str, bool]], name: str = "row_number",
                      num_partitions: int | None = None, group: list[str] | None = None) -> DataFrame:
    """Exact ``row_number() OVER ([PARTITION BY group] ORDER BY order)`` without
    a single-task window.

    Rows are range-partitioned on (group, order), so a group with a third of
    the rows is spread over several partitions. ``order`` must be a total
    order within a group (end with a unique key) for a deterministic result.
    Without ``group`` the offset table has one row per partition and is
    broadcast; with ``group`` it has about one row per (partition, group) and
    AQE chooses the join.
    """
    group = list(group or [])
    exprs = _order_exprs([(g, True) for g in group] + order)
    # without a count the session default is used and AQE may merge adjacent
    # ranges; merged partitions are still contiguous and in order
    r = (df.repartitionByRange(num_partitions, *exprs) if num_partitions
         else df.repartitionByRange(*exprs)).sortWithinPartitions(*exprs)
    r = r.withColumn("_mid", F.monotonically_increasing_id()).withColumn(
        "_pid", F.shiftright(F.col("_mid"), _SHIFT))
    r = r.withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid"), _SHIFT))
    # Two evaluations of a range exchange need not place rows alike (bounds
    # come from a sample), so the positions are stored once and both the
    # offsets and the rows read that copy.
    from revlens.session import materialize
    r = materialize(r)
    counts = r.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_start"))
    w = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", *group, "_start", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    if group:
        out = _null_safe_join(r, offs, ["_pid", *group])
    else:
        out = r.join(F.broadcast(offs), "_pid")
    out = out.withColumn(name, (F.col("_off") + F.col("_pos") - F.col("_start") + 1).cast("long"))
    return out.drop("_mid", "_pid", "_pos", "_off", "_start")


def _null_safe_join(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    r = right.select(*[F.col(c).alias(f"_k_{c}") for c in cols],
                     *[c for c in right.columns if c not in cols])
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(r[f"_k_{c}"]) for c in cols])
    return left.join(r, cond, "inner").drop(*[f"_k_{c}" for c in cols])


def global_ranks(df: DataFrame, value: list[tuple[str, bool]], tie: list[tuple[str, bool]],
                 names: dict | None = None, num_partitions: int | None = None,
                 group: list[str] | None = None) -> DataFrame:
    """rank, dense_rank, row_number and percent_rank over ``value`` (ties by
    ``tie``), optionally within ``group``.

    Distributed equivalent of a window (see module notes); a hot group is
    spread over several tasks.
    """
    from revlens.session import materialize
    names = {"rank": "rank", "dense_rank": "dense_rank", "row_number": "row_number",
             "percent_rank": "percent_rank", **(names or {})}
    group = list(group or [])
    vcols = [c for c, _ in value]
    df = materialize(df)  # read by the row numbering and by the totals below
    rn = global_row_number(df, value + tie, "_rn", num_partitions, group)
    groups = rn.groupBy(*group, *vcols).agg(F.min("_rn").alias("_rank"))
    groups = global_row_number(groups, value, "_dense", num_partitions, group)
    out = _null_safe_join(rn, groups, group + vcols)
    out = out.withColumns({
        names["rank"]: F.col("_rank"),
        names["dense_rank"]: F.col("_dense"),
        names["row_number"]: F.col("_rn"),
    })
    if names["percent_rank"]:
        if group:
            sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_total"))
            out = _null_safe_join(out, sizes, group)
            total = F.col("_total")
        else:
            total = df.select(F.count(F.lit(1))).scalar()
        pr = F.when(total <= 1, F.lit(0.0)).otherwise((F.col("_rank") - 1) / (total - 1).cast("double"))
        out = out.withColumn(names["percent_rank"], pr)
    return out.drop("_rn", "_rank", "_dense", "_total")


def window_ranks(df: DataFrame, value: list[tuple[str, bool]], tie: list[tuple[str, bool]],
                 partition: list[str] | None = None, names: dict | None = None) -> DataFrame:
    """O-65/O-68 with Spark windows.

    With ``partition`` the window shuffles on the partition key only. Without
    it, use only for tables with a proven small bound; otherwise
    :func:`global_ranks`.
    """
    names = {"rank": "rank", "dense_rank": "dense_rank", "row_number": "row_number",
             "percent_rank": "percent_rank", **(names or {})}
    w = Window.partitionBy(*(partition or [])).orderBy(*_order_exprs(value))
    wt = Window.partitionBy(*(partition or [])).orderBy(*_order_exprs(value + tie))
    cols = {names["rank"]: F.rank().over(w).cast("long"), names["dense_rank"]: F.dense_rank().over(w).cast("long"),
            names["row_number"]: F.row_number().over(wt).cast("long")}
    if names["percent_rank"]:
        cols[names["percent_rank"]] = F.percent_rank().over(w)
    return df.withColumns(cols)


def top_n(df: DataFrame, order: list[tuple[str, bool]], n: int, where: Column | None = None) -> DataFrame:
    """O-64/O-69d/O-69e: optional filter, then a distributed top-k.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps n
    rows, the driver merges n x tasks rows.
    """
    if where is not None:
        df = df.filter(where)
    return df.orderBy(*_order_exprs(order)).limit(n)


def top_n_per_group(df: DataFrame, group: list[str], order: list[tuple[str, bool]], n: int,
                    name: str = "rank_in_group") -> DataFrame:
    """O-66 for every group at once: ``row_number() <= n`` per group.

    Spark plans a WindowGroupLimit before the shuffle, so each task keeps at
    most n rows per group and a hot group does not flood one reducer.
    """
    w = Window.partitionBy(*group).orderBy(*_order_exprs(order))
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def ranks_within(df: DataFrame, group: list[str], value: list[tuple[str, bool]], tie: list[tuple[str, bool]],
                 prefix: str = "city_", distributed: bool = True) -> DataFrame:
    """O-68: rank, dense_rank, row_number inside each group.

    ``distributed`` (default) spreads a group that holds a large share of the
    rows over several tasks; the window form sorts each group in one task.
    """
    names = {"rank": f"{prefix}rank", "dense_rank": f"{prefix}dense_rank",
             "row_number": f"{prefix}row_number", "percent_rank": None}
    if distributed:
        return global_ranks(df, value, tie, names=names, group=group)
    return window_ranks(df, value, tie, partition=group, names=names)


def sequential_rank(df: DataFrame, score: str, key: str, name: str = "rank",
                    distributed: bool = True) -> DataFrame:
    """O-69a: 1..n after sorting by score desc (ties by key)."""
    order = [(score, False), (key, True)]
    if distributed:
        return global_row_number(df, order, name)
    return df.withColumn(name, F.row_number().over(Window.orderBy(*_order_exprs(order))).cast("long"))


def rank_change(df: DataFrame, old: str, new: str, name: str = "rank_change") -> DataFrame:
    """O-69c: old rank - new rank (positive = moved up)."""
    return df.withColumn(name, (F.col(old) - F.col(new)))
