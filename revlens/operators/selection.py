"""Exact selection by counts: samples, heads and quantiles without a global sort.

Where a cut lies is found from counts that are bounded in size, whatever the
table: a histogram of a seeded hash, the number of rows up to a pivot, or the
counts of cells between two values. Only what lies beside the cut is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import materialize

__all__ = ["sample_rows", "head_rows", "value_counts", "select_ranks", "interpolated"]

HASH_BITS = 16      # bits of the hash told apart in one histogram: 65,536 cells
CELLS = 1024        # cells between two values in one histogram
SMALL = 10_000      # values, hashes or cells that are ordered in one task
PIVOTS = 2000       # rows, about, that stand for a table when a pivot is chosen


def _cut(counts: DataFrame, cell: str, n: int) -> tuple[int, int, int] | None:
    """The cell in which the running count passes n, the rows before it and in it. ``counts``: cell, n; bounded by the caller."""
    before = F.sum("n").over(Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
    at = counts.withColumn("before", F.coalesce(before, F.lit(0))).filter((F.col("before") < n) & (F.col("before") + F.col("n") >= n)).head()
    return None if at is None else (at[cell], at["before"], at["n"])


def sample_rows(df: DataFrame, n: int, key_cols: list[str], seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows without replacement, the same for a seed whatever the partitioning.

    Rows are taken in the order of a seeded hash of ``key_cols``. The hash is
    histogrammed 16 bits at a time until the cell with the cut holds few
    hashes; smaller hashes are taken whole. Rows that share the cut's hash are
    counted per distinct row and shared out, so repeated rows are drawn as
    often as fits. Needs columns that can be grouped (no maps).
    """
    if n <= 0:
        return df.limit(0)
    h = F.xxhash64(*[F.col(c) for c in key_cols], F.lit(seed))
    hashed = df.withColumn("_h", h)
    inside, left, low = hashed, n, None
    for bits in range(64 - HASH_BITS, -1, -HASH_BITS):
        cell = F.shiftright("_h", bits).alias("cell")
        found = _cut(inside.groupBy(cell).agg(F.count(F.lit(1)).alias("n")), "cell", left)
        if found is None:
            return df  # fewer rows than asked for
        low, before, there = found
        left -= before
        inside = hashed.filter(F.shiftright("_h", bits) == low)
        if there <= SMALL:
            break
    at, before, _ = _cut(inside.groupBy("_h").agg(F.count(F.lit(1)).alias("n")), "_h", left)
    left -= before
    whole = hashed.filter(F.col("_h") < at).select(*df.columns)
    tied = hashed.filter(F.col("_h") == at).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    # different rows under one 64-bit hash: next to none, unless the keys repeat with other columns
    order = Window.orderBy(*df.columns).rowsBetween(Window.unboundedPreceding, -1)
    take = F.least(F.col("_n"), F.lit(left) - F.coalesce(F.sum("_n").over(order), F.lit(0)))
    drawn = tied.withColumn("_take", take).filter("_take > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_take"))))
    return whole.unionByName(drawn.select(*df.columns))


def _beside(df: DataFrame, order: list[str], pivot, strict: bool) -> Column:
    """Rows up to (or before) a pivot row, in ascending order with nulls first."""
    types = {f.name: f.dataType for f in df.select(*order).schema.fields}
    row = F.struct(*[F.col(c).alias(c) for c in order])
    at = F.struct(*[F.lit(pivot[c]).cast(types[c]).alias(c) for c in order])
    first = F.col(order[0])
    lead = first.isNull() if pivot[order[0]] is None else first.isNull() | (first <= F.lit(pivot[order[0]]).cast(types[order[0]]))
    return lead & ((row < at) if strict else (row <= at))  # the lead reaches the scan


def head_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first min(n, rows) rows in ascending order (nulls first); rows that tie at the end are drawn by a hash of all columns.

    A plain ``orderBy().limit(n)`` sends n rows of every task to the last one.
    Here pivots from a sample are tried, and the number of rows up to them is
    counted, until few more than n rows are left: what the last task gets
    doesn't depend on the number of tasks.
    """
    if n <= 0:
        return df.limit(0)
    rows, there = df, df.count()
    while there > 4 * n + SMALL:
        pivots = rows.select(*order).sample(min(1.0, PIVOTS / there), seed=there % 1009).orderBy(*order).collect()
        at, found = int(len(pivots) * n / there * 1.5) + 5, None
        while at < len(pivots) and found is None:
            upto = rows.filter(_beside(df, order, pivots[at], strict=False)).count()
            if upto >= n:
                found = upto
            else:
                at = at * 2 + 1
        if found is None:
            continue  # no pivot beyond the cut: another sample is drawn
        if found == there or found > 4 * n + SMALL and pivots[0] == pivots[at]:
            # one value fills what is left
            less = rows.filter(_beside(df, order, pivots[at], strict=True))
            below = less.count()
            if below < n:
                tied = rows.filter(_beside(df, order, pivots[at], strict=False) & ~_beside(df, order, pivots[at], strict=True))
                return less.unionByName(sample_rows(tied, n - below, df.columns))
            rows, there = less, below
            continue
        rows, there = rows.filter(_beside(df, order, pivots[at], strict=False)), found
    return rows.orderBy(*order).limit(n)


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """(v, n): how often each number occurs; nulls and NaN are left out. Stored, with equal values merged in each task."""
    v = F.col(value).cast("double")
    return materialize(df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")))


def select_ranks(counts: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The values at the given ranks (1 is the smallest) of a table of value counts.

    The range between two values is cut into 1,024 cells; counts per cell say
    which one holds a rank, and the cell is cut again until few values are
    left. A step moves no more rows than there are cells.
    """
    out: dict[int, float] = {}
    todo = [(None, None, 0, sorted(set(ranks)))]
    while todo:
        lo, hi, before, wanted = todo.pop()
        inside = counts if lo is None else counts.filter((F.col("v") >= lo) & (F.col("v") <= hi))
        if inside.limit(SMALL + 1).count() <= SMALL:
            at = before
            for v, n in inside.orderBy("v").collect():
                out.update({r: v for r in wanted if at < r <= at + n})
                at += n
            continue
        finite = F.when(F.abs("v") < float("inf"), F.col("v"))
        lo, hi = inside.agg(F.min(finite), F.max(finite)).head()
        cell = F.when(F.col("v") < lo, -1).when(F.col("v") > hi, CELLS).otherwise(
            F.least(F.floor((F.col("v") / 2 - lo / 2) / F.lit(hi / 2 - lo / 2) * CELLS), F.lit(CELLS - 1)))
        cells = (inside.groupBy(cell.cast("int").alias("cell")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                 .orderBy("cell").collect())
        for c in cells:
            if here := [r for r in wanted if before < r <= before + c["n"]]:
                todo.append((c["lo"], c["hi"], before, here))
            before += c["n"]
    return out


def interpolated(counts: DataFrame, probs: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation from a table of value counts; None for an empty one."""
    total = counts.agg(F.sum("n")).head()[0]
    if not total:
        return [None] * len(probs)
    places = [1 + p * (total - 1) for p in probs]
    at = select_ranks(counts, [r for x in places for r in (int(x), min(int(x) + 1, total))])
    return [at[int(x)] if x == int(x) else at[int(x)] + (at[int(x) + 1] - at[int(x)]) * (x - int(x)) for x in places]

