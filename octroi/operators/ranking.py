"""Positions, running totals and order statistics that never put a whole group in one task.

A plain window over a hot group (one operator, route or source holding a third of all rows) sends
that group to a single task. Each helper here cuts a group into value slices first: slices are
counted with a map-side combine, the tiny table of slice totals is scanned in order, and the
window that remains runs inside one slice only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from octroi.session import written

def range_sliced(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds `_slice`, which never falls along `order`, and writes the result.

    Spark's range partitioning finds balanced bounds by sampling; the slice is the partition a
    row landed in. It is stored with the row, so every later step sees the same slices.
    """
    return written(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), "slices")


def row_positions(
    df: DataFrame, keys: list[str], order: list, slice_expr: Column | None = None, out: str = "pos"
) -> DataFrame:
    """1-based row number within `keys` along `order`.

    `slice_expr` must not decrease along `order`; rows of one slice are numbered in one task.
    Without it, slices come from range partitioning.
    """
    sliced = range_sliced(df, [*keys, *order]) if slice_expr is None else df.withColumn("_slice", slice_expr)
    totals = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_rn", F.row_number().over(local))
        .join(offsets, [*keys, "_slice"])
        .withColumn(out, (F.col("_off") + F.col("_rn")).cast("bigint"))
        .drop("_slice", "_rn", "_off")
    )


def running_total(df: DataFrame, keys: list[str], order: str, slice_expr: Column, value: str, out: str) -> DataFrame:
    """Sum of `value` over the rows before this one (exclusive), within `keys` along `order`."""
    sliced = df.withColumn("_slice", slice_expr)
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum(value).alias("_t"))
    w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(w), F.lit(0.0))).drop("_t")
    local = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumn("_loc", F.coalesce(F.sum(value).over(local), F.lit(0.0)))
        .join(offsets, [*keys, "_slice"])
        .withColumn(out, F.col("_off") + F.col("_loc"))
        .drop("_slice", "_loc", "_off")
    )


def order_statistics(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], with_mean: bool = False
) -> DataFrame:
    """Exact values at 1-based ranks per group; `ranks` are expressions over the group size `n`.

    Equal values are counted together before anything is ordered, so a group of copies costs
    one row; these counts are written once and read by every later step. Only the slices that
    hold a wanted rank are scanned.
    """
    df = df.where(F.col(value).isNotNull())
    sliced = range_sliced(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")), [*keys, value])
    if not keys:
        sliced, keys, plain = sliced.withColumn("_all", F.lit(1)), ["_all"], True
    else:
        plain = False
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_t"), F.sum(F.col(value) * F.col("_c")).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    wanted = (
        totals.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0)))
        .withColumn("n", F.sum("_t").over(whole))
        .withColumn("mean", F.sum("_s").over(whole) / F.col("n"))
        .withColumn(
            "_want",
            F.array(*[F.struct(F.lit(k).alias("stat"), r.cast("bigint").alias("rank")) for k, r in ranks.items()]),
        )
        .select(*keys, "_slice", "_off", "_t", "n", "mean", F.explode("_want").alias("_w"))
        .where((F.col("_w.rank") > F.col("_off")) & (F.col("_w.rank") <= F.col("_off") + F.col("_t")))
        .groupBy(*keys, "_slice", "_off", "n", "mean")
        .agg(F.collect_list("_w").alias("_ws"))
    )
    local = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        sliced.join(wanted, [*keys, "_slice"])
        .withColumn("_hi", F.col("_off") + F.sum("_c").over(local))
        .withColumn("_w", F.explode("_ws"))
        .where((F.col("_w.rank") <= F.col("_hi")) & (F.col("_w.rank") > F.col("_hi") - F.col("_c")))
    )
    out = hits.groupBy(*keys, "n", "mean").agg(
        *[F.max(F.when(F.col("_w.stat") == k, F.col(value))).alias(k) for k in ranks]
    )
    out = out if with_mean else out.drop("mean")
    return out.drop("_all") if plain else out


# Rank expressions over the group size.
def lower_middle() -> Column:
    return F.floor((F.col("n") + 1) / 2)


def upper_middle() -> Column:
    """`sorted[n // 2]`, 1-based."""
    return F.floor(F.col("n") / 2) + 1


def indexed_percent(p: float) -> Column:
    """`min(n - 1, int(n * p / 100))`, 1-based, no interpolation."""
    return F.least(F.col("n"), F.floor(F.col("n") * F.lit(float(p)) / 100.0) + 1)


def medians(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Exact interpolating median per group."""
    stats = order_statistics(df, keys, value, {"_lo": lower_middle(), "_hi": upper_middle()})
    return stats.withColumn(out, (F.col("_lo") + F.col("_hi")) / 2.0).drop("_lo", "_hi")


def sampled_rows(df: DataFrame, key: list[str], size: int) -> DataFrame:
    """The `size` rows with the smallest key digest: reproducible on any layout.

    Runs as a distributed top-k, not as a full sort.
    """
    digest = F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in key]))
    return df.withColumn("_d", digest).orderBy("_d", *key).limit(size).drop("_d")


def first_per_group(df: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """First `size` rows per group along a unique numeric `order`.

    Rows are cut down per (group, salt) before the groups meet, so a hot group reaches the last
    window with at most salts x size rows.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(64)))
    rough = Window.partitionBy(*keys, "_salt").orderBy(order)
    fine = Window.partitionBy(*keys).orderBy(order)
    return (
        salted.withColumn("_r", F.row_number().over(rough))
        .where(F.col("_r") <= size)
        .withColumn("sample_no", F.row_number().over(fine))
        .where(F.col("sample_no") <= size)
        .drop("_salt", "_r")
    )
