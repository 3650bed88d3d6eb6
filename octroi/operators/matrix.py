"""Gate points and the travel matrix in long form.

A matrix row is (from_pid, to_pid, tolled_s, tolled_m, free_s, free_m); a NULL cell or an absent
row both mean "no route". Counts over the full n x n square come from arithmetic on n, so the
square itself is never built.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.operators.ranking import row_positions

CELLS = ("tolled_s", "tolled_m", "free_s", "free_m")
ISOLATION_SHARE = 0.9
#: Most matrix rows a task is meant to sort or to group.
TASK_ROWS = 500_000


def gate_points(gates: DataFrame) -> DataFrame:
    """gate -> point key (smallest member id at the same coordinates)."""
    placed = gates.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("gare_id", "lat", "lon")
    keys = placed.groupBy("lat", "lon").agg(F.min("gare_id").alias("pid"))
    return placed.join(keys, ["lat", "lon"]).select("gare_id", "pid")


def physical_clusters(gates: DataFrame) -> DataFrame:
    """One row per place: rank by smallest member id, the place and its member ids."""
    placed = gates.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    clusters = placed.groupBy("lat", "lon").agg(
        F.min("gare_id").alias("pid"), F.count(F.lit(1)).alias("members"), F.array_sort(F.collect_list("gare_id")).alias("gare_ids")
    )
    return row_positions(clusters, [], ["pid"], out="physical_gate_id")


def from_legs(legs: DataFrame, points: DataFrame) -> DataFrame:
    """Raw legs -> matrix rows between known points; a repeated leg keeps the last one (`leg_no`)."""
    ids = points.select("pid").distinct()
    kept = legs.join(ids.withColumnRenamed("pid", "from_pid"), "from_pid", "left_semi").join(
        ids.withColumnRenamed("pid", "to_pid"), "to_pid", "left_semi"
    )
    return kept.groupBy("from_pid", "to_pid").agg(
        *[F.max_by(F.col(c), F.col("leg_no")).cast("float").cast("double").alias(c) for c in CELLS]
    )


def null_counts(matrix: DataFrame, points: DataFrame) -> DataFrame:
    """Cells without a route, per matrix, over all ordered pairs of different points."""
    n = points.agg(F.count_distinct("pid")).scalar()
    return matrix.where("from_pid <> to_pid").agg(
        *[(n * (n - 1) - F.count(c)).cast("bigint").alias(f"missing_{c}") for c in CELLS]
    )


def task_parts(n_rows: int, df: DataFrame) -> int:
    """As many parts as shuffles have, or more, so that no task's rows grow with the matrix."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(n_rows / TASK_ROWS))


def checked(matrix: DataFrame, points: DataFrame) -> DataFrame:
    """The matrix as is, or ValueError: unknown ids, repeated cells or wrong columns."""
    wanted = {"from_pid": "bigint", "to_pid": "bigint", **{c: "float" for c in CELLS}}
    have = dict(matrix.dtypes)
    if any(have.get(c) != t for c, t in wanted.items()):
        raise ValueError(f"matrix columns {have} differ from {wanted}")
    # Cells hardly repeat, so they are dealt by their key at once; combined first, each task would hold its keys twice.
    cells = matrix.select("from_pid", "to_pid").repartition(task_parts(matrix.count(), matrix), "from_pid", "to_pid")
    repeated = cells.groupBy("from_pid", "to_pid").count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError("matrix holds a cell twice")
    ids = points.select("pid").distinct()
    ends = matrix.select(F.col("from_pid").alias("pid")).union(matrix.select("to_pid")).distinct()
    if not ends.join(ids, "pid", "left_anti").isEmpty():
        raise ValueError("matrix refers to points that do not exist")
    return matrix


def _reached(matrix: DataFrame, side: str, cell: str) -> DataFrame:
    return matrix.where("from_pid <> to_pid").groupBy(F.col(side).alias("pid")).agg(F.count(cell).alias("reached"))


def isolated_points(matrix: DataFrame, points: DataFrame, cell: str = "free_m", share: float = ISOLATION_SHARE) -> DataFrame:
    """Points whose row or column lacks at least `share` of its off-diagonal cells."""
    ids = points.select("pid").distinct()
    n = points.agg(F.count_distinct("pid")).scalar()
    out = (
        ids.join(_reached(matrix, "from_pid", cell).withColumnRenamed("reached", "out_n"), "pid", "left")
        .join(_reached(matrix, "to_pid", cell).withColumnRenamed("reached", "in_n"), "pid", "left")
        .withColumn("out_missing", (n - 1 - F.coalesce("out_n", F.lit(0))).cast("bigint"))
        .withColumn("in_missing", (n - 1 - F.coalesce("in_n", F.lit(0))).cast("bigint"))
    )
    limit = (n - 1) * F.lit(share)
    return out.where((F.col("out_missing") >= limit) | (F.col("in_missing") >= limit)).select(
        "pid", "out_missing", "in_missing"
    )


def isolation_summary(matrix: DataFrame, points: DataFrame, cell: str = "free_m", share: float = ISOLATION_SHARE) -> DataFrame:
    """Missing cells in all, isolated points, and missing cells that touch an isolated point."""
    n = points.agg(F.count_distinct("pid")).scalar()
    iso = isolated_points(matrix, points, cell, share).select("pid")
    cells = matrix.where("from_pid <> to_pid").where(F.col(cell).isNotNull()).select("from_pid", "to_pid")
    flagged = (
        cells.join(iso.select(F.col("pid").alias("from_pid"), F.lit(1).alias("a")), "from_pid", "left")
        .join(iso.select(F.col("pid").alias("to_pid"), F.lit(1).alias("b")), "to_pid", "left")
        .agg(
            F.count(F.lit(1)).alias("present"),
            F.count_if(F.col("a").isNotNull() | F.col("b").isNotNull()).alias("present_touching"),
        )
    )
    k = iso.agg(F.count(F.lit(1))).scalar()
    # Cells in the rows and columns of k isolated points: all pairs less those among the others.
    touching = n * (n - 1) - (n - k) * (n - k - 1)
    return flagged.select(
        (n * (n - 1) - F.col("present")).cast("bigint").alias("total_missing"),
        k.cast("bigint").alias("isolated_point_count"),
        (touching - F.col("present_touching")).cast("bigint").alias("missing_touching_isolated"),
    )


def matrix_lookup(pairs: DataFrame, points: DataFrame, matrix: DataFrame) -> DataFrame:
    """Adds from_pid, to_pid and the four cells to (from_gare_id, to_gare_id) rows; all rows kept."""
    a = points.select(F.col("gare_id").alias("from_gare_id"), F.col("pid").alias("from_pid"))
    b = points.select(F.col("gare_id").alias("to_gare_id"), F.col("pid").alias("to_pid"))
    return pairs.join(a, "from_gare_id", "left").join(b, "to_gare_id", "left").join(matrix, ["from_pid", "to_pid"], "left")


def anchor_coords(gates: DataFrame, points: DataFrame, anchors: DataFrame) -> DataFrame:
    """Source and target coordinate per point: exit anchor out, entry anchor in, else the place itself.

    Anchors belong to gates, so they reach a point through its members; the smallest member id
    with an anchor decides.
    """
    place = gates.join(points, "gare_id").groupBy("pid").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    led = (
        anchors.join(points, "gare_id")
        .groupBy("pid")
        .agg(
            *[
                F.min(F.when(F.col("direction") == d, F.struct("gare_id", "anchor_lat", "anchor_lon"))).alias(d)
                for d in ("entry", "exit")
            ]
        )
    )
    return place.join(led, "pid", "left").select(
        "pid",
        F.coalesce("exit.anchor_lat", "lat").alias("source_lat"),
        F.coalesce("exit.anchor_lon", "lon").alias("source_lon"),
        F.coalesce("entry.anchor_lat", "lat").alias("target_lat"),
        F.coalesce("entry.anchor_lon", "lon").alias("target_lon"),
    )
