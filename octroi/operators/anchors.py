"""Access anchors: walking outward from a gate to the first point the free network reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.functions.geo import haversine
from octroi.operators.ranking import order_statistics, running_total, upper_middle
from octroi.operators.spatial import ROUTE_BLOCK

WALK_LIMIT_M = 2_000.0
WALK_LIMIT_VERTICES = 100
GOOD_APRON_M = 500.0

WALK = ["gare_id", "direction", "ref_id"]


def anchor_walk(vertices: DataFrame) -> DataFrame:
    """Vertices from the gate outward while the walked distance stays within the limits.

    `vertices`: gare_id, direction, ref_id, seq (0 is the gate), lat, lon. The vertex before comes
    by an equi-join; the walked distance never falls, so the limit cuts a prefix of each walk.
    """
    prev = vertices.select(*WALK, (F.col("seq") + 1).alias("seq"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    steps = (
        vertices.where(f"seq <= {WALK_LIMIT_VERTICES}")
        .join(prev, [*WALK, "seq"])
        .withColumn("step_m", haversine("p_lat", "p_lon", "lat", "lon"))
    )
    walked = running_total(steps, WALK, "seq", F.floor(F.col("seq") / F.lit(ROUTE_BLOCK)), "step_m", "_before")
    return (
        walked.withColumn("walked_m", F.col("_before") + F.col("step_m"))
        .where(F.col("walked_m") <= WALK_LIMIT_M)
        .select(*WALK, "seq", "lat", "lon", "walked_m")
    )


def find_anchor(walk: DataFrame) -> DataFrame:
    """Anchor per (gate, direction) from walked vertices with `reachable`, `apron_m`, `apron_s`.

    Per reference the first reachable vertex counts, unless its apron is missing or too long. The
    first reference with a short apron wins, else the shortest apron.
    """
    first = walk.where("reachable").groupBy(*WALK).agg(
        F.min(F.struct("seq", "lat", "lon", "apron_m", "apron_s")).alias("v")
    )
    ok = first.where(f"v.apron_m IS NOT NULL AND v.apron_m <= {WALK_LIMIT_M}")
    good = F.min(F.when(F.col("v.apron_m") <= GOOD_APRON_M, F.struct("ref_id", "v")))
    short = F.min(F.struct(F.col("v.apron_m").alias("apron_m"), "ref_id", "v"))
    return (
        ok.groupBy("gare_id", "direction")
        .agg(good.alias("g"), short.alias("s"))
        .select("gare_id", "direction", F.coalesce("g.v", "s.v").alias("v"))
        .select(
            "gare_id", "direction", F.col("v.lat").alias("anchor_lat"), F.col("v.lon").alias("anchor_lon"),
            F.col("v.apron_m").alias("apron_distance_m"), F.col("v.apron_s").alias("apron_duration_s"),
        )
    )


def anchor_stats(needed: DataFrame, anchors: DataFrame) -> DataFrame:
    """Needed, found and gapped per direction, and min, upper median and max apron."""
    found = anchors.select("gare_id", "direction", "apron_distance_m")
    base = (
        needed.join(found, ["gare_id", "direction"], "left")
        .groupBy("direction")
        .agg(F.count(F.lit(1)).alias("needed"), F.count("apron_distance_m").alias("found"))
        .withColumn("gapped", F.col("needed") - F.col("found"))
    )
    met = found.join(needed, ["gare_id", "direction"], "left_semi")
    stats = order_statistics(
        met, ["direction"], "apron_distance_m", {"min_m": F.lit(1), "median_m": upper_middle(), "max_m": F.col("n")}
    )
    return base.join(stats.drop("n"), "direction", "left")
