"""Merging of route steps into stretches and lists of roads; all results are rows, never one long array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.operators.ranking import row_positions, running_total
from octroi.operators.spatial import ROUTE_BLOCK


def segment_merge(steps: DataFrame) -> DataFrame:
    """Consecutive steps with the same (is_toll, is_access) become one stretch.

    `steps`: route_id, dense 1-based seq, is_toll, is_access. The step before comes by an equi-join
    and stretch numbers by block totals, so a very long route is shared among tasks.
    """
    prev = steps.select(
        "route_id", (F.col("seq") + 1).alias("seq"), F.col("is_toll").alias("_t"), F.col("is_access").alias("_a")
    )
    marked = steps.join(prev, ["route_id", "seq"], "left").withColumn(
        "_new", (F.col("_t").isNull() | (F.col("_t") != F.col("is_toll")) | (F.col("_a") != F.col("is_access"))).cast("double")
    )
    block = F.floor(F.col("seq") / ROUTE_BLOCK)
    numbered = running_total(marked, ["route_id"], "seq", block, "_new", "_b").withColumn(
        "segment_no", (F.col("_b") + F.col("_new")).cast("bigint")
    )
    return numbered.groupBy("route_id", "segment_no", "is_toll", "is_access").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


def road_list(steps: DataFrame) -> DataFrame:
    """(route_id, road_no, road): roads in order, consecutive repeats once, unnamed steps skipped."""
    named = steps.where("road <> ''").select("route_id", "seq", "road")
    block = F.floor(F.col("seq") / ROUTE_BLOCK)
    n = row_positions(named, ["route_id"], ["seq"], block, "pos")
    prev = n.select("route_id", (F.col("pos") + 1).alias("pos"), F.col("road").alias("_p"))
    changed = n.join(prev, ["route_id", "pos"], "left").where("_p IS NULL OR _p <> road").select("route_id", "seq", "road")
    return row_positions(changed, ["route_id"], ["seq"], block, "road_no").select("route_id", "road_no", "road")


def access_toll_roads(steps: DataFrame) -> DataFrame:
    """Distinct toll roads met on access legs."""
    return steps.where("is_toll AND is_access AND road <> ''").select("route_id", "road").distinct()
