"""Reproducible samples of city pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.functions.geo import EARTH_RADIUS_KM, haversine
from octroi.operators.spatial import cell_centre, ring_join, with_globe_cell
from octroi.session import written

BAND_KM = (350.0, 450.0)
PAIRS = 25
#: Each level has a quarter of the last one's digests, down to 4 ** -19 of them.
LEVELS = 20


def sure_pairs(placed: DataFrame, lo: float, hi: float, step: float) -> DataFrame:
    """One row: for each level at least how many pairs of places of that level lie in the band.

    Cells are counted, not places: two cells whose centres, with the farthest place of each, stay within the
    band hold only pairs that do. There are only so many cells, however many places.
    """
    centre = lambda df: df.withColumns(dict(zip(("c_lat", "c_lon"), cell_centre(step))))
    spread = haversine("c_lat", "c_lon", "lat", "lon", EARTH_RADIUS_KM)
    counts = [F.count_if(F.col("level") >= k).cast("double").alias(f"n{k}") for k in range(LEVELS)]
    cells = centre(with_globe_cell(placed, "lat", "lon", step)).withColumn("away", spread)
    cells = written(cells.groupBy("band", "cell", "c_lat", "c_lon").agg(F.max("away").alias("away"), *counts), "place-cells")
    side = lambda p: cells.select(*[F.col(c).alias(f"{p}_{c.removeprefix('c_')}") for c in cells.columns])
    met = ring_join(side("a"), side("b"), lo, hi, step, EARTH_RADIUS_KM)
    reach = F.col("a_away") + F.col("b_away") + 1e-6
    met = met.where((F.col("dist") - reach >= lo) & (F.col("dist") + reach <= hi) & ~((F.col("a_band") == F.col("b_band")) & (F.col("a_cell") == F.col("b_cell"))))
    # each pair of cells is met from both ends
    return met.agg(*[F.coalesce(F.sum(F.col(f"a_n{k}") * F.col(f"b_n{k}")) / 2, F.lit(0.0)).alias(f"n{k}") for k in range(LEVELS)])


def city_pair_sample(places: DataFrame, size: int = PAIRS, band: tuple[float, float] = BAND_KM) -> DataFrame:
    """`size` unordered pairs inside a distance band, in the order of the two places' digests.

    Pairs are ordered by their first place, so only places of small digests can be first. How small follows from
    counts: the fewest places, a quarter of them level by level, among which alone there are surely enough pairs. They
    meet all others in the cells that their ring crosses, and the first pairs are a distributed top-k.
    """
    lo, hi = band
    step = math.degrees((hi - lo) / 4 / EARTH_RADIUS_KM)
    d = places.where("lat is not null and lon is not null").select("place_id", "lat", "lon", F.md5(F.col("place_id").cast("string")).alias("h"))
    digits = F.conv(F.substring("h", 1, 12), 16, 10).cast("bigint")  # 48 bits
    d = written(d.withColumn("level", F.least(F.lit(LEVELS - 1), F.floor((48 - F.log2(digits + 1.0)) / 2)).cast("int")), "sample-places")
    enough = sure_pairs(d, lo, hi, step).select(F.coalesce(*[F.when(F.col(f"n{k}") >= size, F.lit(k)) for k in range(LEVELS - 1, 0, -1)], F.lit(0)).alias("k"))
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("place_id", "lat", "lon", "h")])
    first = d.where(F.col("level") >= enough.scalar())
    pairs = ring_join(side(first, "a"), side(d, "b"), lo, hi, step, EARTH_RADIUS_KM).where("a_place_id < b_place_id")
    return pairs.orderBy("a_h", "b_h", "a_place_id", "b_place_id").limit(size).select("a_place_id", "b_place_id", F.col("dist").alias("km"))
