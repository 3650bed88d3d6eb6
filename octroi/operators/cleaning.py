"""Row filters, flags and rule chains over gates and fares."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.functions import text
from octroi.functions.geo import EARTH_RADIUS_KM, haversine
from octroi.functions.pricing import CLASS_RATIOS

NEAR_KM = 8.0
NODE_WORD = "bifurcation"
SNAP_LIMIT_M = 200.0

# Words in accent-free lower-case names, and the flag that each one sets.
NAME_WORDS = {
    "VIRTUAL": ("systeme",),
    "ADMIN_BOUNDARY": ("limite de concession", "frontiere"),
    "BRETELLE": ("bretelle",),
    "BARRIERE": ("barriere",),
    "PEAGE_EN": ("peage en syst",),
}


def fare_endpoints(fares: DataFrame, gates: DataFrame, columns: list[str]) -> DataFrame:
    """Left-joins the given gate columns to both ends, prefixed `from_` and `to_`."""
    for side in ("from", "to"):
        g = gates.select(
            F.col("gare_id").alias(f"{side}_gare_id"), *[F.col(c).alias(f"{side}_{c}") for c in columns]
        )
        fares = fares.join(g, f"{side}_gare_id", "left")
    return fares


def class_prices(fares: DataFrame) -> DataFrame:
    """Classes 2..5 from class 1 by the fixed ratios, where the source carries class 1 only."""
    return fares.withColumns({f"class{k}": F.col("class1") * F.lit(r) for k, r in CLASS_RATIOS.items()})


def zero_price_rows(fares: DataFrame) -> DataFrame:
    return fares.where(F.col("class1") == 0)


def zero_price_disposition(fares: DataFrame, gates: DataFrame) -> DataFrame:
    """Every zero-price row with its disposition and the first rule that fired."""
    g = gates.select("gare_id", "lat", "lon", text.pipe_set("operators").alias("ops"))
    rows = fare_endpoints(zero_price_rows(fares), g, ["lat", "lon", "ops"])
    km = F.coalesce(haversine("from_lat", "from_lon", "to_lat", "to_lon", EARTH_RADIUS_KM), F.col("distance_km"))
    near = F.coalesce(F.col("km") <= NEAR_KM, F.lit(False))
    other_ops = F.col("from_ops").isNotNull() & F.col("to_ops").isNotNull() & (F.col("from_ops") != F.col("to_ops"))
    node = F.lower("from_gare").contains(NODE_WORD) | F.lower("to_gare").contains(NODE_WORD)
    rule = (
        F.when(near & other_ops, "operator_boundary_short_hop")
        .when(node, "structural_node_name")
        .when(near, "short_physical_hop")
        .otherwise("default_no_signal")
    )
    return (
        rows.withColumn("km", km)
        .withColumn("rule", rule)
        .withColumn(
            "disposition",
            F.when(F.col("rule") == "operator_boundary_short_hop", "free_transfer")
            .when(F.col("rule") == "default_no_signal", "drop")
            .otherwise("free_section"),
        )
        .select("row_id", "operator", "from_gare_id", "to_gare_id", "km", "disposition", "rule")
    )


def apply_zero_price(fares: DataFrame, gates: DataFrame) -> DataFrame:
    """Fares without the zero-price rows judged `drop`."""
    dropped = zero_price_disposition(fares, gates).where("disposition = 'drop'").select("row_id")
    return fares.join(dropped, "row_id", "left_anti")


def disposition_tally(classified: DataFrame) -> DataFrame:
    """Counts by operator and over all operators, one column per disposition."""
    kinds = ("drop", "free_section", "free_transfer")
    return (
        classified.rollup("operator")
        .agg(*[F.count_if(F.col("disposition") == k).alias(f"n_{k}") for k in kinds], F.count(F.lit(1)).alias("n_rows"))
        .withColumn("operator", F.coalesce("operator", F.lit("(all)")))
    )


def active_gates(gates: DataFrame, suspects: DataFrame) -> DataFrame:
    """Gates with a snapped place that nobody quarantined."""
    return gates.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).join(
        suspects.select("gare_id"), "gare_id", "left_anti"
    )


def usable_fares(fares: DataFrame) -> DataFrame:
    """Both ends known and not quarantined; a table without the flag column passes whole."""
    known = fares.where(F.col("from_gare_id").isNotNull() & F.col("to_gare_id").isNotNull())
    return known.where(~F.coalesce("quarantined", F.lit(False))) if "quarantined" in fares.columns else known


def fare_skip_reason(fares: DataFrame, gates: DataFrame, suspects: DataFrame) -> DataFrame:
    """Usable fares that cannot become edges, with the reason: no coordinates before suspect before the rest."""
    g = gates.select("gare_id", (F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("placed")).join(
        suspects.select("gare_id", F.lit(True).alias("suspect")), "gare_id", "left"
    )
    rows = fare_endpoints(usable_fares(fares), g, ["placed", "suspect"])
    unplaced = (F.col("from_placed") == False) | (F.col("to_placed") == False)  # noqa: E712
    suspect = F.coalesce("from_suspect", F.lit(False)) | F.coalesce("to_suspect", F.lit(False))
    absent = F.col("from_placed").isNull() | F.col("to_placed").isNull()
    return rows.withColumn(
        "reason",
        F.when(F.coalesce(unplaced, F.lit(False)), "no_coordinates").when(suspect, "suspect").when(absent, "unclustered"),
    ).where("reason IS NOT NULL")


def long_zero_drop(fares: DataFrame, limit_km: float = NEAR_KM) -> DataFrame:
    """Without rows free in all five classes over a long, zero or unknown distance."""
    all_zero = F.lit(True)
    for k in range(1, 6):
        all_zero = all_zero & F.coalesce(F.col(f"class{k}") == 0, F.lit(False))
    km = F.coalesce(F.nullif(F.col("distance_km"), F.lit(0.0)), F.lit(999.0))
    return fares.where(~(all_zero & (F.col("from_gare_id") != F.col("to_gare_id")) & (km > limit_km)))


def endpoint_references(fares: DataFrame) -> DataFrame:
    """(gare_id, fares that touch it); a fare from a gate to itself counts once."""
    ends = F.array_distinct(F.array("from_gare_id", "to_gare_id"))
    return (
        fares.select(F.explode(ends).alias("gare_id"))
        .where("gare_id IS NOT NULL")
        .groupBy("gare_id")
        .agg(F.count(F.lit(1)).alias("affected"))
    )


def coordinateless_gates(gates: DataFrame, fares: DataFrame) -> DataFrame:
    """Gates without a place and how many fares each one strands."""
    lost = gates.where(F.col("lat").isNull() | F.col("lon").isNull())
    return lost.join(endpoint_references(fares), "gare_id", "left").select(
        "gare_id", "canonical_name", "all_routes", "operators", F.coalesce("affected", F.lit(0)).alias("affected")
    )


def snap_suspects(gates: DataFrame, fares: DataFrame, limit_m: float = SNAP_LIMIT_M) -> DataFrame:
    """Gates that snapped too far from a road, with the fares they touch."""
    far = gates.where(F.col("snap_distance_m") > limit_m)
    return far.join(endpoint_references(fares), "gare_id", "left").select(
        "gare_id",
        "canonical_name",
        F.lit("snap_distance_over_200m").alias("reason"),
        F.coalesce("affected", F.lit(0)).alias("affected"),
        F.format_string("snap_distance_m=%.1f", "snap_distance_m").alias("detail"),
    )


def name_flags(name):
    """Flags of the words that a name holds."""

    def held(low):
        found = {flag: reduce(or_, [low.contains(w) for w in words]) for flag, words in NAME_WORDS.items()}
        return F.array_compact(F.array(*[F.when(has, F.lit(flag)) for flag, has in found.items()]))

    # The variable of the list stands for the bare name, which is so worked out once for all words.
    return F.get(F.transform(F.array(text.lower_bare(name)), held), F.lit(0))


def confidence_flags(tier, agreement):
    return F.array_compact(
        F.array(
            F.when(tier.isin("D", "E", "F"), F.lit("LOW_CONFIDENCE")),
            F.when(tier == "O", F.lit("MANUAL_OVERRIDE")),
            F.when(agreement == "conflicted", F.lit("CONFLICTED")),
        )
    )


def non_physical(scores: DataFrame) -> DataFrame:
    """Gates scored invalid that are virtual by name and never an origin."""
    flags = text.pipe_set("flags")
    return scores.where(
        (F.col("verdict") == "LIKELY_INVALID")
        & F.array_contains(flags, "VIRTUAL")
        & F.array_contains(flags, "OD_SINK_ONLY")
    )


def open_system_remap(fares: DataFrame, pseudo: DataFrame) -> DataFrame:
    """A fare against a pseudo gate becomes a flat charge on its real end; two pseudo ends stay as they are."""
    p = pseudo.select("gare_id")
    rows = fares.join(p.select(F.col("gare_id").alias("from_gare_id"), F.lit(True).alias("_pf")), "from_gare_id", "left").join(
        p.select(F.col("gare_id").alias("to_gare_id"), F.lit(True).alias("_pt")), "to_gare_id", "left"
    )
    pf, pt = F.col("_pf").isNotNull(), F.col("_pt").isNotNull()
    both_known = F.col("from_gare_id").isNotNull() & F.col("to_gare_id").isNotNull()
    to_real, from_real = both_known & pf & ~pt, both_known & pt & ~pf
    return rows.withColumns(
        {
            "from_gare_id": F.when(to_real, F.col("to_gare_id")).otherwise(F.col("from_gare_id")),
            "to_gare_id": F.when(from_real, F.col("from_gare_id")).otherwise(F.col("to_gare_id")),
            "from_gare": F.when(to_real, F.col("to_gare")).otherwise(F.col("from_gare")),
            "to_gare": F.when(from_real, F.col("from_gare")).otherwise(F.col("to_gare")),
            "remapped": to_real | from_real,
        }
    ).drop("_pf", "_pt")


def canonical_operators(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """raw_name -> hand alias, else upper case."""
    return names.join(aliases, "raw_name", "left").select(
        "raw_name", F.coalesce("alias", F.upper("raw_name")).alias("canonical_operator")
    )


def distinct_operators(fares: DataFrame, gates: DataFrame) -> DataFrame:
    """Every spelling over the scalar column of fares and the list column of gates."""
    one = fares.where("operator <> ''").select(F.col("operator").alias("raw_name"))
    many = gates.select(F.explode(text.pipe_set("operators")).alias("raw_name"))
    return one.union(many).distinct()


def validate_requests(requests: DataFrame) -> DataFrame:
    """Adds `error`, NULL for a good request: class 1..5; each end has both coordinates or an address."""
    checks = F.when(~F.coalesce(F.col("vehicle_class").between(1, 5), F.lit(False)), "vehicle_class must be 1-5")
    for end in ("origin", "destination"):
        lat, lon, addr = F.col(f"{end}_lat"), F.col(f"{end}_lon"), F.col(f"{end}_address")
        checks = (
            checks.when(lat.isNull() != lon.isNull(), f"{end}: provide both coordinates or neither")
            .when(lat.isNotNull() & addr.isNotNull(), f"{end}: provide coordinates or an address, not both")
            .when(lat.isNull() & addr.isNull(), f"{end}: provide coordinates or an address")
        )
    return requests.withColumn("error", checks)


def request_classes(requests: DataFrame, classes: DataFrame) -> DataFrame:
    """Requests with the costs of their class; an empty table or an unknown class is an error."""
    if classes.isEmpty():
        raise RuntimeError("the class table is empty")
    unknown = requests.join(classes, "vehicle_class", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("requests name a vehicle class without costs")
    return requests.join(classes, "vehicle_class")


def anchor_needed(snaps: DataFrame) -> DataFrame:
    """Whether a gate needs an access anchor, from its toll-free and full snaps.

    Columns: free_dist_m (NULL: nothing near), free_use, free_speed, full_dist_m (NULL: not found).
    """
    bad_use = F.coalesce(F.col("free_use").isin(*BAD_SNAP_USES), F.lit(False))
    needed = (
        F.when(F.col("free_dist_m").isNull(), True)
        .when(F.col("free_dist_m") <= 50.0, bad_use | (F.coalesce("free_speed", F.lit(0)) < 30))
        .when(F.col("full_dist_m").isNull(), False)
        .otherwise(F.col("free_dist_m") > 3.0 * F.col("full_dist_m"))
    )
    return snaps.withColumn("anchor_needed", needed)


# Road uses that are no usable access point.
BAD_SNAP_USES = (
    "track", "driveway", "alley", "parking_aisle", "emergency_access", "drive_through", "golf_cart", "living_street",
)
