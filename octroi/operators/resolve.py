"""Resolution of blank fare endpoints by name, place and operator.

Name tables are aggregated per name (and per name and operator) before they meet the endpoints,
so a name shared by very many gates costs one lookup row. Only the distance rule pairs endpoints
with candidates, and there both sides are distinct (name, place) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.functions import text
from octroi.functions.geo import EARTH_RADIUS_KM, haversine
from octroi.session import written

ABS_TOLERANCE_KM = 5.0
REL_TOLERANCE = 0.25
#: Keys over which the questions about one name are dealt.
SALTS = 16

RULES = (
    "canonical_name_exact_match",
    "alias_name_match",
    "coordinate_proximity_disambiguation",
    "operator_tag_disambiguation",
)


def gate_names(gates: DataFrame) -> DataFrame:
    """(name, kind, gare_id): canonical and alias names in matching form, distinct per gate and kind."""
    canonical = gates.select(
        text.normalise_name("canonical_name").alias("name"), F.lit("canonical").alias("kind"), "gare_id"
    )
    alias = gates.select(F.explode(text.pipe_set("all_names")).alias("raw"), "gare_id").select(
        text.normalise_name("raw").alias("name"), F.lit("alias").alias("kind"), "gare_id"
    )
    return canonical.unionByName(alias).distinct()


def name_candidates(gates: DataFrame) -> DataFrame:
    """(name, gare_id): canonical or alias, each gate once per name."""
    return gate_names(gates).select("name", "gare_id").distinct()


def blank_endpoints(fares: DataFrame) -> DataFrame:
    """One row per blank end: the name typed there and the gate known at the other end."""

    def side(end: str, other: str) -> DataFrame:
        return fares.where(F.col(f"{end}_gare_id").isNull()).select(
            "row_id",
            F.lit(end).alias("endpoint"),
            "operator",
            F.col(f"{end}_gare").alias("raw_name"),
            text.normalise_name(f"{end}_gare").alias("name"),
            F.col(f"{other}_gare_id").alias("known_gare_id"),
            "distance_km",
            "class1",
        )

    return side("to", "from").unionByName(side("from", "to"))


def _single(names: DataFrame, keys: list[str], n: str, gid: str) -> DataFrame:
    return names.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), F.min("gare_id").alias(gid))


def match_canonical(ends: DataFrame, gates: DataFrame) -> DataFrame:
    """Endpoints whose name is the canonical name of exactly one gate."""
    one = _single(gate_names(gates).where("kind = 'canonical'"), ["name"], "n", "matched_gare_id").where("n = 1")
    return ends.join(one.drop("n"), "name").select("row_id", "endpoint", "matched_gare_id")


def match_alias(ends: DataFrame, gates: DataFrame) -> DataFrame:
    """No canonical hit at all and exactly one gate that lists the alias."""
    names = gate_names(gates)
    canonical = names.where("kind = 'canonical'").select("name").distinct()
    one = _single(names.where("kind = 'alias'"), ["name"], "n", "matched_gare_id").where("n = 1").drop("n")
    return ends.join(canonical, "name", "left_anti").join(one, "name").select("row_id", "endpoint", "matched_gare_id")


NEAR_KEY = ["name", "known_gare_id", "distance_km"]


def proximity_hits(ends: DataFrame, gates: DataFrame) -> DataFrame:
    """(name, known gate, distance) -> the candidate whose distance fits clearly better than the next.

    A question meets its candidates twice: once for the least error, once to count the errors that come near it.
    Both are sums over primitives per question, combined before anything is exchanged, so a name that very many
    gates share costs time and no memory; its questions are dealt over salts.
    """
    places = gates.select("gare_id", "lat", "lon")
    cand = (
        name_candidates(gates)
        .join(places.where("lat IS NOT NULL AND lon IS NOT NULL"), "gare_id")
        # Two gates at one place tie with each other: their number says as much as all of them.
        .groupBy("name", "lat", "lon")
        .agg(F.min("gare_id").alias("gare_id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    known = places.select(
        F.col("gare_id").alias("known_gare_id"), F.col("lat").alias("k_lat"), F.col("lon").alias("k_lon")
    )
    key = NEAR_KEY
    asked = written(
        ends.where("distance_km IS NOT NULL")
        .select(*key)
        .distinct()
        .join(known, "known_gare_id")
        .where("k_lat IS NOT NULL AND k_lon IS NOT NULL")
        .withColumn("_salt", F.pmod(F.xxhash64("known_gare_id", "distance_km"), F.lit(SALTS)).cast("int")),
        "asked-places",
    )
    cand = written(cand, "named-places")
    err = F.abs(haversine("k_lat", "k_lon", "lat", "lon", EARTH_RADIUS_KM) - F.col("distance_km"))
    tol = F.greatest(F.lit(ABS_TOLERANCE_KM), F.col("distance_km") * REL_TOLERANCE)
    least = asked.join(cand, ["name", "_salt"]).groupBy(*key).agg(F.min(err).alias("best"), F.sum("copies").alias("n"))
    fits = least.where((F.col("best") <= tol) & (F.col("n") > 1)).drop("n")
    # `second - best > tol` as the rule says it: the same arithmetic for every candidate but the best itself.
    again = asked.join(fits, key).join(cand, ["name", "_salt"]).withColumn("err", err).where(~(F.col("err") - F.col("best") > tol))
    return (
        again.groupBy(*key)
        .agg(F.sum("copies").alias("near"), F.min("gare_id").alias("matched_gare_id"))
        .where("near = 1")
        .select(*key, "matched_gare_id")
    )


def match_proximity(ends: DataFrame, gates: DataFrame) -> DataFrame:
    """Among two or more placed candidates, the one whose distance fits clearly better than the next."""
    return ends.join(proximity_hits(ends, gates), NEAR_KEY).select("row_id", "endpoint", "matched_gare_id")


def match_operator_tag(ends: DataFrame, gates: DataFrame) -> DataFrame:
    """Among two or more candidates, the only one that carries the row's operator."""
    cand = name_candidates(gates)
    several = cand.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("name")
    tags = gates.select("gare_id", F.explode(text.pipe_set("operators")).alias("operator"))
    one = _single(cand.join(tags, "gare_id"), ["name", "operator"], "n", "matched_gare_id").where("n = 1").drop("n")
    return (
        ends.join(one, ["name", "operator"]).join(several, "name", "left_semi").select("row_id", "endpoint", "matched_gare_id")
    )


def name_lookup(gates: DataFrame) -> DataFrame:
    """Per name: the only canonical gate, else the only alias gate where no canonical name matches; candidate count."""
    per_gate = gate_names(gates).groupBy("name", "gare_id").agg(
        F.max(F.col("kind") == "canonical").alias("is_canonical"), F.max(F.col("kind") == "alias").alias("is_alias")
    )
    stats = per_gate.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if("is_canonical").alias("nc"),
        F.min(F.when(F.col("is_canonical"), F.col("gare_id"))).alias("c_id"),
        F.count_if("is_alias").alias("na"),
        F.min(F.when(F.col("is_alias"), F.col("gare_id"))).alias("a_id"),
    )
    return stats.select(
        "name",
        "n_candidates",
        F.when(F.col("nc") == 1, F.col("c_id")).alias("canonical_id"),
        F.when((F.col("nc") == 0) & (F.col("na") == 1), F.col("a_id")).alias("alias_id"),
    )


def operator_lookup(gates: DataFrame) -> DataFrame:
    """(name, operator) -> the only candidate carrying the operator."""
    tags = gates.select("gare_id", F.explode(text.pipe_set("operators")).alias("operator"))
    return _single(name_candidates(gates).join(tags, "gare_id"), ["name", "operator"], "n", "tag_id").where("n = 1").drop("n")


def resolve_blank_endpoints(fares: DataFrame, gates: DataFrame) -> DataFrame:
    """Every blank endpoint with the first rule that matched, or dropped.

    The rules read three lookup tables, so the endpoints are scanned twice: once to look up and
    once to build the distance rule's distinct questions.
    """
    ends = blank_endpoints(fares)
    near = proximity_hits(ends, gates).withColumnRenamed("matched_gare_id", "near_id")
    tag = F.when(F.col("n_candidates") >= 2, F.col("tag_id"))
    ids = dict(zip(RULES, (F.col("canonical_id"), F.col("alias_id"), F.col("near_id"), tag)))
    rule = F.coalesce(*[F.when(c.isNotNull(), F.lit(r)) for r, c in ids.items()], F.lit("default_unresolved"))
    return (
        ends.join(name_lookup(gates), "name", "left")
        .join(operator_lookup(gates), ["name", "operator"], "left")
        .join(near, NEAR_KEY, "left")
        .withColumn("rule", rule)
        .withColumn("matched_gare_id", F.coalesce(*ids.values()))
        .withColumn("disposition", F.when(F.col("matched_gare_id").isNull(), "drop").otherwise("matched"))
        .select(
            "row_id", "endpoint", "operator", "raw_name", "known_gare_id", "distance_km", "class1",
            "rule", "disposition", "matched_gare_id",
        )
    )


def apply_rematch(fares: DataFrame, resolved: DataFrame) -> DataFrame:
    """Fares with matched ids filled in; unresolved ends stay NULL."""
    found = resolved.groupBy("row_id").agg(
        *[
            F.max(F.when(F.col("endpoint") == e, F.col("matched_gare_id"))).alias(f"_{e}")
            for e in ("from", "to")
        ]
    )
    return (
        fares.join(found, "row_id", "left")
        .withColumn("from_gare_id", F.coalesce("from_gare_id", "_from"))
        .withColumn("to_gare_id", F.coalesce("to_gare_id", "_to"))
        .drop("_from", "_to")
    )


def rate_stats(resolved: DataFrame) -> DataFrame:
    """Price per km over matched rows with a price and a distance, in cents."""
    rate = F.col("class1") / F.col("distance_km") * 100.0
    return resolved.where("disposition = 'matched' AND class1 <> 0 AND distance_km <> 0").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(rate).alias("min_cents"), F.max(rate).alias("max_cents"), F.avg(rate).alias("mean_cents"),
    )
