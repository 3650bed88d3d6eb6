"""The batch build as one chain of frames: cleaned fares, suspects and the one-row summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.operators import audits, cleaning, resolve
from octroi.operators.matrix import gate_points
from octroi.session import written
from octroi.sources.sinks import seed_flat_fee


@dataclass
class Build:
    fares: DataFrame
    gates: DataFrame
    suspects: DataFrame
    overrides: DataFrame
    summary: DataFrame


def _counted(df: DataFrame, **named) -> DataFrame:
    return df.agg(*[c.alias(k) for k, c in named.items()])


def build(fares: DataFrame, gates: DataFrame, matrix: DataFrame, scores: DataFrame, charges: DataFrame, anchors: DataFrame) -> Build:
    """Zero prices, blank ends, pseudo gates, distance and snap quarantine, flat fees: in this order.

    The remap runs before the quarantine so flat charges are not judged as journeys; flat-fee gates
    come last because their places are known. Nothing is updated in place: every step is a join on
    row_id or gare_id.
    """
    audits.require_no_violations(fares, gates)
    classified = written(cleaning.zero_price_disposition(fares, gates), "zero-classified")
    resolved = written(resolve.resolve_blank_endpoints(fares, gates), "resolved")
    dropped = classified.where("disposition = 'drop'").select("row_id")
    kept = resolve.apply_rematch(fares.join(dropped, "row_id", "left_anti"), resolved)
    pseudo = cleaning.non_physical(scores)
    remapped = cleaning.open_system_remap(kept, pseudo)

    whole = resolve.apply_rematch(fares, resolved)
    checks = written(audits.distance_checks(whole, gate_points(gates), matrix), "checks")
    votes = audits.gate_error_vote(checks)
    judged = audits.quarantine_rows(remapped, audits.row_rejects(checks))

    lost = cleaning.coordinateless_gates(gates, fares).select(
        "gare_id", "canonical_name", F.lit("no_coordinates").alias("reason"), "affected", F.lit("not geocodable").alias("detail")
    )
    far = cleaning.snap_suspects(gates, fares)
    first = lost.unionByName(far.join(lost.select("gare_id"), "gare_id", "left_anti"))
    suspects = written(audits.quarantine_gates(first, votes, scores, gates), "suspects")

    priced = judged if "class2" in judged.columns else cleaning.class_prices(judged)
    empty = fares.sparkSession.createDataFrame(
        [], "corridor string, vehicle_class int, flat_fee_eur double, operator string, is_conjecture boolean"
    )
    all_gates, all_fares, overrides = seed_flat_fee(charges, gates, priced, empty)
    all_fares = written(all_fares, "national-fares")
    active = cleaning.active_gates(all_gates, suspects)

    parts = [
        _counted(gates, raw_gate_count=F.count(F.lit(1))),
        _counted(fares, raw_fare_count=F.count(F.lit(1))),
        _counted(
            all_fares, final_fare_count=F.count(F.lit(1)), open_system_remapped=F.count_if("remapped"),
            quarantined_fare_count=F.count_if("quarantined"),
        ),
        _counted(active, active_gate_count=F.count(F.lit(1))),
        _counted(
            suspects, suspect_gate_count=F.count(F.lit(1)),
            distance_suspect_count=F.count_if(F.col("reason") == audits.SUSPECT_REASON),
        ),
        _counted(classified, **{f"zero_{k}": F.count_if(F.col("disposition") == k) for k in ("drop", "free_section", "free_transfer")}),
        _counted(resolved, rematch_matched=F.count_if(F.col("disposition") == "matched"), rematch_dropped=F.count_if(F.col("disposition") == "drop")),
        _counted(lost, coordinateless_count=F.count(F.lit(1))),
        _counted(far, snap_suspect_count=F.count(F.lit(1))),
        _counted(anchors, access_anchor_count=F.count(F.lit(1))),
    ]
    # Every part is one aggregate row; the columns are laid side by side as scalar subqueries.
    summary = parts[0].withColumns({c: p.select(c).scalar() for p in parts[1:] for c in p.columns})
    return Build(all_fares, all_gates, suspects, overrides, summary)
