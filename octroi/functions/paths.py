"""Expressions over a route's path: an array of step codes `gate * 8 + kind`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRY, TOLL = 5, 4


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gates_of(path) -> Column:
    return F.transform(_c(path), lambda s: F.floor(s / 8).cast("bigint"))


def gate_chain(path) -> Column:
    """Gates in order, consecutive repeats once."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(
        gates_of(path), empty,
        lambda acc, g: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == g), acc).otherwise(F.concat(acc, F.array(g))),
    )


def toll_legs(path) -> Column:
    """array<struct<pos, from_gare_id, to_gare_id>> of the toll steps."""
    p = _c(path)
    pairs = F.transform(
        p,
        lambda s, i: F.struct(
            i.alias("pos"), F.pmod(s, F.lit(8)).alias("kind"),
            F.floor(F.try_element_at(p, F.greatest(i, F.lit(1))) / 8).cast("bigint").alias("from_gare_id"),
            F.floor(s / 8).cast("bigint").alias("to_gare_id"),
        ),
    )
    return F.filter(pairs, lambda v: v["kind"] == TOLL)


def toll_hops(path) -> Column:
    return F.size(F.filter(_c(path), lambda s: F.pmod(s, F.lit(8)) == TOLL))


def same_operator_split(operators) -> Column:
    """Some operator on two or more toll legs."""
    ops = F.filter(_c(operators), lambda o: o.isNotNull() & (o != ""))
    return F.size(ops) > F.size(F.array_distinct(ops))


def leg_indices(chain, ends) -> Column:
    """For each leg end, its first place in the chain at or after the place behind the last one found."""
    chain, ends = _c(chain), _c(ends)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(acc, g):
        # array_position over the tail of the chain; 0 when the gate does not come again.
        tail = F.slice(chain, acc["at"] + 1, F.greatest(F.size(chain) - acc["at"], F.lit(0)))
        hit = F.array_position(tail, g).cast("int")
        place = acc["at"] + hit - 1
        return F.when(
            hit > 0, F.struct((place + 1).alias("at"), F.concat(acc["found"], F.array(place)).alias("found"))
        ).otherwise(acc)

    return F.aggregate(ends, start, step, lambda acc: acc["found"])


def priced_gates(legs) -> Column:
    """Ordered distinct ends of priced legs."""
    return F.array_distinct(F.flatten(F.transform(_c(legs), lambda v: F.array(v["from_gare_id"], v["to_gare_id"]))))
