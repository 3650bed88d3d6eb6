import random

from pyspark.sql import functions as F

from octroi.operators import blocks
from octroi.operators.relax import relax

KEYS, FACTORS = ["origin_id", "vehicle_class", "bundle"], ["k_toll", "k_m", "k_s"]


def test_blocks_find_what_the_join_of_frontier_and_moves_finds(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_MOVES", 150)
    rng, inf = random.Random(5), float("inf")
    some = lambda top: None if rng.random() < 0.05 else float(rng.randrange(1, top))
    rows = [(rng.randrange(40), rng.randrange(40), k, some(90), some(50), [float(rng.randrange(9)), rng.choice([None, 2.5])]) for _ in range(300) for k in (1, 3)]
    moves = spark.createDataFrame(rows, "node bigint, to_node bigint, kind int, e_s double, e_m double, tolls array<double>")
    wide = [(o, c, b, *(float(v) for v in ((0, 0, 1, 1, 0.5, 2) if b else (1, 0.1, 0.7, 1, 0.1, 0.05)))) for o in (0, 1, 2) for c in (1, 2) for b in (0, 1)]
    lanes = [f"{f}_{k}" for k in (0, 1) for f in FACTORS]
    context = spark.createDataFrame(wide, "origin_id bigint, vehicle_class int, bundle int, " + ", ".join(f"{c} double" for c in lanes))
    seeds = context.select(*KEYS, F.col("origin_id").alias("node"), F.lit(0.0).alias("c0"), F.when(F.col("bundle") == 0, F.col("origin_id") * 3.5).alias("c1"))
    toll = F.coalesce(F.element_at("tolls", F.col("vehicle_class").cast("int")), F.lit(inf))
    cost = lambda k: F.col(f"k_toll_{k}") * toll + F.col(f"k_m_{k}") * F.coalesce("e_m", F.lit(inf)) + F.col(f"k_s_{k}") * F.coalesce("e_s", F.lit(inf))
    step = lambda k: F.when(toll < inf, cost(k)).otherwise(inf)
    for limit in (None, lambda improved, due: context.select(*KEYS, F.lit(60.0).alias("b0"), F.when(F.col("bundle") == 1, 40.0).alias("b1"))):
        dealt = blocks.Blocks(KEYS, 2, FACTORS, len(rows), 40, context)
        assert dealt.parts > 1 and dealt.slices > 1
        want, got = (
            sorted(map(tuple, relax(seeds, moves, KEYS, step, 2, context=context, limit=limit, fan_rows=10, blocks=b).collect()), key=repr) for b in (None, dealt)
        )
        assert got == want and len(want) > 300
