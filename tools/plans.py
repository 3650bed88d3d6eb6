"""Runs every registered query on the smallest data and lists plan patterns that would not scale."""

from __future__ import annotations

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import octroi.catalog  # noqa: E402, F401
from octroi.catalog import registry  # noqa: E402
from octroi.session import build_session  # noqa: E402

SMELLS = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "Exchange SinglePartition")


def main():
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("OFF")
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    for key, fn in registry.spark_queries().items():
        t = time.time()
        try:
            df = fn(spark, folder)
            n = len(df.collect())
            plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
            lines = [l.strip(" :+-|") for l in plan.splitlines()]
            found = []
            for s in SMELLS:
                hits = [l for l in lines if s in l]
                if hits:
                    found.append(f"{s} x{len(hits)}")
            windows = sum(1 for l in lines if l.startswith("Window ") or ") Window" in l)
            single = "Exchange SinglePartition" in plan and windows
            print(f"{key:28} rows={n:<6} {time.time() - t:5.1f}s {found or ''} {'WINDOW-SINGLE?' if single else ''}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{key:28} ERROR {str(e)[:300]}", flush=True)


if __name__ == "__main__":
    main()
