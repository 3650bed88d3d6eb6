"""Registered queries beside their checking texts. OCTROI_ALL=1 runs every key (several minutes)."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import check  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402

FOLDER = "/root/testdata/sf0.01"
QUICK = [
    "split_pipe_set", "zero_price_disposition", "disposition_tally", "resolve_blank_endpoints", "coverage_by_operator",
    "asymmetry_audit", "corridor_summary", "transfer_pairs", "cluster_summary", "gates_on_route", "isolation_summary",
    "row_rejects", "quarantine_rows", "edges_toll", "graph_stats", "gate_score", "segment_merge", "route_sections",
]
KEYS = list(entry_module.queries()) if os.environ.get("OCTROI_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return check.connect(FOLDER)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_its_check(spark, con, key):
    state, _, _, detail = check.compare(spark, con, key, FOLDER)
    assert state in ("ok", "rows-only"), detail


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
