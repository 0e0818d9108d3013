"""Registered queries against their DuckDB oracles on the smallest tables, and the registry itself."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import norm
from runlens.workload.views import TABLES

QUICK = ["phases_per_runner", "losses_per_runner", "cost_pr_counts", "cpu_demand", "lease_usage", "load_gate", "unreachable_clock", "queue_order", "ticket_scarcity", "retention_eviction", "stream_load_gate", "reuse_decisions", "stream_cpu_gate", "stream_device_gate", "stream_lease_silence", "stream_busy_cores", "cpu_gate", "device_gate", "eligible_jobs", "parent_claim_ranking", "read_recent_history",
         "read_journal", "read_store_journal", "read_queue_snapshot", "stream_history_ingest", "store_comparison", "object_state", "orphan_blobs", "manifest_diff", "manifest_hash_audit", "lease_tree_usage", "external_busy",
         "stream_decision_rates", "rescaled_states", "closes_before_finish", "stream_journal", "stream_lease_expiry", "stream_object_state", "stream_runner_states", "stream_no_progress", "read_inventory"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(v) for v in r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(norm(r[i]) for i in order)) for r in cur.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    from runlens.workload import registry

    assert set(registry.QUERIES) == set(registry.ORACLES)
