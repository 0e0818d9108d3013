"""Agents of a kind: one of them meets the tickets, all of them get its answer."""

from runlens.plans import queue as pq

TICKET = "ticket_id long, snapshot long, state string, priority int, created_ms long, requires_tags array<string>, repo string, avoid_tags array<string>, weight double"
AGENT = "agent string, tags array<string>, allowed_repos array<string>, max_claims int, room double"


def test_agents_of_a_kind_share_one_ranking(spark):
    tickets = spark.createDataFrame([(i, i % 2, "queued", i % 10, i, ["linux"], "foo", [], 1.0 + i % 3) for i in range(60)], TICKET)
    rows = [(f"a{i}", ["linux", "gpu"], ["foo"], 1, 8.0) for i in range(40)] + [("b", ["linux"], ["*"], 0, 1.0), ("c", ["mac"], ["foo"], 1, 8.0)]
    agents = spark.createDataFrame(rows, AGENT)
    alike, members = pq.agent_kinds(agents, "room")
    assert alike.count() == 3 and members.count() == 42
    got = {(r.snapshot, r.agent): r.ticket_id for r in pq.claim_ranking(tickets, agents, 1_000_000, 0, "room").collect()}
    assert set(got) == {(s, a) for s in (0, 1) for a in [f"a{i}" for i in range(40)] + ["b"]}
    assert len({got[0, f"a{i}"] for i in range(40)}) == 1
    assert [r.scarcity for r in pq.scarcity(tickets, agents).collect()] == [40]


def test_scarcity_counts_an_agent_without_a_name_and_rows_of_one_name_together(spark):
    tickets = spark.createDataFrame([(1, 0, "queued", 1, 1, ["linux", "gpu"], "foo", [], 1.0)], TICKET)
    agents = spark.createDataFrame([(None, ["linux", "gpu"], ["foo"], 1, 8.0), ("x", ["linux"], ["foo"], 1, 8.0), ("x", ["gpu"], [], 1, 8.0)], AGENT)
    assert [r.scarcity for r in pq.scarcity(tickets, agents).collect()] == [2]
