"""Queue-table reports over snapshots: views, eligibility, scarcity, ranking, remaining work, usage, occupancy, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import queue as q
from runlens.functions.runs import ref_bucket, running_residual
from runlens.operators.damped import damped
from runlens.operators.primitives import broadcast_if_small, newest
from runlens.operators.sliced import running
from runlens.session import cut_lineage

# Fixed values.
TERMINAL = ["finished", "cancelled", "withdrawn", "lost"]
UNFINISHED = ["queued", "claimed", "preparing", "running", "held"]
CHARGED = ["RUNNING", "ORPHANED"]
LEASE_TTL_MS = 120_000
LOST_AFTER_MS = 7_200_000
AMNESTY_AFTER_MS = 60_000
OVERDUE_MS = 1_200_000
STALE_LOG_MS = 300_000
FRESH_MS = 30_000


# ---- views --------------------------------------------------------------------------------------------------------

def ticket_view(tickets: DataFrame) -> DataFrame:
    """Public columns of a ticket: the argv only as a hash, no claim token."""
    hidden = {"header", "claim_token", "snapshot_blobs"}
    return tickets.select(*[c for c in tickets.columns if c not in hidden], F.md5(F.get_json_object("header", "$.argv")).alias("argv_md5"))


def principal_view(principals: DataFrame) -> DataFrame:
    return principals.filter("kind = 'agent'").select("host", "tags", "allowed_repos", "max_claims")


def runner_view(runners: DataFrame) -> DataFrame:
    return runners.select("host", "last_seen")


def list_mine(tickets: DataFrame, states: list[str] | None, limit: int = 100) -> DataFrame:
    """Newest tickets of every owner, at most `limit` each (clamped to 1..500)."""
    rows = tickets.filter(F.col("state").isin(states)) if states else tickets
    return newest(rows, ["owner"], [F.col("created_ms").desc(), F.col("ticket_id")], min(max(limit, 1), 500))


def prune_candidates(tickets: DataFrame, now: int, objects_after_ms: int, rows_after_ms: int, after: tuple[int, int] | None = None, limit: int = 200) -> DataFrame:
    """One keyset page of old terminal tickets, oldest first; `row_due` marks those whose row may go too."""
    old = tickets.filter(F.col("finished_ms").isNotNull() & (F.col("finished_ms") < now - objects_after_ms))
    if after:
        old = old.filter(F.struct("finished_ms", "ticket_id") > F.struct(F.lit(after[0]).cast("long").alias("finished_ms"), F.lit(after[1]).cast("long").alias("ticket_id")))
    return old.orderBy("finished_ms", "ticket_id").limit(min(max(limit, 1), 500)).select(
        "ticket_id", "finished_ms", (F.col("finished_ms") < now - rows_after_ms).alias("row_due"))


def state_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("class", "state").agg(F.count("*").alias("n"))


# ---- eligibility and scarcity -------------------------------------------------------------------------------------

def eligible_agents(profiles: DataFrame, agents: DataFrame) -> DataFrame:
    """(requires_tags, repo, agent) pairs where the agent has every tag and may take the repo.

    `profiles` are distinct (requires_tags, repo). Tags and repo become tokens, so the containment test is an equi-join
    and a count instead of a nested loop.
    """
    p = profiles.select("requires_tags", "repo", (F.size("requires_tags") + 1).alias("need"), F.explode(F.array("repo", F.lit("*"))).alias("as_repo"))
    p = p.select("requires_tags", "repo", "need", "as_repo", F.explode(F.concat(
        F.transform("requires_tags", lambda t: F.concat(F.lit("t:"), t)), F.array(F.concat(F.lit("r:"), F.col("as_repo"))))).alias("token"))
    a = agents.select("agent", F.explode(F.array_distinct(F.concat(
        F.transform("tags", lambda t: F.concat(F.lit("t:"), t)), F.transform("allowed_repos", lambda r: F.concat(F.lit("r:"), r))))).alias("token"))
    hit = p.join(a, "token").groupBy("requires_tags", "repo", "need", "as_repo", "agent").agg(F.count("*").alias("have"))
    return hit.filter("have = need").select("requires_tags", "repo", "agent").distinct()


def _profiles(tickets: DataFrame) -> DataFrame:
    return tickets.select(F.array_sort(F.array_distinct("requires_tags")).alias("requires_tags"), "repo").distinct()


def _normal(tickets: DataFrame) -> DataFrame:
    return tickets.withColumn("requires_tags", F.array_sort(F.array_distinct("requires_tags")))


def agent_kinds(agents: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The rows of one agent of each kind, and (agent, member) for all agents; agents whose rows have equal tags, repos and `columns` are of a kind."""
    row = F.struct("tags", "allowed_repos", *columns)
    of_kind = agents.groupBy(F.col("agent").alias("member")).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("kind_"))
    first = of_kind.groupBy("kind_").agg(F.min(F.struct("member")).alias("first_"))
    members = of_kind.join(first, "kind_").select(F.col("first_.member").alias("agent"), "member")
    chosen = first.select(F.col("first_.member").alias("chosen_"))
    return agents.join(chosen, F.col("agent").eqNullSafe(F.col("chosen_")), "left_semi"), members


def scarcity(tickets: DataFrame, agents: DataFrame) -> DataFrame:
    """Agents that could ever run each ticket's profile."""
    # one agent of a kind meets the profiles and stands for all of them
    alike, members = agent_kinds(agents.filter("max_claims > 0"))
    sizes = members.groupBy(F.col("agent").alias("chosen_")).agg(F.count("*").alias("alike_"))
    pairs = eligible_agents(_profiles(tickets), alike)
    counts = pairs.join(sizes, F.col("agent").eqNullSafe(F.col("chosen_"))).groupBy("requires_tags", "repo").agg(F.sum("alike_").alias("scarcity"))
    return _profiles(tickets).join(counts, ["requires_tags", "repo"], "left").withColumn("scarcity", F.coalesce("scarcity", F.lit(0)))


def needed_tools(tickets: DataFrame, agents: DataFrame) -> DataFrame:
    """Sorted distinct tools of the queued tickets each agent could take."""
    tools = _normal(tickets.filter("state = 'queued'")).select("requires_tags", "repo", F.explode("tools").alias("tool")).distinct()
    pairs = eligible_agents(tools.select("requires_tags", "repo").distinct(), agents)
    got = tools.join(pairs, ["requires_tags", "repo"]).select("agent", "tool").distinct().groupBy("agent").agg(F.array_sort(F.collect_list("tool")).alias("tools"))
    return agents.select("agent").join(got, "agent", "left").withColumn("tools", F.coalesce("tools", F.array().cast("array<string>")))


def claim_ranking(tickets: DataFrame, agents: DataFrame, now: int, avoid_grace_ms: int, room: str) -> DataFrame:
    """The ticket each agent would take per snapshot; `room` is the agent column a ticket's weight must fit.

    An agent sees tickets only through their profile, so one leader per (snapshot, profile, weight) stands for all
    tickets behind it; the leaders, not the tickets, meet the agents. Agents of a kind take the same ticket, so one of them
    is ranked and the others follow by an equi-join.
    """
    alike, members = agent_kinds(agents.filter("agent IS NOT NULL"), room)
    t = _normal(tickets.filter("state = 'queued'"))
    age = F.greatest(F.lit(0).cast("long"), F.lit(now) - F.col("created_ms"))
    score = q.eff_score(F.col("priority"), F.lit(True), age / 1000.0)
    t = t.withColumns({"score": score, "graced": age >= avoid_grace_ms})
    t = t.withColumn("aged_at", F.when((F.col("score") >= 2.0) & (age >= 3_600_000), F.col("created_ms")))
    profile = ["snapshot", "requires_tags", "repo", "avoid_tags", "graced", "weight"]
    within = [F.col("score").desc(), F.col("aged_at").asc_nulls_last(), F.col("created_ms"), F.col("ticket_id")]
    # the rank limit sorts what a task has read, so tickets are dealt out evenly first, however much input a task was given
    t = t.select(*profile, "score", "aged_at", "created_ms", "ticket_id").hint("rebalance", "ticket_id")
    leaders = newest(t, profile, within, 1).join(scarcity(tickets, agents), ["requires_tags", "repo"])
    pairs = eligible_agents(_profiles(tickets), alike)
    c = leaders.join(pairs, ["requires_tags", "repo"]).join(alike.select("agent", "tags", F.col(room).alias("room")), "agent")
    c = c.filter((F.col("graced") | ~F.arrays_overlap("avoid_tags", "tags")) & (F.col("weight") <= F.col("room")))
    order = [F.col("score").desc(), F.col("aged_at").asc_nulls_last(), F.col("scarcity"), F.col("created_ms"), F.col("ticket_id")]
    best = newest(c, ["snapshot", "agent"], order, 1).join(members, "agent")
    return best.select("snapshot", F.col("member").alias("agent"), "ticket_id", F.round("score", 6).alias("score"), "scarcity")


# ---- jobs, groups, parents ----------------------------------------------------------------------------------------

def open_stages(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.lower("state").isin(UNFINISHED)).groupBy("group_id").agg(F.min("stage").alias("open_stage"))


def tag_fits(needs: DataFrame, hosts: DataFrame) -> DataFrame:
    """(need_, host) pairs where the host has every tag of the distinct sets `need_`. Every host has the token of the empty set."""
    any_ = F.array(F.lit("*"))
    tokens = lambda c: F.concat(any_, F.transform(c, lambda t: F.concat(F.lit("t:"), t)))
    a = needs.filter("need_ IS NOT NULL").select("need_", F.explode(tokens("need_")).alias("token"))
    b = hosts.select("host", F.explode(F.array_distinct(tokens("tags"))).alias("token"))
    return a.join(b, "token").groupBy("need_", "host").agg(F.count("*").alias("have")).filter(F.col("have") == F.size("need_") + 1).drop("have")


def eligible_jobs(jobs: DataFrame, hosts: DataFrame, now: int, exclusions: DataFrame, templates: DataFrame, reservations: DataFrame) -> DataFrame:
    """Queued jobs each host may start, before any size test.

    jobs: job_id, group_id, stage, state, not_before_ms, host_pin, tags_req, conflict_scope, conflict_keys, template;
    hosts: host, tags, held_keys; exclusions: key; templates: template; reservations: host, owner_job_id.
    """
    live = jobs.filter("lower(state) = 'queued'").filter(F.col("not_before_ms") <= now).join(open_stages(jobs), "group_id").filter("stage = open_stage")
    live = live.join(templates.select("template").distinct(), "template", "left_semi")
    barred = live.filter("conflict_scope = 'global'").select("job_id", F.explode("conflict_keys").alias("key")).join(exclusions, "key", "left_semi").select("job_id").distinct()
    live = live.join(barred, "job_id", "left_anti")
    # distinct tag sets meet the hosts token by token; jobs follow by an equi-join, pinned ones on their host too
    live = live.withColumn("need_", F.array_sort(F.array_distinct("tags_req")))
    fit = tag_fits(live.select("need_").distinct(), hosts)
    pinned = live.filter("host_pin IS NOT NULL").join(fit.withColumn("host_pin", F.col("host")), ["need_", "host_pin"])
    on_host = live.filter("host_pin IS NULL").join(fit, "need_").unionByName(pinned).drop("need_")
    clash = live.filter("conflict_scope = 'host'").select("job_id", F.explode("conflict_keys").alias("key")).join(
        hosts.select("host", F.explode("held_keys").alias("key")), "key").select("job_id", "host").distinct()
    on_host = on_host.join(clash, ["job_id", "host"], "left_anti").join(hosts, "host")
    held = reservations.groupBy("host").agg(F.min("owner_job_id").alias("r_min"), F.max("owner_job_id").alias("r_max"))
    on_host = on_host.join(held, "host", "left")
    return on_host.filter(F.col("r_min").isNull() | ((F.col("r_min") == F.col("job_id")) & (F.col("r_max") == F.col("job_id")))).drop("r_min", "r_max")


def unmet_floors(policies: DataFrame, demand: DataFrame, wanted: DataFrame) -> DataFrame:
    """CPU reserved against a (host, class, rank): unmet floors of classes whose best waiting work outranks it.

    policies (small): host, class, floor_pct, budget, used, enabled, weight; demand: host, class, best_rank; wanted: host, class, rank.
    """
    p = policies.filter("enabled AND weight > 0").join(demand, ["host", "class"]).select(
        "host", F.col("class").alias("other"), "best_rank", F.greatest(F.lit(0.0), F.coalesce("floor_pct", F.lit(0.0)) / 100 * F.col("budget") - F.coalesce("used", F.lit(0.0))).alias("unmet"))
    j = wanted.join(p, "host", "left")
    counts = ((F.col("other") != F.col("class")) & (F.col("best_rank") >= F.col("rank"))) | ((F.col("other") == F.col("class")) & (F.col("rank") < F.col("best_rank")))
    return j.groupBy("host", "class", "rank").agg(F.coalesce(F.sum(F.when(counts, F.col("unmet"))), F.lit(0.0)).alias("reserved"))


ELIGIBLE = ["host", "job_id", "group_id", "class", "cpu_min", "memory", "est_p50_s", "seq", "exclusive"]


def parent_claim_ranking(elig: DataFrame, groups: DataFrame, parents: DataFrame, policies: DataFrame, hosts: DataFrame, now: int) -> DataFrame:
    """The next job per host: eligible jobs, floors and caps, one leader per group, one per parent and class, then the host.

    elig: host, job_id, group_id, class, cpu_min, memory, est_p50_s, seq, exclusive; groups: group_id, parent_id, band,
    last_claim_ms, aging_anchor_ms, urgency, deadline_ms; parents: parent_id, last_claim_ms, aging_anchor_ms, score_base;
    policies: host, class, weight, enabled, floor_pct, cap_pct, used, vtime, active, budget; hosts: host, free, memory.
    """
    since = F.coalesce("last_claim_ms", "aging_anchor_ms")
    par = parents.filter("aging_anchor_ms IS NOT NULL").select("parent_id", since.alias("since_p"), (F.lit(now) - since >= OVERDUE_MS).alias("p_overdue"), "score_base")
    grp = groups.select("group_id", "parent_id", "band", F.col("last_claim_ms").alias("g_last"), since.alias("g_since"), (F.lit(now) - since >= OVERDUE_MS).alias("g_overdue"), "urgency", F.col("deadline_ms").alias("dl")).join(par, "parent_id")
    pol = policies.filter("enabled AND weight > 0").select("host", "class", "vtime", "active", "cap_pct", "budget", F.coalesce("used", F.lit(0.0)).alias("used"))
    c = cut_lineage(elig.select(*ELIGIBLE).join(grp, "group_id").join(pol, ["host", "class"]), "claimable")  # read for the bands and for the ranking
    bands = c.select("host", "class", F.col("band").alias("rank")).distinct()
    demand = bands.groupBy("host", "class").agg(F.max("rank").alias("best_rank"))
    floors = unmet_floors(policies, demand, bands)
    c = c.join(hosts.select("host", "free", F.col("memory").alias("free_memory")), "host").join(
        floors.withColumnRenamed("rank", "band"), ["host", "class", "band"])
    held_room = F.col("free") - F.col("reserved")
    room = F.when(F.col("p_overdue") & ~F.col("exclusive"), F.col("free")).otherwise(held_room)
    cap = F.coalesce(F.col("cap_pct") / 100 * F.col("budget") - F.col("used"), F.lit(float("inf")))
    fit = c.filter((F.col("cpu_min") <= F.least(room, cap)) & (F.col("memory") <= F.col("free_memory")))
    late_exclusive = F.col("p_overdue") & F.col("exclusive")
    fit = newest(fit, ["host", "group_id", "class"], [late_exclusive, F.col("est_p50_s").desc(), F.col("seq")], 1)
    best = fit.groupBy("host", "parent_id").agg(F.max("urgency").alias("best_urgency"))
    fit = fit.join(best, ["host", "parent_id"]).withColumns({"score": F.col("score_base") + F.col("best_urgency"), "overdue": F.col("p_overdue") & ~F.col("exclusive")})
    sibling = [late_exclusive, F.col("g_overdue").desc(), F.when(F.col("g_overdue"), F.col("g_since")).asc_nulls_last(), F.col("urgency").desc(), F.col("g_since"),
               F.col("dl").asc_nulls_last(), F.col("g_last").asc_nulls_first(), F.col("est_p50_s").desc(), F.col("seq"), F.col("group_id")]
    rep = newest(fit, ["host", "parent_id", "class"], sibling, 1)
    floor = rep.groupBy("host").agg(F.min(F.when(F.col("active"), F.col("vtime"))).alias("active_floor"))
    rep = rep.join(floor, "host").withColumn(
        "eff_vtime", F.when(F.col("active"), F.col("vtime")).otherwise(F.greatest(F.col("vtime"), F.coalesce("active_floor", "vtime"))))
    order = [F.col("overdue").desc(), F.when(F.col("overdue"), F.col("since_p")).asc_nulls_last(), F.when(F.col("overdue"), F.col("parent_id")).asc_nulls_last(), F.col("band").desc(),
             F.round("eff_vtime", 9), F.col("score").desc(), F.col("dl").asc_nulls_last(), F.col("g_last").asc_nulls_first(), F.col("est_p50_s").desc(), F.col("seq"), F.col("group_id")]
    return newest(rep, ["host"], order, 1).select("host", "job_id", "group_id", "parent_id", "class", F.col("overdue"), F.round("score", 6).alias("score"))


def remaining_work(jobs: DataFrame, groups: DataFrame, factors: DataFrame) -> DataFrame:
    """Reference seconds left per parent, class and bucket: queued work in full, running work by its residual.

    jobs: group_id, host, class, state, est_p50_s, est_p90_s, elapsed_s, max_ms; factors (small): host, class, bucket, factor.
    """
    j = jobs.filter(F.lower("state").isin("queued", "claimed", "preparing", "running")).withColumn("bucket", ref_bucket(F.col("est_p50_s"), "mid"))
    j = j.join(groups.filter("state = 'active'").select("group_id", "parent_id"), "group_id").join(factors, ["host", "class", "bucket"], "left")
    left = running_residual(F.col("elapsed_s"), F.coalesce("factor", F.lit(1.0)), F.col("est_p50_s"), F.col("est_p90_s"), F.col("max_ms"))["residualRef"]
    amount = F.when(F.lower("state") == "running", left).otherwise(F.col("est_p50_s"))
    return j.groupBy("parent_id", "class", "bucket").agg(F.sum(amount).alias("ref_s"))


def remaining_map(remaining: DataFrame) -> DataFrame:
    """Per parent the nested map class -> bucket -> reference seconds (a handful of entries)."""
    inner = remaining.groupBy("parent_id", "class").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "ref_s")))).alias("buckets"))
    return inner.groupBy("parent_id").agg(F.map_from_entries(F.collect_list(F.struct("class", "buckets"))).alias("remaining"))


def remaining_minutes(remaining: DataFrame, factors: DataFrame, hosts: DataFrame) -> DataFrame:
    """Minutes each parent's remaining work takes on each host (small list), every bucket with its own factor."""
    j = remaining.join(broadcast_if_small(hosts.select("host"))).join(factors, ["host", "class", "bucket"], "left")
    return j.groupBy("parent_id", "host").agg((F.sum(F.col("ref_s") * F.coalesce("factor", F.lit(1.0))) / 60).alias("minutes"))


def parent_usage(parents: DataFrame, minutes: DataFrame, now: int, limit: float, wsjf: bool = True) -> DataFrame:
    """Usage, score and demotion per parent (parent_id, usage_core_s, usage_at_ms, running_cores, since_ms, cost_per_min, interactive, was_demoted)."""
    j = parents.join(minutes.select("parent_id", "minutes"), "parent_id", "left")
    cores = q.usage_cores(F.col("usage_core_s"), (F.lit(now) - F.col("usage_at_ms")) / 1000.0, F.col("running_cores"))
    age = F.least(F.lit(100.0), 5 * F.greatest(F.lit(0.0), (F.lit(now) - F.col("since_ms")) / 1000.0) / 60)
    short = F.least(F.lit(60.0), 6 * F.col("cost_per_min") / F.greatest(F.coalesce("minutes", F.lit(0.0)), F.lit(0.5))) if wsjf else F.lit(0.0)
    j = j.withColumn("cores", cores).withColumn("score", age + 40 / (1 + F.col("cores") / 4) + short)
    demoted = F.col("interactive") & ((F.col("cores") > limit) | (F.col("was_demoted") & (F.col("cores") >= 0.8 * limit)))
    return j.select("parent_id", "cores", "score", demoted.alias("demoted"))


# ---- queue order --------------------------------------------------------------------------------------------------

def queue_order(queue: DataFrame) -> DataFrame:
    """Position in each (snapshot, host) queue; an unreadable record is a barrier nothing moves across.

    queue: snapshot, host, idx, readable, score, sim_rank, seq.
    """
    keys = ["snapshot", "host"]
    qd = queue.withColumn("s_", F.floor(F.col("idx") / 100_000.0).cast("long"))
    qd = running(qd, keys, "s_", ["idx"], sums={"nulls_": (~F.col("readable")).cast("long")})
    qd = qd.withColumns({"barrier": F.col("nulls_") - (~F.col("readable")).cast("long"), "neg_": -F.coalesce("score", F.lit(0.0)),
                         "last_": ~F.col("readable")}).drop("s_", "nulls_")
    # within a run, score bands are slices; the barrier record closes its run
    qd = qd.withColumn("s_", F.when(F.col("last_"), F.lit(1_000_000)).otherwise(F.floor(F.col("neg_") * 50)).cast("long"))
    order = ["last_", "neg_", "sim_rank", "seq", "idx"]
    qd = running(qd, [*keys, "barrier"], "s_", order, sums={"in_run_": F.lit(1).cast("long")})
    sizes = qd.groupBy(*keys, "barrier").agg(F.count("*").alias("c_"))
    before = Window.partitionBy(*keys).orderBy("barrier").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("ahead_", F.coalesce(F.sum("c_").over(before), F.lit(0))).drop("c_")
    return qd.join(sizes, [*keys, "barrier"]).withColumn("position", F.col("ahead_") + F.col("in_run_")).drop("s_", "neg_", "last_", "in_run_", "ahead_")


def promote_owner(ordered: DataFrame, reservations: DataFrame) -> DataFrame:
    """Moves the first reachable reservation owner of each queue to the front; a sim never passes a test ahead of it.

    ordered: output of queue_order with ticket_id and is_sim; reservations: snapshot, host, ticket_id, res_seq.
    """
    keys = ["snapshot", "host"]
    first_test = ordered.filter(F.col("readable") & ~F.col("is_sim")).groupBy(*keys).agg(F.min("position").alias("first_test"))
    reach = ordered.filter((F.col("barrier") == 0) & F.col("readable")).select(*keys, "ticket_id", "position", "is_sim")
    own = reservations.join(reach, [*keys, "ticket_id"]).join(first_test, keys, "left")
    own = own.filter(~F.col("is_sim") | F.col("first_test").isNull() | (F.col("position") < F.col("first_test")))
    owner = own.groupBy(*keys).agg(F.min(F.struct("res_seq", "ticket_id", "position")).alias("o")).select(
        *keys, F.col("o.ticket_id").alias("owner_id"), F.col("o.position").alias("owner_pos"))
    j = ordered.join(owner, keys, "left")
    pos = F.when(F.col("ticket_id") == F.col("owner_id"), 1).when(F.col("position") < F.col("owner_pos"), F.col("position") + 1).otherwise(F.col("position"))
    return j.withColumn("position", pos).drop("owner_pos")


def queue_facts(promoted: DataFrame, waits: DataFrame) -> DataFrame:
    """1-based position among eligible tickets, the owner, and whether another owner is ahead with its wait."""
    keys = ["snapshot", "host"]
    e = promoted.filter(F.col("readable") & F.col("eligible")).withColumn("s_", F.floor(F.col("position") / 10_000.0).cast("long"))
    e = running(e, keys, "s_", ["position"], sums={"place": F.lit(1).cast("long")})
    owner = waits.select(*keys, F.col("ticket_id").alias("owner_id"), F.col("waited_ms").alias("owner_waited_ms"))
    behind = F.col("owner_id").isNotNull() & (F.col("owner_id") != F.col("ticket_id"))
    return e.join(owner, [*keys, "owner_id"], "left").select(
        *keys, "ticket_id", F.col("place").alias("position"), "owner_id", behind.alias("behind_other_owner"), F.when(behind, F.col("owner_waited_ms")).alias("owner_waited_ms"))


# ---- class and occupancy reports ----------------------------------------------------------------------------------

def class_usage(leases: DataFrame, queue: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per snapshot, host and class: charged demand, booked cores, memory and count, queued claims and the lock target.

    leases: snapshot, host, class, state, synthetic, demand, cores, memory; queue: snapshot, host, class, claim;
    budgets: snapshot, host, budget, armed.
    """
    cls = F.when(F.col("class") == "sim", "sim").otherwise("test")
    charged = F.col("state").isin(CHARGED) & ~F.col("synthetic")
    used = leases.groupBy("snapshot", "host", cls.alias("class")).agg(
        F.sum(F.when(charged, F.col("demand")).otherwise(0.0)).alias("used"), F.sum("cores").alias("booked_cores"), F.sum("memory").alias("booked_memory"), F.count("*").alias("booked"))
    queued = queue.groupBy("snapshot", "host", cls.alias("class")).agg(F.sum("claim").alias("queued"))
    both = budgets.select("*", F.explode(F.array(F.lit("test"), F.lit("sim"))).alias("class"))
    j = both.join(used, ["snapshot", "host", "class"], "left").join(queued, ["snapshot", "host", "class"], "left")
    target = F.when(F.col("class") == "test", 0.15 * F.col("budget")).when(F.col("armed"), 0.30 * F.col("budget")).otherwise(0.0)
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("used", "booked_cores", "booked_memory", "queued")]
    return j.select("snapshot", "host", "class", *zero, F.coalesce("booked", F.lit(0)).alias("booked"), target.alias("target"))


def sim_cap_verdicts(queue: DataFrame, usage: DataFrame, policy: DataFrame) -> DataFrame:
    """Why each queued ticket may not start under the class caps, or NULL.

    queue: snapshot, host, ticket_id, class, required, cores, memory; usage: class_usage; policy: snapshot, host, active,
    valid, max_tickets, cap_cores, cap_memory, reserve_cores, budget.
    """
    sims = usage.filter("class = 'sim'").select("snapshot", "host", F.col("booked").alias("b_n"), F.col("booked_cores").alias("b_cores"), F.col("booked_memory").alias("b_memory"))
    j = queue.join(policy, ["snapshot", "host"]).join(sims, ["snapshot", "host"], "left").na.fill(0, ["b_n", "b_cores", "b_memory"])
    ceiling = F.least(F.col("cap_cores"), F.col("budget") - F.col("reserve_cores")) - F.col("b_cores")
    sim = F.coalesce(F.col("class") == "sim", F.lit(False))
    why = (
        F.when(F.col("required") & ~(F.col("active") & F.col("valid")), "enforcement-unavailable").when(~sim, F.lit(None)).when(~F.col("valid"), "config-invalid")
        .when(F.col("b_n") >= F.col("max_tickets"), "max-tickets").when(F.col("b_cores") + F.col("cores") > F.col("cap_cores"), "cap-cores")
        .when(F.col("b_memory") + F.col("memory") > F.col("cap_memory"), "cap-memory").when(F.col("cores") > ceiling, "test-reserve"))
    return j.select("snapshot", "host", "ticket_id", why.alias("reason"))


def occupancy(leases: DataFrame, hosts: DataFrame) -> DataFrame:
    """Held weight, cores and memory per snapshot and host, the CPU budget and how many leases look stale or oversized.

    leases: snapshot, host, weight, cores, memory, log_age_ms, peak_memory; hosts: snapshot, host, capacity_cores, percent, reserve.
    """
    stale = F.coalesce(F.col("log_age_ms") > STALE_LOG_MS, F.lit(False))
    over = F.coalesce(F.col("peak_memory") > F.col("memory"), F.lit(False))
    g = leases.groupBy("snapshot", "host").agg(
        F.sum(F.coalesce("weight", F.lit(0.0))).alias("running_weight"), F.sum("cores").alias("reserved_cores"), F.sum("memory").alias("reserved_memory"),
        F.count_if(stale).alias("stale_logs"), F.count_if(over).alias("over_memory"), F.count("*").alias("leases"))
    budget = F.greatest(F.lit(0.0), F.least(F.col("capacity_cores") - F.col("reserve"), F.col("percent") / 100 * F.col("capacity_cores")))
    return hosts.join(g, ["snapshot", "host"], "left").na.fill(0).select(
        "snapshot", "host", "running_weight", "reserved_cores", "reserved_memory", budget.alias("budget"), "stale_logs", "over_memory", "leases")


def memory_projection(leases: DataFrame, hosts: DataFrame) -> DataFrame:
    """Projected free memory and the verdict for one more claim per snapshot and host.

    leases: snapshot, host, booked, observed, observed_age_ms; hosts: snapshot, host, available, total, reserve, claim.
    """
    fresh = F.coalesce(F.col("observed_age_ms") <= FRESH_MS, F.lit(False))
    growth = F.greatest(F.lit(0.0), F.col("booked") - F.coalesce(F.when(fresh, F.col("observed")), F.lit(0.0)))
    g = leases.groupBy("snapshot", "host").agg(F.sum(growth).alias("growth"), F.sum("booked").alias("reserved"))
    j = hosts.join(g, ["snapshot", "host"], "left").na.fill(0, ["growth", "reserved"])
    projected = F.col("available") - F.col("growth") - F.col("claim")
    budget = F.coalesce(F.when(F.col("total").isNotNull(), F.greatest(F.lit(0.0), F.col("total") - F.col("reserve"))), F.lit(float("inf")))
    verdict = (
        F.when(F.col("available").isNull(), "memory-unavailable").when(F.col("reserved") + F.col("claim") > budget, "memory-reservations")
        .when(projected < F.col("reserve"), "memory-headroom").otherwise("ok"))
    return j.select("snapshot", "host", "growth", projected.alias("projected"), verdict.alias("verdict"))


# ---- expiry and urgency -------------------------------------------------------------------------------------------

def lease_expiry(tickets: DataFrame, ticks: DataFrame) -> DataFrame:
    """Verdict per claimed or running ticket at its snapshot's tick; a long gap between ticks first extends every lease.

    tickets: snapshot, ticket_id, state, lease_until_ms, requeues, cancel_requested; ticks: snapshot, now_ms, last_tick_ms.
    """
    j = tickets.filter(F.col("state").isin("claimed", "running")).join(ticks, "snapshot")
    amnesty = F.col("now_ms") - F.col("last_tick_ms") > AMNESTY_AFTER_MS
    until = F.when(amnesty, F.greatest("lease_until_ms", F.col("now_ms") + LEASE_TTL_MS)).otherwise(F.col("lease_until_ms"))
    back = q.return_to_queue(F.col("cancel_requested"), F.col("requeues"), F.col("now_ms"))
    j = j.withColumns({"until": until, "back": back})
    expired = (F.col("state") == "claimed") & (F.col("until") < F.col("now_ms"))
    gone = (F.col("state") == "running") & (F.col("until") + (LOST_AFTER_MS - LEASE_TTL_MS) < F.col("now_ms"))
    return j.select("snapshot", "ticket_id", F.when(expired, F.col("back.state")).when(gone, "lost").otherwise("kept").alias("verdict"),
                    F.when(expired, F.col("back.notBeforeMs")).alias("not_before_ms"), F.col("until").alias("lease_until_ms"))


def forecast_cycles(forecasts: DataFrame) -> DataFrame:
    """What each forecast cycle wants (g, cycle, start, raw, slack, s0) from group_id, cycle, deadline_ms, now_ms, eta_p90_s, low_confidence."""
    slack = (F.col("deadline_ms") - F.col("now_ms")) / 1000.0 - F.col("eta_p90_s")
    s0 = F.greatest(F.lit(900.0), 0.5 * F.col("eta_p90_s"))

    def points(slack: Column, s0: Column) -> Column:
        return 150 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - slack / s0))

    raw = F.when(F.col("low_confidence"), 0.5).otherwise(1.0) * points(slack, s0)
    # before the first forecast the deadline counts as if nothing were left to run
    bare = (F.col("deadline_ms") - F.col("now_ms")) / 1000.0
    start = F.when(bare < 0, 75.0).otherwise(points(bare, F.lit(900.0)))
    return forecasts.filter("deadline_ms IS NOT NULL").select(F.col("group_id").alias("g"), "cycle", start.alias("start"), raw.alias("raw"), slack.alias("slack"), s0.alias("s0"))


def damped_urgency(forecasts: DataFrame, slice_cycles: int = 100_000, slice_rows: int = 1_000) -> DataFrame:
    """Deadline urgency after each forecast cycle: group_id, cycle, urgency, boosted. A group's cycles are cut over tasks."""
    return damped(forecast_cycles(forecasts), slice_cycles, slice_rows).select(F.col("g").alias("group_id"), "cycle", F.col("level").alias("urgency"), F.col("on").alias("boosted"))
