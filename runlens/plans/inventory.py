"""Object inventories, journals, manifests, cache eviction and retention verdicts. Nothing here deletes anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.paths import parse_object_path
from runlens.operators.primitives import until_budget
from runlens.operators.sliced import DAY_MS, running, slice_of

# Fixed values.
TERMINAL = ["finished", "cancelled", "withdrawn", "lost"]
MANIFEST_KEEP_MS = 14 * DAY_MS
BLOB_GRACE_MS = DAY_MS
EVICT_FRACTION = 0.8
MIN_CACHEABLE_BYTES = 8 * 1024
UUID_NAME = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
PUT_KINDS = ["blob", "manifest", "delete-cancel"]
MARK_KINDS = ["pin", "terminal"]


# ---- journal ------------------------------------------------------------------------------------------------------

def journal_gaps(journal: DataFrame) -> DataFrame:
    """Records whose seq does not follow the one before in their store (store, seq)."""
    j = journal.withColumn("s_", slice_of(F.col("seq"), 100_000))
    j = running(j, ["store"], "s_", ["seq"], lags={"prev_seq": F.col("seq")})
    return j.filter(F.col("prev_seq").isNotNull() & (F.col("seq") != F.col("prev_seq") + 1)).select("store", "seq", "prev_seq")


def object_records(journal: DataFrame) -> DataFrame:
    """Journal records that say put, intent or delete of an object; pins and terminal marks do not."""
    state = F.when(F.col("kind").isin(PUT_KINDS), "put").when(F.col("kind") == "delete-intent", "intent").when(F.col("kind") == "delete", "delete")
    return journal.withColumn("state", state).filter("state IS NOT NULL")


def object_state(journal: DataFrame) -> DataFrame:
    """put, intent or delete per (store, path), by its last object record."""
    return object_records(journal).groupBy("store", "path").agg(F.max_by("state", "seq").alias("state"))


def replication_lag(journal: DataFrame, marks: DataFrame, now: int) -> DataFrame:
    """Age of the first record above each store's watermark, 0 when replicated up to the head (marks: store, replicated_seq, failed_rounds)."""
    above = journal.join(marks, "store").groupBy("store").agg(
        F.min_by("created_ms", F.when(F.col("seq") > F.col("replicated_seq"), F.col("seq"))).alias("oldest_ms"), F.max("seq").alias("head_seq"))
    age = F.coalesce(F.greatest(F.when(F.col("oldest_ms").isNotNull(), F.lit(0.0)), (F.lit(now) - F.col("oldest_ms")) / 1000), F.lit(0.0))
    return marks.join(above, "store", "left").select("store", age.alias("oldest_age_s"), "replicated_seq", F.coalesce("head_seq", F.lit(0)).alias("head_seq"), "failed_rounds")


# ---- comparison ---------------------------------------------------------------------------------------------------

def compare_stores(local: DataFrame, replica: DataFrame, states: DataFrame, deep: bool = False) -> DataFrame:
    """Differences per (store, path): missing or mismatched at the replica, extra there, not journaled, lost here."""
    a = local.select("store", "path", F.col("size_bytes").alias("l_size"), F.col("sha").alias("l_sha"))
    b = replica.select("store", "path", F.col("size_bytes").alias("r_size"), F.col("sha").alias("r_sha"))
    s = states.select("store", "path", "state")
    j = a.join(b, ["store", "path"], "full").join(s, ["store", "path"], "full")
    here, there = F.col("l_size").isNotNull(), F.col("r_size").isNotNull()
    differs = (F.col("l_size") != F.col("r_size")) | (F.lit(deep) & ~F.col("l_sha").eqNullSafe(F.col("r_sha")))
    kinds = F.array_compact(F.array(
        F.when(here & ~there, "missingAtReplica"), F.when(here & there & differs, "mismatched"), F.when(there & ~here, "extraAtReplica"),
        F.when(here & ~F.coalesce(F.col("state").isin("put", "intent"), F.lit(False)), "notInJournal"),
        F.when(~here & F.coalesce(F.col("state") == "put", F.lit(False)), "lostAtPrimary")))
    return j.select("store", "path", F.explode(kinds).alias("difference"))


def comparison_verdict(stores: DataFrame, differences: DataFrame) -> DataFrame:
    """Per store the count of each difference and `ok`; extra objects at the replica do not spoil it."""
    g = differences.groupBy("store").pivot("difference", ["missingAtReplica", "mismatched", "extraAtReplica", "notInJournal", "lostAtPrimary"]).count()
    j = stores.select("store").distinct().join(g, "store", "left").na.fill(0)
    bad = F.col("missingAtReplica") + F.col("mismatched") + F.col("notInJournal") + F.col("lostAtPrimary")
    return j.withColumn("ok", bad == 0)


# ---- blobs and manifests ------------------------------------------------------------------------------------------

def orphan_blobs(blobs: DataFrame, entries: DataFrame, now: int, grace_ms: int = BLOB_GRACE_MS) -> DataFrame:
    """Blobs no manifest entry of their store references, older than the grace."""
    old = blobs.filter(F.lit(now) - F.col("mtime_ms") >= grace_ms)
    return old.join(entries.select("store", "sha").distinct(), ["store", "sha"], "left_anti")


def live_refs(requested: DataFrame, tickets: DataFrame) -> DataFrame:
    """Requested (ns, sha) that a ticket not yet terminal uses (tickets: state, snapshot_blobs JSON array)."""
    used = tickets.filter(~F.col("state").isin(TERMINAL)).select(F.explode(F.from_json("snapshot_blobs", "array<struct<ns:string,sha256:string>>")).alias("b"))
    return requested.join(used.select(F.col("b.ns").alias("ns"), F.col("b.sha256").alias("sha")).distinct(), ["ns", "sha"], "left_semi")


def negotiate_blobs(entries: DataFrame, held: DataFrame) -> DataFrame:
    """Per manifest what the runner already holds and what must be sent (entries: job, ns, type, sha, size_bytes; held: ns, sha, size_bytes)."""
    cacheable = (F.col("type") == "file") & (F.col("size_bytes") >= MIN_CACHEABLE_BYTES) & F.col("sha").rlike("^[0-9a-f]{64}$")
    j = entries.withColumn("cacheable", F.coalesce(cacheable, F.lit(False))).join(
        held.select("ns", "sha", "size_bytes").distinct().withColumn("held", F.lit(True)), ["ns", "sha", "size_bytes"], "left")
    hit = F.col("cacheable") & F.coalesce("held", F.lit(False))
    return j.groupBy("job").agg(F.count_if(hit).alias("have"), F.sum(F.when(hit, F.col("size_bytes")).otherwise(0)).alias("have_bytes"),
                                F.count_if(~hit).alias("ship"), F.sum(F.when(~hit, F.col("size_bytes")).otherwise(0)).alias("ship_bytes"))


def manifest_hash(entries: Column) -> Column:
    """sha256 of the JSON of the path-sorted canonical entries (array<struct<path,type,exec,size,sha256,target>>)."""
    canonical = F.transform(F.array_sort(entries), lambda e: F.struct(
        e["path"].alias("path"), e["type"].alias("type"), F.when(e["type"] == "file", F.coalesce(e["exec"], F.lit(False))).alias("exec"),
        F.when(e["type"] == "file", e["size"]).alias("size"), F.when(e["type"] == "file", e["sha256"]).alias("sha256"),
        F.when(e["type"] == "symlink", e["target"]).alias("target")))
    text = F.to_json(canonical)
    for digit in "ABCDEF":  # Spark writes control characters with upper-case hex digits, the declared hashes have lower case
        text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*\\u00[01]){digit}", f"$1{digit.lower()}")
    return F.sha2(text, 256)


def audit_manifests(manifests: DataFrame) -> DataFrame:
    """Declared against computed hash and malformed entries per manifest document (job, declared, entries)."""
    from runlens.functions.paths import canonical_rel_path

    def bad(e: Column) -> Column:
        file_ok = (e["type"] == "file") & e["sha256"].rlike("^[0-9a-f]{64}$") & (e["size"] >= 0)
        link_ok = (e["type"] == "symlink") & e["target"].isNotNull()
        return ~(canonical_rel_path(e["path"]) & F.coalesce(file_ok | link_ok, F.lit(False)))

    computed = manifest_hash(F.col("entries"))
    return manifests.select("job", computed.alias("computed"), (computed == F.col("declared")).alias("matches"), F.size(F.filter("entries", bad)).alias("malformed"))


def manifest_diff(expected: DataFrame, present: DataFrame) -> DataFrame:
    """All differences between expected and present entries per job (path, type, exec, size, sha, target); `first` marks the
    first in path order, the one a sequential check would stop at.

    Entries count in canonical form: a file has exec (false where absent), size and hash, a symlink only its target.
    """
    cols = ["type", "exec", "size_bytes", "sha", "target"]

    def canonical(df: DataFrame) -> DataFrame:
        file, link = F.col("type") == "file", F.col("type") == "symlink"
        return df.withColumns({"exec": F.when(file, F.coalesce("exec", F.lit(False))), "size_bytes": F.when(file, F.col("size_bytes")),
                               "sha": F.when(file, F.col("sha")), "target": F.when(link, F.col("target"))})

    expected, present = canonical(expected), canonical(present)
    e = expected.select("job", "path", F.lit(True).alias("in_e"), *[F.col(c).alias(f"e_{c}") for c in cols])
    p = present.select("job", "path", F.lit(True).alias("in_p"), *[F.col(c).alias(f"p_{c}") for c in cols])
    j = e.join(p, ["job", "path"], "full")

    def differs(c: str) -> Column:
        return ~F.col(f"e_{c}").eqNullSafe(F.col(f"p_{c}"))

    why = (F.when(F.col("in_p").isNull(), "missing").when(F.col("in_e").isNull(), "extra").when(differs("type"), "type mismatch").when(differs("exec"), "exec mismatch")
           .when(differs("size_bytes"), "size mismatch").when(differs("sha"), "hash mismatch").when(differs("target"), "target mismatch"))
    d = j.select("job", "path", why.alias("difference")).filter("difference IS NOT NULL")
    first = d.groupBy("job").agg(F.min("path").alias("first_path"))
    return d.join(first, "job").withColumn("first", F.col("path") == F.col("first_path")).drop("first_path")


def cache_miss_reasons(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Key parts of each request that differ from the newest earlier entry of its cache; NULL without one.

    requests: cache, request_id, t_ms, key_parts map; entries: cache, t_ms, key_parts map.
    """
    r = requests.select("cache", "t_ms", "request_id", "key_parts", F.lit(1).alias("is_request"))
    e = entries.filter("key_parts IS NOT NULL").select("cache", "t_ms", F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), "key_parts", F.lit(0).alias("is_request"))
    u = r.unionByName(e).withColumn("s_", slice_of(F.col("t_ms"), DAY_MS)).withColumn("tie_", F.coalesce("request_id", F.lit(0)))
    u = running(u, ["cache"], "s_", ["t_ms", "is_request", "tie_"], lasts={"newest": F.when(F.col("is_request") == 0, F.col("key_parts"))})
    labels = F.array_sort(F.array_distinct(F.concat(F.map_keys("newest"), F.map_keys("key_parts"))))
    diff = F.filter(labels, lambda k: ~F.try_element_at("newest", k).eqNullSafe(F.try_element_at("key_parts", k)))
    return u.filter("is_request = 1").select("cache", "request_id", F.when(F.col("newest").isNotNull(), diff).alias("changed"))


# ---- eviction -----------------------------------------------------------------------------------------------------

def retention_eviction(jobs: DataFrame, entries: DataFrame, blobs: DataFrame, caps: DataFrame) -> DataFrame:
    """Oldest terminal, unpinned manifests to evict while a store is over its share of the cap.

    A blob is freed with the last of its manifests, so it counts for the highest rank among them, and never when a
    manifest that stays references it. jobs: store, job, terminal_ms, pinned, manifest_bytes; entries: store, job, sha;
    blobs: store, sha, size_bytes; caps (small): store, cap_bytes.
    """
    cand = jobs.filter(~F.col("pinned") & F.col("terminal_ms").isNotNull()).withColumn("s_", slice_of(F.col("terminal_ms"), DAY_MS))
    ranked = running(cand, ["store"], "s_", ["terminal_ms", "job"], sums={"rank": F.lit(1).cast("long")})
    refs = entries.select("store", "job", "sha").distinct().join(ranked.select("store", "job", "rank"), ["store", "job"], "left")
    free = refs.groupBy("store", "sha").agg(F.max("rank").alias("rank"), F.max(F.col("rank").isNull()).alias("kept")).filter("NOT kept")
    freed = free.join(blobs.select("store", "sha", "size_bytes"), ["store", "sha"]).groupBy("store", "rank").agg(F.sum("size_bytes").alias("blob_bytes"))
    bytes_ = blobs.groupBy("store").agg(F.sum("size_bytes").alias("blob_total")).join(
        jobs.groupBy("store").agg(F.sum("manifest_bytes").alias("manifest_total")), "store", "full")
    total = bytes_.select("store", (F.coalesce("blob_total", F.lit(0)) + F.coalesce("manifest_total", F.lit(0))).alias("total"))
    step = ranked.join(freed, ["store", "rank"], "left").withColumn("gain", F.col("manifest_bytes") + F.coalesce("blob_bytes", F.lit(0)))
    step = running(step.drop("blob_bytes"), ["store"], "s_", ["rank"], sums={"upto": F.col("gain")})
    step = step.join(caps, "store").join(total, "store")
    return step.filter(F.col("total") - (F.col("upto") - F.col("gain")) >= F.col("cap_bytes") * EVICT_FRACTION).select("store", "job", "rank", F.col("gain").alias("freed_bytes"))


def _evict_oldest(items: DataFrame, age_col: str, key: str, budget: Column, weighs: Column) -> DataFrame:
    """Marks `evict` oldest first until the weighed total of each store fits `budget`."""
    i = items.withColumns({"w_": weighs, "b_": budget, "s_": slice_of(F.col(age_col), DAY_MS)})
    need = i.groupBy("store").agg((F.sum("size_bytes") - F.max("b_")).alias("need_"))
    return until_budget(i.join(need, "store"), ["store"], [age_col, key], "s_", "w_", "need_").drop("need_", "w_", "b_", "s_")


def blob_cache_eviction(blobs: DataFrame, leased: DataFrame, now: int, max_age_ms: int, max_bytes: int) -> DataFrame:
    """Blobs to drop per store: too old first, then oldest until the budget; a leased one is spared after the choice."""
    aged = F.lit(now) - F.col("mtime_ms") > max_age_ms
    old = blobs.filter(aged).select("store", "sha", F.lit("age").alias("why"))
    young = _evict_oldest(blobs.filter(~aged), "mtime_ms", "sha", F.lit(max_bytes), F.col("size_bytes"))
    both = old.unionByName(young.filter("evict").select("store", "sha", F.lit("budget").alias("why")))
    return both.join(leased.select("store", "sha").distinct(), ["store", "sha"], "left_anti")


def deps_cache_eviction(entries: DataFrame, max_bytes: int) -> DataFrame:
    """Cache entries to drop per store: damaged first and always, then least recently used; leased ones stay and keep counting.

    entries: store, key, size_bytes (0 when damaged), damaged, leased, last_used_ms.
    """
    total = entries.groupBy("store").agg((F.sum("size_bytes") - max_bytes).alias("need_"))
    free = entries.filter("NOT leased AND NOT damaged").withColumn("s_", slice_of(F.col("last_used_ms"), DAY_MS)).join(total, "store")
    lru = until_budget(free, ["store"], ["last_used_ms", "key"], "s_", "size_bytes", "need_").filter("evict").select("store", "key", F.lit("lru").alias("why"))
    return entries.filter("damaged AND NOT leased").select("store", "key", F.lit("damaged").alias("why")).unionByName(lru)


# ---- retention verdicts -------------------------------------------------------------------------------------------

def expired_manifests(jobs: DataFrame, now: int, keep_ms: int = MANIFEST_KEEP_MS) -> DataFrame:
    return jobs.filter(~F.col("pinned") & (F.lit(now) - F.col("terminal_ms") >= keep_ms))


def ticket_dir_verdicts(dirs: DataFrame, live: DataFrame, now: int, retention_ms: int) -> DataFrame:
    """Per runner ticket directory: keep, whole or work (dir_id, lane_id, mtime_ms, tombstoned, publisher_alive, marker_pending, terminal, has_work)."""
    j = dirs.join(live.select(F.col("id").alias("lane_id"), F.lit(True).alias("is_live")).distinct(), "lane_id", "left")
    held = F.col("tombstoned") | F.col("publisher_alive") | (F.col("lane_id").isNotNull() & (F.coalesce("is_live", F.lit(False)) | F.col("marker_pending")))
    v = F.when(held, "keep").when(F.lit(now) - F.col("mtime_ms") >= retention_ms, "whole").when(F.col("terminal") & F.col("has_work"), "work").otherwise("keep")
    return j.select("dir_id", v.alias("verdict"))


def retired_files(files: DataFrame, live: DataFrame, now: int, retention_ms: int) -> DataFrame:
    """Generated log and result files past retention whose id is not live (name with extension, kind, mtime_ms)."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    ext = F.when(F.col("kind") == "logs", ".log").otherwise(".json")
    old = files.withColumn("id", stem).filter(F.col("id").rlike(UUID_NAME) & F.endswith(F.col("name"), ext) & (F.lit(now) - F.col("mtime_ms") >= retention_ms))
    return old.join(live.select("id").distinct(), "id", "left_anti")


def prunable_chunks(chunks: DataFrame, tickets: DataFrame, now: int, after_ms: int = 3_600_000) -> DataFrame:
    """Log chunks of a missing ticket or of one terminal for a while."""
    t = tickets.select("ticket_id", "state", "finished_ms", F.lit(True).alias("known"))
    gone = F.col("state").isin(TERMINAL) & (F.col("finished_ms") < now - after_ms)
    return chunks.join(t, "ticket_id", "left").filter(F.col("known").isNull() | F.coalesce(gone, F.lit(False))).select(*chunks.columns)


def unreferenced_snapshot_blobs(objects: DataFrame, tickets: DataFrame, now: int, min_age_ms: int = MANIFEST_KEEP_MS) -> DataFrame:
    """Old snapshot blobs (ns, sha, modified_ms) no live ticket refers to."""
    old = objects.filter(F.lit(now) - F.col("modified_ms") > min_age_ms)
    used = tickets.filter(~F.col("state").isin(TERMINAL)).select(F.explode(F.from_json("snapshot_blobs", "array<struct<ns:string,sha256:string>>")).alias("b"))
    return old.join(used.select(F.col("b.ns").alias("ns"), F.col("b.sha256").alias("sha")).distinct(), ["ns", "sha"], "left_anti")


def prunable_claims(claims: DataFrame, tickets: DataFrame, now: int, after_ms: int = DAY_MS) -> DataFrame:
    """Claim requests older than a day whose ticket has been terminal for a day."""
    done = tickets.filter(F.col("state").isin(TERMINAL) & (F.col("finished_ms") < now - after_ms)).select("ticket_id")
    return claims.filter(F.col("created_ms") < now - after_ms).join(done, "ticket_id", "left_semi")


def canonical_objects(listing: DataFrame) -> DataFrame:
    """Listing rows (path, size_bytes, ...) whose path is an object path, with kind, sha and job."""
    return listing.withColumn("o_", parse_object_path(F.col("path"))).filter("o_ IS NOT NULL").select(
        *listing.columns, F.col("o_.kind").alias("object_kind"), F.col("o_.sha").alias("object_sha"), F.col("o_.job").alias("object_job"))
