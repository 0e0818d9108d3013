"""Inventory, manifest, eviction and retention queries over documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.plans import inventory as inv
from runlens.workload.registry import query
from runlens.workload.views import flat, oracle

NOW = 1_704_067_200_000
DAY = 86_400_000


@query("store_journal_gaps", "SRC06", oracle(["store_journal"], """
g AS (SELECT store, seq, lag(seq) OVER (PARTITION BY store ORDER BY seq) AS prev_seq FROM store_journal WHERE seq % 97 <> 3) SELECT * FROM g WHERE seq <> prev_seq + 1"""))
def store_journal_gaps(spark, sf):
    return inv.journal_gaps(flat(spark, sf, "store_journal").filter("seq % 97 <> 3"))


JK = "CASE seq % 6 WHEN 0 THEN 'delete-intent' WHEN 1 THEN 'delete' WHEN 2 THEN 'delete-cancel' WHEN 3 THEN 'pin' ELSE 'blob' END"
STATE_SQL = f"""
jk AS (SELECT store, seq, path, {JK} AS kind FROM store_journal),
st AS (SELECT store, path, arg_max(CASE kind WHEN 'delete-intent' THEN 'intent' WHEN 'delete' THEN 'delete' ELSE 'put' END, seq) AS state FROM jk WHERE kind <> 'pin' GROUP BY 1, 2)"""


def _state(spark, sf):
    return inv.object_state(flat(spark, sf, "store_journal").selectExpr("store", "seq", "path", f"{JK} AS kind"))


@query("object_state", "STR17", oracle(["store_journal"], STATE_SQL + "\nSELECT * FROM st"))
def object_state(spark, sf):
    return _state(spark, sf)


@query("replication_lag", "STR16", oracle(["store_journal"], f"""
mk AS (SELECT store, CASE store WHEN 0 THEN 50 WHEN 1 THEN 1000000 ELSE 0 END AS replicated_seq, store * 2 AS failed_rounds FROM (SELECT DISTINCT store FROM store_journal) s)
SELECT m.store, coalesce(greatest(0, ({NOW} + 90000000 - arg_min(created_ms, seq) FILTER (seq > replicated_seq)) / 1000)::DOUBLE, 0) AS oldest_age_s, replicated_seq, max(seq) AS head_seq, failed_rounds FROM mk m JOIN store_journal j ON j.store = m.store GROUP BY m.store, replicated_seq, failed_rounds"""))
def replication_lag(spark, sf):
    j = flat(spark, sf, "store_journal")
    marks = j.select("store").distinct().selectExpr("store", "CASE store WHEN 0 THEN 50 WHEN 1 THEN 1000000 ELSE 0 END AS replicated_seq", "store * 2 AS failed_rounds")
    return inv.replication_lag(j, marks, NOW + 90_000_000)


COMPARE_SQL = STATE_SQL + """,
lo AS (SELECT store, path, max(size_bytes) AS size_bytes, max(sha) AS sha FROM (SELECT store, path, size_bytes, sha, seq FROM store_journal) z WHERE seq % 11 <> 4 GROUP BY 1, 2),
re AS (SELECT store, path, max(size_bytes + CASE WHEN seq % 50 = 9 THEN 100000000 ELSE 0 END) AS size_bytes, max(sha) AS sha FROM (SELECT store, path, size_bytes, sha, seq FROM store_journal) z WHERE seq % 13 <> 5 GROUP BY 1, 2),
j AS (SELECT coalesce(l.store, r.store, s.store) AS store, coalesce(l.path, r.path, s.path) AS path, l.size_bytes AS ls, r.size_bytes AS rs, l.sha AS lh, r.sha AS rh, s.state FROM lo l FULL JOIN re r ON r.store = l.store AND r.path = l.path FULL JOIN st s ON s.store = coalesce(l.store, r.store) AND s.path = coalesce(l.path, r.path)),
df AS (SELECT store, path, unnest(list_filter([CASE WHEN ls IS NOT NULL AND rs IS NULL THEN 'missingAtReplica' END, CASE WHEN ls <> rs OR (ls IS NOT NULL AND rs IS NOT NULL AND lh <> rh) THEN 'mismatched' END, CASE WHEN ls IS NULL AND rs IS NOT NULL THEN 'extraAtReplica' END,
  CASE WHEN ls IS NOT NULL AND coalesce(state, '') NOT IN ('put', 'intent') THEN 'notInJournal' END, CASE WHEN ls IS NULL AND state = 'put' THEN 'lostAtPrimary' END], lambda x: x IS NOT NULL)) AS difference FROM j)"""


def _stores(spark, sf):
    base = flat(spark, sf, "store_journal").selectExpr("store", "path", "size_bytes", "sha", "seq")
    local = base.filter("seq % 11 <> 4").groupBy("store", "path").agg(F.max("size_bytes").alias("size_bytes"), F.max("sha").alias("sha"))
    rep = base.filter("seq % 13 <> 5").groupBy("store", "path").agg(F.max(F.col("size_bytes") + F.when(F.col("seq") % 50 == 9, 100_000_000).otherwise(0)).alias("size_bytes"), F.max("sha").alias("sha"))
    return local, inv.compare_stores(local, rep, _state(spark, sf), deep=True)


@query("store_comparison", "JON13 SET02", oracle(["store_journal"], COMPARE_SQL + "\nSELECT * FROM df"))
def store_comparison(spark, sf):
    return _stores(spark, sf)[1]


@query("store_comparison_verdict", "JON13", oracle(["store_journal"], COMPARE_SQL + """
SELECT s.store, count(*) FILTER (difference = 'missingAtReplica') AS "missingAtReplica", count(*) FILTER (difference = 'mismatched') AS mismatched, count(*) FILTER (difference = 'extraAtReplica') AS "extraAtReplica", count(*) FILTER (difference = 'notInJournal') AS "notInJournal",
  count(*) FILTER (difference = 'lostAtPrimary') AS "lostAtPrimary", count(*) FILTER (difference <> 'extraAtReplica') = 0 AS ok FROM (SELECT DISTINCT store FROM lo) s LEFT JOIN df ON df.store = s.store GROUP BY 1"""))
def store_comparison_verdict(spark, sf):
    return inv.comparison_verdict(*_stores(spark, sf))


# a fifth of the documents has another content in the manifests than in the store, which leaves orphans there
ENTRY_SHA = "CASE WHEN doc_id % 5 = 1 THEN concat('0', sha) ELSE sha END AS sha"
ENTRY_SQL = f"en AS (SELECT 'store' || (doc_id % 3)::VARCHAR AS store, job, {ENTRY_SHA}, path, size_bytes, doc_id FROM manifest_entries)"


def _entries(spark, sf):
    return flat(spark, sf, "manifest_entries").selectExpr("concat('store', doc_id % 3) AS store", "job", ENTRY_SHA, "path", "size_bytes", "doc_id")


@query("orphan_blobs", "JON14", oracle(["blobs", "manifest_entries"], ENTRY_SQL + f"""
SELECT store, sha, size_bytes FROM blobs b WHERE {NOW} - mtime_ms >= {DAY} AND NOT EXISTS (SELECT 1 FROM en WHERE en.store = b.store AND en.sha = b.sha)"""))
def orphan_blobs(spark, sf):
    return inv.orphan_blobs(flat(spark, sf, "blobs"), _entries(spark, sf), NOW).select("store", "sha", "size_bytes")


TB = "SELECT ticket_id, CASE WHEN state = 'done' THEN 'finished' ELSE state END AS state, finished_ms, created_ms, CASE WHEN ticket_id % 3 = 0 THEN NULL ELSE concat('[{\"ns\":\"n', CAST(ticket_id % 4 AS STRING), '\",\"sha256\":\"s', CAST(ticket_id % 5000 AS STRING), '\"},{\"ns\":\"n1\",\"sha256\":\"s', CAST(ticket_id % 77 AS STRING), '\"}]') END AS snapshot_blobs FROM"
REFS = "SELECT DISTINCT concat('n', CAST(c_custkey % 4 AS STRING)) AS ns, concat('s', CAST(c_custkey * 3 AS STRING)) AS sha, 1704067200000 - CAST(c_custkey % 40 AS BIGINT) * 86400000 AS modified_ms FROM"
LIVE_SQL = f"tb AS ({TB} tickets), rq AS ({REFS} customer), lv AS (SELECT DISTINCT 'n' || (ticket_id % 4)::VARCHAR AS ns, 's' || (ticket_id % 5000)::VARCHAR AS sha FROM tb WHERE state NOT IN ('finished', 'cancelled', 'withdrawn', 'lost') AND ticket_id % 3 <> 0 UNION SELECT 'n1', 's' || (ticket_id % 77)::VARCHAR FROM tb WHERE state NOT IN ('finished', 'cancelled', 'withdrawn', 'lost') AND ticket_id % 3 <> 0)"


def _tickets(spark, sf):
    return spark.sql(TB.replace("{", "{{").replace("}", "}}") + " {tickets}", tickets=flat(spark, sf, "tickets"))


def _refs(spark, sf):
    return spark.sql(REFS + " {customer}", customer=spark.read.parquet(f"{sf}/customer.parquet"))


@query("live_blob_refs", "JON15", oracle(["tickets"], LIVE_SQL + "\nSELECT rq.ns, rq.sha FROM rq JOIN lv ON lv.ns = rq.ns AND lv.sha = rq.sha"))
def live_blob_refs(spark, sf):
    return inv.live_refs(_refs(spark, sf), _tickets(spark, sf)).select("ns", "sha")


@query("unreferenced_snapshot_blobs", "RET05", oracle(["tickets"], LIVE_SQL + f"\nSELECT rq.ns, rq.sha FROM rq WHERE {NOW} - modified_ms > {14 * DAY} AND NOT EXISTS (SELECT 1 FROM lv WHERE lv.ns = rq.ns AND lv.sha = rq.sha)"))
def unreferenced_snapshot_blobs(spark, sf):
    return inv.unreferenced_snapshot_blobs(_refs(spark, sf), _tickets(spark, sf), NOW).select("ns", "sha")


@query("blob_negotiation", "JON16", oracle(["manifest_entries", "blobs"], """
hd AS (SELECT DISTINCT 'n0' AS ns, sha, size_bytes FROM blobs WHERE store = 'store0'),
e AS (SELECT m.*, CASE WHEN doc_id % 4 = 3 THEN 'n1' ELSE 'n0' END AS ns FROM manifest_entries m),
k AS (SELECT e.*, h.sha IS NOT NULL AND e.size_bytes >= 8192 AS hit FROM e LEFT JOIN hd h ON h.ns = e.ns AND h.sha = e.sha AND h.size_bytes = e.size_bytes)
SELECT job, count(*) FILTER (hit) AS have, coalesce(sum(size_bytes) FILTER (hit), 0)::BIGINT AS have_bytes, count(*) FILTER (NOT hit) AS ship, coalesce(sum(size_bytes) FILTER (NOT hit), 0)::BIGINT AS ship_bytes FROM k GROUP BY 1"""))
def blob_negotiation(spark, sf):
    e = flat(spark, sf, "manifest_entries").withColumns({"ns": F.when(F.col("doc_id") % 4 == 3, "n1").otherwise("n0"), "type": F.lit("file")})
    return inv.negotiate_blobs(e, flat(spark, sf, "blobs").filter("store = 'store0'").withColumn("ns", F.lit("n0")))


@query("manifest_hash_audit", "AGG40 SCL22", oracle(["manifest_entries"], """
e AS (SELECT job, path, CASE WHEN doc_id % 9 = 0 THEN '{"path":"' || path || '","type":"symlink","target":"../t' || doc_id::VARCHAR || '"}'
   ELSE '{"path":"' || path || '","type":"file","exec":' || CASE WHEN executable THEN 'true' ELSE 'false' END || ',"size":' || size_bytes::VARCHAR || ',"sha256":"' || sha || '"}' END AS js FROM manifest_entries),
m AS (SELECT job, sha256('[' || string_agg(js, ',' ORDER BY path) || ']') AS computed FROM e GROUP BY 1)
SELECT job, computed, substr(job, 4)::BIGINT % 10 <> 0 AS matches, 0 AS malformed FROM m"""))
def manifest_hash_audit(spark, sf):
    link = F.col("doc_id") % 9 == 0
    e = flat(spark, sf, "manifest_entries").select("job", F.struct(
        "path", F.when(link, "symlink").otherwise("file").alias("type"), F.when(~link, F.col("executable")).alias("exec"), F.when(~link, F.col("size_bytes")).alias("size"),
        F.when(~link, F.col("sha")).alias("sha256"), F.when(link, F.concat(F.lit("../t"), F.col("doc_id").cast("string"))).alias("target")).alias("e"))
    docs = e.groupBy("job").agg(F.collect_list("e").alias("entries"))
    broken = F.expr("cast(substring(job, 4) as bigint) % 10 = 0")
    return inv.audit_manifests(docs.withColumn("declared", F.when(broken, "x").otherwise(inv.manifest_hash(F.col("entries")))))


@query("manifest_diff", "JON21", oracle(["manifest_entries"], """
x AS (SELECT *, doc_id % 9 AS m FROM manifest_entries),
j AS (SELECT job, path, CASE WHEN m = 1 THEN 'missing' WHEN m = 2 THEN 'extra' WHEN m = 3 THEN 'type mismatch' WHEN m = 4 THEN 'exec mismatch' WHEN m = 5 THEN 'size mismatch' WHEN m = 6 THEN 'hash mismatch' END AS difference FROM x)
SELECT job, path, difference, path = min(path) OVER (PARTITION BY job) AS first FROM j WHERE difference IS NOT NULL"""))
def manifest_diff(spark, sf):
    x = flat(spark, sf, "manifest_entries").withColumn("m", F.col("doc_id") % 9)
    base = ["job", "path", "m", "executable", "size_bytes", "sha"]
    e = x.filter("m <> 2").select(*base).selectExpr("job", "path", "'file' AS type", "executable AS exec", "size_bytes", "sha", "CAST(NULL AS STRING) AS target")
    p = x.filter("m <> 1").select(*base).selectExpr("job", "path", "if(m = 3, 'symlink', 'file') AS type", "if(m = 4, NOT executable, executable) AS exec", "if(m = 5, size_bytes + 1, size_bytes) AS size_bytes", "if(m = 6, reverse(concat(sha, 'x')), sha) AS sha", "CAST(NULL AS STRING) AS target")
    return inv.manifest_diff(e, p)


@query("cache_miss_reasons", "JON23", oracle(["tickets"], """
k AS (SELECT host AS cache, ticket_id, created_ms, ticket_id % 3 = 0 AS req, (weight::INT)::VARCHAR AS w, repo, CASE WHEN ticket_id % 4 = 1 THEN 'l1' END AS lock FROM tickets),
r AS (SELECT q.cache, q.ticket_id, q.w, q.repo, q.lock, arg_max({'w': e.w, 'repo': e.repo, 'lock': e.lock, 'ok': e.ticket_id IS NOT NULL}, (e.created_ms, e.ticket_id)) AS n FROM (SELECT * FROM k WHERE req) q LEFT JOIN (SELECT * FROM k WHERE NOT req) e ON e.cache = q.cache AND e.created_ms <= q.created_ms GROUP BY 1, 2, 3, 4, 5)
SELECT cache, ticket_id AS request_id, CASE WHEN n.ok THEN array_to_string(list_filter([CASE WHEN n.lock IS DISTINCT FROM lock THEN 'lock' END, CASE WHEN n.repo <> repo THEN 'repo' END, CASE WHEN n.w <> w THEN 'weight' END], lambda x: x IS NOT NULL), ',') END AS changed FROM r"""))
def cache_miss_reasons(spark, sf):
    parts = F.map_filter(F.create_map(F.lit("weight"), F.col("weight").cast("int").cast("string"), F.lit("repo"), F.col("repo"),
                                      F.lit("lock"), F.when(F.col("ticket_id") % 4 == 1, "l1")), lambda k, v: v.isNotNull())
    t = flat(spark, sf, "tickets").select(F.col("host").alias("cache"), F.col("ticket_id").alias("request_id"), F.col("created_ms").alias("t_ms"), parts.alias("key_parts"))
    out = inv.cache_miss_reasons(t.filter("request_id % 3 = 0"), t.filter("request_id % 3 <> 0"))
    return out.select("cache", "request_id", F.array_join("changed", ",").alias("changed"))


JOB_SQL = """
jb AS (SELECT s.store, e.job, count(*) * 100 AS manifest_bytes, substr(e.job, 4)::BIGINT % 7 = 0 AS pinned, CASE WHEN substr(e.job, 4)::BIGINT % 5 <> 0 THEN 1704067200000 - substr(e.job, 4)::BIGINT * 7919 % 40 * 86400000 END AS terminal_ms FROM en e JOIN (SELECT DISTINCT store, job FROM en) s ON s.store = e.store AND s.job = e.job GROUP BY 1, 2)"""


def _manifest_jobs(spark, sf):
    k = "cast(substring(job, 4) as bigint)"
    return _entries(spark, sf).groupBy("store", "job").agg((F.count("*") * 100).alias("manifest_bytes")).selectExpr(
        "store", "job", "manifest_bytes", f"{k} % 7 = 0 AS pinned", f"if({k} % 5 <> 0, 1704067200000 - {k} * 7919 % 40 * 86400000, NULL) AS terminal_ms")


@query("expired_manifests", "RET01", oracle(["manifest_entries"], ENTRY_SQL + "," + JOB_SQL + f"\nSELECT store, job FROM jb WHERE NOT pinned AND {NOW} - terminal_ms >= {14 * DAY}"))
def expired_manifests(spark, sf):
    return inv.expired_manifests(_manifest_jobs(spark, sf), NOW).select("store", "job")


@query("retention_eviction", "WIN13 P11", oracle(["manifest_entries", "blobs"], ENTRY_SQL + "," + JOB_SQL + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY terminal_ms, job) AS rank FROM jb WHERE NOT pinned AND terminal_ms IS NOT NULL),
rf AS (SELECT DISTINCT e.store, e.sha, e.job, r.rank FROM en e LEFT JOIN rk r ON r.store = e.store AND r.job = e.job),
fr AS (SELECT store, sha, max(rank) AS rank FROM rf GROUP BY 1, 2 HAVING NOT bool_or(rank IS NULL)),
gb AS (SELECT f.store, f.rank, sum(b.size_bytes) AS bb FROM fr f JOIN blobs b ON b.store = f.store AND b.sha = f.sha GROUP BY 1, 2),
tt AS (SELECT b.store, b.s + m.s AS total FROM (SELECT store, sum(size_bytes) AS s FROM blobs GROUP BY 1) b JOIN (SELECT store, sum(manifest_bytes) AS s FROM jb GROUP BY 1) m ON m.store = b.store),
sp AS (SELECT r.store, r.job, r.rank, (r.manifest_bytes + coalesce(g.bb, 0))::BIGINT AS gain FROM rk r LEFT JOIN gb g ON g.store = r.store AND g.rank = r.rank),
cu AS (SELECT *, sum(gain) OVER (PARTITION BY store ORDER BY rank) - gain AS before FROM sp)
SELECT c.store, c.job, c.rank, gain AS freed_bytes FROM cu c JOIN tt t ON t.store = c.store WHERE t.total - before >= 0.8 * (CASE c.store WHEN 'store0' THEN total * 0.9 WHEN 'store1' THEN total / 2 ELSE total * 2 END)"""))
def retention_eviction(spark, sf):
    jobs, blobs = _manifest_jobs(spark, sf), flat(spark, sf, "blobs")
    total = blobs.groupBy("store").agg(F.sum("size_bytes").alias("b")).join(jobs.groupBy("store").agg(F.sum("manifest_bytes").alias("m")), "store")
    caps = total.select("store", F.when(F.col("store") == "store0", (F.col("b") + F.col("m")) * 0.9).when(F.col("store") == "store1", (F.col("b") + F.col("m")) / 2)
                        .otherwise((F.col("b") + F.col("m")) * 2.0).alias("cap_bytes"))
    return inv.retention_eviction(jobs, _entries(spark, sf), blobs, caps)


@query("blob_cache_eviction", "WIN14 P11", oracle(["blobs"], f"""
y AS (SELECT *, {NOW} - mtime_ms > {30 * DAY} AS aged FROM blobs),
k AS (SELECT *, sum(size_bytes) OVER (PARTITION BY store ORDER BY mtime_ms, sha) - size_bytes AS before, sum(size_bytes) OVER (PARTITION BY store) AS total FROM y WHERE NOT aged),
v AS (SELECT store, sha, 'age' AS why FROM y WHERE aged UNION ALL SELECT store, sha, 'budget' FROM k WHERE total - before > 200000)
SELECT * FROM v WHERE substr(sha, 1, 1) <> '7'"""))
def blob_cache_eviction(spark, sf):
    b = flat(spark, sf, "blobs")
    return inv.blob_cache_eviction(b, b.filter("substring(sha, 1, 1) = '7'"), NOW, 30 * DAY, 200_000)


@query("deps_cache_eviction", "WIN15 P11", oracle(["blobs"], """
e AS (SELECT store, sha AS key, CASE WHEN substr(sha, 1, 1) = 'a' THEN 0 ELSE size_bytes END AS b, substr(sha, 1, 1) = 'a' AS damaged, substr(sha, 2, 1) IN ('1', '2') AS leased, mtime_ms FROM blobs),
t AS (SELECT store, sum(b) AS total FROM e GROUP BY 1),
f AS (SELECT e.*, total, sum(b) OVER (PARTITION BY e.store ORDER BY mtime_ms, key) - b AS before FROM e JOIN t ON t.store = e.store WHERE NOT leased AND NOT damaged)
SELECT store, key, 'lru' AS why FROM f WHERE before < total - 300000 UNION ALL SELECT store, key, 'damaged' FROM e WHERE damaged AND NOT leased"""))
def deps_cache_eviction(spark, sf):
    e = flat(spark, sf, "blobs").selectExpr("store", "sha AS key", "if(substring(sha, 1, 1) = 'a', 0, size_bytes) AS size_bytes", "substring(sha, 1, 1) = 'a' AS damaged", "substring(sha, 2, 1) IN ('1', '2') AS leased", "mtime_ms AS last_used_ms")
    return inv.deps_cache_eviction(e, 300_000)


DIRS = "SELECT ticket_id AS dir_id, CASE WHEN ticket_id % 6 <> 0 THEN concat('o', CAST(ticket_id AS STRING)) END AS lane_id, created_ms AS mtime_ms, ticket_id % 19 = 0 AS tombstoned, ticket_id % 23 = 0 AS publisher_alive, ticket_id % 29 = 0 AS marker_pending, ticket_id % 2 = 0 AS terminal, ticket_id % 3 <> 0 AS has_work FROM"


@query("ticket_dir_verdicts", "RET02 JON20", oracle(["tickets"], f"""
d AS ({DIRS} tickets), lv AS (SELECT DISTINCT 'o' || ticket_id::VARCHAR AS id FROM tickets WHERE state IN ('queued', 'running') AND ticket_id % 4 = 1)
SELECT dir_id, CASE WHEN tombstoned OR publisher_alive OR (lane_id IS NOT NULL AND (lv.id IS NOT NULL OR marker_pending)) THEN 'keep' WHEN 1000000000000 - mtime_ms >= 60000000000 THEN 'whole' WHEN terminal AND has_work THEN 'work' ELSE 'keep' END AS verdict FROM d LEFT JOIN lv ON lv.id = d.lane_id"""))
def ticket_dir_verdicts(spark, sf):
    t = flat(spark, sf, "tickets")
    live = t.filter("state IN ('queued', 'running') AND ticket_id % 4 = 1").select(F.concat(F.lit("o"), F.col("ticket_id").cast("string")).alias("id"))
    return inv.ticket_dir_verdicts(spark.sql(DIRS + " {t}", t=t), live, 1_000_000_000_000, 60_000_000_000)


UUID = "concat(substr(s, 1, 8), '-', substr(s, 9, 4), '-', substr(s, 13, 4), '-', substr(s, 17, 4), '-', substr(s, 21, 12))"


@query("retired_files", "RET03 JON20", oracle(["blobs"], f"""
f AS (SELECT sha AS s, mtime_ms, CASE WHEN substr(sha, 1, 1) < '8' THEN 'logs' ELSE 'results' END AS kind FROM blobs),
g AS (SELECT DISTINCT {UUID} AS id, kind, mtime_ms, CASE WHEN substr(s, 2, 1) = '0' THEN '.tmp' WHEN kind = 'logs' THEN '.log' ELSE '.json' END AS ext FROM f)
SELECT id || ext AS name, kind FROM g WHERE ext <> '.tmp' AND {NOW} - mtime_ms >= {10 * DAY} AND substr(id, 3, 1) NOT IN ('5', '6')"""))
def retired_files(spark, sf):
    f = flat(spark, sf, "blobs").selectExpr("sha AS s", "mtime_ms", "if(substring(sha, 1, 1) < '8', 'logs', 'results') AS kind").selectExpr(
        "kind", "mtime_ms", f"{UUID} AS uid", "CASE WHEN substr(s, 2, 1) = '0' THEN '.tmp' WHEN kind = 'logs' THEN '.log' ELSE '.json' END AS ext").distinct()
    files = f.selectExpr("concat(uid, ext) AS name", "kind", "mtime_ms")
    return inv.retired_files(files, f.filter("substring(uid, 3, 1) IN ('5', '6')").selectExpr("uid AS id"), NOW, 10 * DAY).select("name", "kind")


@query("prunable_log_chunks", "RET04", oracle(["tickets"], f"""
tb AS ({TB} tickets), c AS (SELECT l_orderkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END AS ticket_id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT c.ticket_id, n FROM c LEFT JOIN tb ON tb.ticket_id = c.ticket_id WHERE tb.ticket_id IS NULL OR (state IN ('finished', 'lost') AND finished_ms < 900000000000 - 3600000)"""))
def prunable_log_chunks(spark, sf):
    chunks = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 100_000_000).otherwise(0)).alias("ticket_id"))
    return inv.prunable_chunks(chunks, _tickets(spark, sf), 900_000_000_000).groupBy("ticket_id").agg(F.count("*").alias("n"))


@query("prunable_claim_requests", "RET06", oracle(["tickets"], f"""
tb AS ({TB} tickets), c AS (SELECT l_orderkey AS ticket_id, epoch_us(l_shipdate) // 1000 AS created_ms FROM lineitem)
SELECT c.ticket_id, c.created_ms, count(*) AS n FROM c JOIN tb ON tb.ticket_id = c.ticket_id WHERE c.created_ms < 900000000000 - 86400000 AND state IN ('finished', 'lost') AND finished_ms < 900000000000 - 86400000 GROUP BY 1, 2"""))
def prunable_claim_requests(spark, sf):
    claims = flat(spark, sf, "jobs").select(F.col("group_id").alias("ticket_id"), F.col("enqueued_ms").alias("created_ms"))
    return inv.prunable_claims(claims, _tickets(spark, sf), 900_000_000_000).groupBy("ticket_id", "created_ms").agg(F.count("*").alias("n"))


@query("canonical_objects", "SRC07 SCL17", oracle(["store_journal"], """
p AS (SELECT store, CASE seq % 3 WHEN 0 THEN path WHEN 1 THEN 'manifests/j' || seq::VARCHAR || '.json' ELSE 'tmp/' || path END AS path, sha, seq FROM store_journal)
SELECT path, CASE WHEN seq % 3 = 0 THEN 'blob' ELSE 'manifest' END AS object_kind, CASE WHEN seq % 3 = 0 THEN sha END AS object_sha, count(*) AS n FROM p WHERE seq % 3 <> 2 GROUP BY 1, 2, 3"""))
def canonical_objects(spark, sf):
    j = flat(spark, sf, "store_journal").selectExpr("CASE seq % 3 WHEN 0 THEN path WHEN 1 THEN concat('manifests/j', seq, '.json') ELSE concat('tmp/', path) END AS path", "size_bytes")
    return inv.canonical_objects(j).groupBy("path", "object_kind", "object_sha").agg(F.count("*").alias("n"))
