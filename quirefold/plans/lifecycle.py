"""Event-driven state as batch queries: delivery, outbox, leases, generations, limits, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import tables as V
from .registry import query

NOW = "1998-01-01 00:00:00"
STAGES = {"uploaded": 1, "started": 2, "chunks_ready": 3, "indexed": 4}
_now = lambda: F.lit(NOW).cast("timestamp_ntz")


@query("SELECT event_id, count(*) AS n, min(payload_digest) AS first_digest FROM v_deliveries GROUP BY 1 HAVING count(DISTINCT payload_digest) = 1")
def inbox_dedup(t):
    """One row for each event id that always came with the same payload."""
    return V.deliveries(t).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("payload_digest").alias("first_digest"), F.max("payload_digest").alias("l")).where("first_digest = l").drop("l")


@query("SELECT event_id, count(DISTINCT payload_digest) AS n_digests FROM v_deliveries GROUP BY 1 HAVING count(DISTINCT payload_digest) > 1")
def inbox_conflicts(t):
    return V.deliveries(t).groupBy("event_id").agg(F.count_distinct("payload_digest").alias("n_digests")).where("n_digests > 1")


@query("""SELECT book_id, max(CASE kind WHEN 'uploaded' THEN 1 WHEN 'started' THEN 2 WHEN 'chunks_ready' THEN 3 WHEN 'indexed' THEN 4 ELSE 0 END) AS stage, count(DISTINCT event_id) AS n_events,
count(*) FILTER (WHERE kind = 'failed') AS n_failed FROM v_facts f WHERE lifecycle_version = (SELECT max(lifecycle_version) FROM v_facts g WHERE g.book_id = f.book_id) GROUP BY 1""")
def book_stage_projection(t):
    """Furthest stage of each book in its newest lifecycle; older versions are stale and ignored."""
    f = V.facts(t)
    f = f.withColumn("newest", F.max("lifecycle_version").over(Window.partitionBy("book_id"))).where("lifecycle_version = newest")
    stage = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in STAGES.items()], F.lit(0))
    return f.groupBy("book_id").agg(F.max(stage).alias("stage"), F.count_distinct("event_id").alias("n_events"), F.count_if(F.col("kind") == "failed").alias("n_failed"))


@query("SELECT DISTINCT event_id, aggregate_id, sequence FROM v_outbox o WHERE NOT published AND NOT EXISTS (SELECT 1 FROM v_outbox p WHERE p.aggregate_id = o.aggregate_id AND NOT p.published AND p.sequence < o.sequence)")
def outbox_head(t):
    """The first unpublished event of each aggregate: an aggregate, not a theta join."""
    return V.outbox(t).where("NOT published").groupBy("aggregate_id").agg(F.min_by("event_id", "sequence").alias("event_id"), F.min("sequence").alias("sequence"))


@query(f"SELECT event_id, next_attempt_at FROM v_outbox WHERE NOT published AND next_attempt_at <= TIMESTAMP '{NOW}' ORDER BY next_attempt_at, event_id LIMIT 32")
def outbox_due(t):
    return V.outbox(t).where(~F.col("published") & (F.col("next_attempt_at") <= _now())).orderBy("next_attempt_at", "event_id").limit(32).select("event_id", "next_attempt_at")


@query(f"SELECT count(*) AS backlog, coalesce(floor(epoch(TIMESTAMP '{NOW}') - epoch(min(next_attempt_at))), 0)::BIGINT AS oldest_s FROM v_outbox WHERE NOT published")
def outbox_backlog(t):
    age = F.unix_timestamp(_now().cast("timestamp")) - F.unix_timestamp(F.min("next_attempt_at").cast("timestamp"))
    return V.outbox(t).where("NOT published").agg(F.count(F.lit(1)).alias("backlog"), F.coalesce(age, F.lit(0)).cast("long").alias("oldest_s"))


@query("SELECT o_orderkey AS aggregate_id, coalesce(max(sequence), -1) + 1 AS next_sequence FROM orders LEFT JOIN v_outbox ON aggregate_id = o_orderkey GROUP BY 1")
def next_sequence(t):
    known = V.outbox(t).groupBy("aggregate_id").agg(F.max("sequence").alias("m"))
    return t("orders").select(F.col("o_orderkey").alias("aggregate_id")).join(known, "aggregate_id", "left").groupBy("aggregate_id").agg((F.coalesce(F.max("m"), F.lit(-1)) + 1).alias("next_sequence"))


@query("SELECT event_id, least(5 * pow(2, least(attempts, 8)), 300)::BIGINT AS exponential_s, least(300, attempts * attempts + 1)::BIGINT AS quadratic_s FROM v_outbox WHERE NOT published")
def retry_backoff(t):
    a = F.col("attempts")
    return V.outbox(t).where("NOT published").select("event_id", F.least(F.lit(5) * F.pow(F.lit(2), F.least(a, F.lit(8))), F.lit(300.0)).cast("long").alias("exponential_s"), F.least(F.lit(300), a * a + 1).cast("long").alias("quadratic_s"))


@query(f"SELECT event_id, attempts FROM v_outbox WHERE NOT published AND next_attempt_at + INTERVAL 30 DAY <= TIMESTAMP '{NOW}'")
def lease_expired(t):
    return V.outbox(t).where(~F.col("published") & (F.col("next_attempt_at") + F.expr("INTERVAL 30 DAY") <= _now())).select("event_id", "attempts")


@query(f"SELECT aggregate_id, count(*) AS stale, count(*) FILTER (WHERE attempts >= 5) AS exhausted, CASE WHEN count(*) FILTER (WHERE attempts >= 5) > 0 THEN 'failed' ELSE 'pending' END AS next_state FROM v_outbox WHERE NOT published AND next_attempt_at <= TIMESTAMP '{NOW}' - INTERVAL 60 DAY GROUP BY 1")
def stale_recovery(t):
    s = V.outbox(t).where(~F.col("published") & (F.col("next_attempt_at") <= _now() - F.expr("INTERVAL 60 DAY")))
    s = s.groupBy("aggregate_id").agg(F.count(F.lit(1)).alias("stale"), F.count_if(F.col("attempts") >= 5).alias("exhausted"))
    return s.withColumn("next_state", F.when(F.col("exhausted") > 0, "failed").otherwise("pending"))


@query("SELECT book_id, bool_or(kind = 'uploaded') AS original, bool_or(kind = 'chunks_ready') AS artifacts, bool_or(kind = 'indexed') AS indexed, bool_or(kind = 'uploaded') AND bool_or(kind = 'chunks_ready') AND bool_or(kind = 'indexed') AS tombstone FROM v_facts GROUP BY 1")
def deletion_barrier(t):
    f = V.facts(t).groupBy("book_id").agg(*[F.bool_or(F.col("kind") == k).alias(n) for k, n in (("uploaded", "original"), ("chunks_ready", "artifacts"), ("indexed", "indexed"))])
    return f.withColumn("tombstone", F.col("original") & F.col("artifacts") & F.col("indexed"))


@query("""SELECT object_id, modified FROM (SELECT concat('book-', p_partkey) AS object_id, TIMESTAMP '2024-01-01' + to_minutes(CAST(p_partkey AS INTEGER)) AS modified FROM part) o
WHERE modified < TIMESTAMP '2024-02-01' - INTERVAL 7 DAY AND NOT EXISTS (SELECT 1 FROM v_books b WHERE b.book_id = o.object_id)""")
def orphans_anti_join(t):
    """Objects past their grace that no book refers to."""
    o = t("part").select(F.concat(F.lit("book-"), F.col("p_partkey").cast("string")).alias("object_id"), F.timestamp_micros((F.lit(1704067200) + F.col("p_partkey") * 60) * 1_000_000).cast("timestamp_ntz").alias("modified"))
    old = o.where(F.col("modified") < F.lit("2024-02-01").cast("timestamp_ntz") - F.expr("INTERVAL 7 DAY"))
    return old.join(V.books(t).select("book_id"), F.col("object_id") == F.col("book_id"), "left_anti")


@query("SELECT book_id, arg_max(job_id, lifecycle_version) AS active_job_id, max(lifecycle_version) AS lifecycle_version FROM v_index_jobs WHERE state = 'indexed' GROUP BY 1")
def generation_promotion(t):
    return V.index_jobs(t).where("state = 'indexed'").groupBy("book_id").agg(F.max_by("job_id", "lifecycle_version").alias("active_job_id"), F.max("lifecycle_version").alias("lifecycle_version"))


@query("SELECT f.job_id AS failed_job_id, arg_max(o.job_id, o.lifecycle_version) AS restored_job_id FROM v_index_jobs f LEFT JOIN v_index_jobs o ON o.book_id = f.book_id AND o.state = 'indexed' AND o.lifecycle_version < f.lifecycle_version WHERE f.state <> 'indexed' GROUP BY 1")
def generation_rollback(t):
    """For jobs that did not finish: the newest earlier generation, if there is one."""
    jobs = V.index_jobs(t)
    o = jobs.where("state = 'indexed'").select("book_id", F.col("job_id").alias("old"), F.col("lifecycle_version").alias("v"))
    j = jobs.where("state <> 'indexed'").join(o, "book_id", "left").withColumn("v", F.when(F.col("v") < F.col("lifecycle_version"), F.col("v")))
    return j.groupBy(F.col("job_id").alias("failed_job_id")).agg(F.max_by("old", "v").alias("restored_job_id"))


@query("SELECT j.job_id, coalesce(array_to_string(list(o.job_id ORDER BY o.lifecycle_version, o.job_id) FILTER (WHERE o.job_id IS NOT NULL), ','), '') AS prior FROM v_index_jobs j LEFT JOIN v_index_jobs o ON o.book_id = j.book_id AND o.state = 'indexed' AND o.lifecycle_version < j.lifecycle_version GROUP BY 1")
def prior_generations(t):
    at = Window.partitionBy("book_id").orderBy("lifecycle_version").rangeBetween(Window.unboundedPreceding, -1)
    prior = F.collect_list(F.when(F.col("state") == "indexed", F.struct("lifecycle_version", "job_id"))).over(at)
    return V.index_jobs(t).select("job_id", F.array_join(F.transform(F.sort_array(prior), lambda x: x["job_id"]), ",").alias("prior"))


@query("""SELECT book_id, created_at, page FROM (SELECT book_id, created_at, row_number() OVER (ORDER BY created_at DESC, book_id DESC) AS rn FROM v_books), (VALUES (1), (2)) p(page) WHERE rn > (page - 1) * 20 AND rn <= page * 20""")
def keyset_page(t):
    """Two pages by the cursor (created_at, book_id), newest first; the second begins after the first one's last row."""
    b = V.books(t).select("book_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))
    first = b.orderBy(F.desc("created_at"), F.desc("book_id")).limit(20)
    cursor = first.orderBy("created_at", "book_id").limit(1).select(F.col("created_at").alias("c"), F.col("book_id").alias("i"))
    rest = b.join(F.broadcast(cursor), (F.col("created_at") < F.col("c")) | ((F.col("created_at") == F.col("c")) & (F.col("book_id") < F.col("i")))).select("book_id", "created_at")
    second = rest.orderBy(F.desc("created_at"), F.desc("book_id")).limit(20)
    return first.withColumn("page", F.lit(1)).union(second.withColumn("page", F.lit(2)))


@query("SELECT book_id, min(occurred_at) AS first_at, max(occurred_at) AS last_at, count(*) AS hits FROM v_deliveries GROUP BY 1")
def upsert_merge(t):
    """Insert or merge with LEAST, GREATEST and increment: one aggregate over old and new rows."""
    return V.deliveries(t).groupBy("book_id").agg(F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.count(F.lit(1)).alias("hits"))


@query("SELECT book_id, max(n) AS version, arg_max(kind, n) AS kind FROM v_facts GROUP BY 1")
def status_conflation(t):
    n = F.substring("event_id", 4, 20).cast("long")
    return V.facts(t).groupBy("book_id").agg(F.max(n).alias("version"), F.max_by("kind", n).alias("kind"))


@query("SELECT minute, count(DISTINCT book_id) AS pending, count(DISTINCT book_id) > 3 AS resync FROM (SELECT date_trunc('minute', occurred_at) AS minute, book_id FROM v_facts) GROUP BY 1")
def subscriber_overflow(t):
    """Pending keys of a subscriber in each interval; over the cap it is told to resync once."""
    return V.facts(t).groupBy(F.date_trunc("minute", F.col("occurred_at").cast("timestamp")).cast("timestamp_ntz").alias("minute")).agg(F.count_distinct("book_id").alias("pending")).withColumn("resync", F.col("pending") > 3)


@query("SELECT book_id, hour, count(*) AS n, greatest(count(*) - 2, 0) AS rejected FROM (SELECT book_id, date_trunc('hour', occurred_at) AS hour FROM v_facts) GROUP BY ALL")
def rate_limit_fixed_window(t):
    return V.facts(t).groupBy("book_id", F.date_trunc("hour", F.col("occurred_at").cast("timestamp")).cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.count(F.lit(1)) - 2, F.lit(0)).alias("rejected"))


@query()
def rate_limit_anchored(t):
    """Windows that begin at a key's first event and again at the first after they elapsed: a fold over the key's times."""
    hour = 3_600_000_000
    times = V.facts(t).groupBy("book_id").agg(F.sort_array(F.collect_list(F.unix_micros(F.col("occurred_at").cast("timestamp")))).alias("times"))
    start = F.struct(F.lit(-(10**18)).alias("opened"), F.lit(0).alias("n"), F.lit(0).alias("windows"), F.lit(0).alias("rejected"))

    def step(a, x):
        fresh = x - a["opened"] >= hour
        n = F.when(fresh, 1).otherwise(a["n"] + 1)
        return F.struct(F.when(fresh, x).otherwise(a["opened"]).alias("opened"), n.alias("n"), (a["windows"] + fresh.cast("int")).alias("windows"), (a["rejected"] + (n > 2).cast("int")).alias("rejected"))

    return times.select("book_id", F.aggregate("times", start, step).alias("a"), F.size("times").alias("n_events")).select("book_id", "n_events", "a.windows", "a.rejected")


@query("SELECT event_type AS phase, le, count(*) FILTER (WHERE value <= le) AS cumulative, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (10.0), (50.0), (100.0), (500.0)) b(le) GROUP BY ALL")
def phase_histogram(t):
    """Cumulative buckets; one conditional count a bucket, no row is repeated."""
    edges = [10.0, 50.0, 100.0, 500.0]
    a = t("events").groupBy(F.col("event_type").alias("phase")).agg(*[F.count_if(F.col("value") <= e).alias(f"b{i}") for i, e in enumerate(edges)], F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    rows = F.explode(F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, e in enumerate(edges)])).alias("x")
    return a.select("phase", "n", "total", rows).select("phase", "x.le", "x.cumulative", "n", "total")


@query("SELECT l.kind AS outcome, count(f.event_id) AS n FROM (VALUES ('uploaded'), ('started'), ('chunks_ready'), ('indexed'), ('failed'), ('deleted')) l(kind) LEFT JOIN v_facts f ON f.kind = l.kind GROUP BY 1")
def outcome_counts(t):
    """Counters over a closed set of labels, zeros included."""
    f = V.facts(t)
    labels = f.sparkSession.createDataFrame([(k,) for k in (*STAGES, "failed", "deleted")], "outcome string")
    return labels.join(f.groupBy(F.col("kind").alias("outcome")).agg(F.count(F.lit(1)).alias("n")), "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_type AS phase, max(value) FILTER (WHERE rn = ceil(0.95 * n)) AS p95, round(avg(value), 6) AS mean FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1")
def p95_nearest_rank(t):
    """Nearest rank, not interpolated: counts of distinct values first, so a task holds values and not rows."""
    e = t("events").groupBy(F.col("event_type").alias("phase"), "value").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("phase")
    e = e.withColumn("upto", F.sum("k").over(w.orderBy("value"))).withColumn("n", F.sum("k").over(w))
    return e.groupBy("phase").agg(F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * 0.95), F.col("value"))).alias("p95"), F.round(F.sum(F.col("value") * F.col("k")) / F.sum("k"), 6).alias("mean"))
