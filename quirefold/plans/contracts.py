"""Contracts: what is accepted, who may see it, how it is named, and where it goes next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import websearch
from ..operators import blocks
from ..operators.selection import first_reason
from ..sources import tables as V
from .registry import query

NOW = "1998-01-01 00:00:00"

# Phrases that speak about the task instead of the passage.
META_PHRASES = [
    "the user asks", "user asks", "the passage is about", "the passage discusses", "the passage describes", "the excerpt is about", "the excerpt describes",
    "this passage", "this excerpt", "the supplied retrieval passage", "return plain text only", "return a json object", "treat the passage as data",
    "summarize the supplied retrieval passage",
]
#: Characters that no shown text may hold.
UNSAFE = r"[\p{Cc}\p{Cf}\x{2028}\x{2029}\x{FFFD}]"


@query(r"""SELECT query_id, n, CASE WHEN n = 0 THEN 'empty' WHEN n > 2000 THEN 'too_long' END AS reason, sha256(q) AS digest, CAST(least(wanted, 20) AS BIGINT) AS limit_used, CAST(least(wanted, 20) * 2 AS BIGINT) AS page_size, CAST(least(wanted, 20) * 4 AS BIGINT) AS budget
FROM (SELECT query_id, q, length(q) AS n, CASE WHEN length(q) % 30 = 0 THEN 5 ELSE length(q) % 30 END AS wanted FROM (SELECT query_id, regexp_replace(question, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') AS q FROM v_questions))""")
def query_validate(t):
    """Trimmed questions of 1 to 2000 code points, limits of 5 unless told and 20 at most, and the candidate budgets they give."""
    q = V.questions(t).select("query_id", F.regexp_replace("question", r"^[ \t\n\r]+|[ \t\n\r]+$", "").alias("q")).withColumn("n", F.length("q").cast("long"))
    wanted = F.when(F.col("n") % 30 == 0, 5).otherwise(F.col("n") % 30)
    limit = F.least(wanted, F.lit(20)).cast("long")
    reason = first_reason([(F.col("n") == 0, "empty"), (F.col("n") > 2000, "too_long")])
    return q.select("query_id", "n", reason.alias("reason"), F.sha2(F.col("q").cast("binary"), 256).alias("digest"), limit.alias("limit_used"), (limit * 2).alias("page_size"), (limit * 4).alias("budget"))


@query("SELECT evidence_id FROM v_evidence WHERE len(list_filter(tags_norm, lambda x: lower(trim(x)) = 'en')) > 0 AND len(list_filter(tags_norm, lambda x: lower(trim(x)) = 't1')) > 0 AND year BETWEEN 1995 AND 2015")
def lexical_filter(t):
    """The metadata filter on the lexical side: every tag is held by one of the passage's, and the year lies in bounds."""
    held = lambda tag: F.exists("tags_norm", lambda x: F.lower(F.trim(x)) == tag)
    return V.evidence(t).where(held("en") & held("t1") & F.col("year").between(1995, 2015)).select("evidence_id")


@query("SELECT evidence_id FROM v_evidence WHERE coalesce(evidence_id, '') <> '' AND coalesce(book_id, '') <> '' AND trim(coalesce(passage, ''), ' \t\n') <> ''".replace("' \t\n'", "concat(' ', chr(9), chr(10))"))
def payload_complete(t):
    full = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("evidence_id", "book_id")] + [F.btrim(F.coalesce(F.col("passage"), F.lit("")), F.lit(" \t\n")) != ""]
    return V.evidence(t).where(reduce(lambda a, b: a & b, full)).select("evidence_id")


@query(f"""SELECT o_orderkey AS session_id, c_custkey AS user_id, c_mktsegment IN ('BUILDING', 'MACHINERY') AS can_manage, c_acctbal >= 1000 AS can_upload FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus <> 'F' AND c_acctbal >= 0 AND o_orderdate + INTERVAL 2000 DAYS > TIMESTAMP '{NOW}'""")
def session_principal(t):
    """Sessions (orders) that are open and not over, of users (customers) in good standing, with what these may do."""
    valid = (F.col("o_orderstatus") != "F") & (F.col("c_acctbal") >= 0) & (F.col("o_orderdate") + F.expr("INTERVAL 2000 DAYS") > F.lit(NOW).cast("timestamp_ntz"))
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).where(valid).select(F.col("o_orderkey").alias("session_id"), F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("can_manage"), (F.col("c_acctbal") >= 1000).alias("can_upload"))


@query("SELECT doc_id, CASE WHEN p.dims IS NULL THEN 'incompatible_profile' END AS reason, CAST(coalesce(p.dims, 0) AS BIGINT) AS dims FROM documents d LEFT JOIN (VALUES ('en', 64), ('de', 64), ('fr', 32)) p(lang, dims) ON d.lang = p.lang AND p.dims = 64")
def profile_compatible(t):
    """Documents whose profile is one of the few supported, by equality of names and numbers; the profile table has three rows."""
    own = t("documents").sparkSession.createDataFrame([("en", 64), ("de", 64), ("fr", 32)], "lang string, dims long").where("dims = 64")
    return t("documents").join(F.broadcast(own), "lang", "left").select("doc_id", F.when(F.col("dims").isNull(), "incompatible_profile").alias("reason"), F.coalesce("dims", F.lit(0)).cast("long").alias("dims"))


@query("""SELECT book_id, CASE WHEN length(title) NOT BETWEEN 1 AND 256 THEN 'title' WHEN length(author) NOT BETWEEN 1 AND 256 THEN 'author' WHEN year > 2020 THEN 'year' WHEN len(tags_norm) > 20 THEN 'tags' WHEN len(list_filter(tags_norm, lambda x: length(x) NOT BETWEEN 1 AND 64)) > 0 THEN 'tag' END AS reason FROM v_books""")
def metadata_bounds(t):
    out = lambda c, n: ~F.length(c).between(1, n)
    checks = [(out("title", 256), "title"), (out("author", 256), "author"), (F.col("year") > 2020, "year"), (F.size("tags_norm") > 20, "tags"), (F.exists("tags_norm", lambda x: out(x, 64)), "tag")]
    return V.books(t).select("book_id", first_reason(checks).alias("reason"))


@query("""SELECT j.job_id, j.state AS job_state, l.state AS book_state, coalesce((j.state, l.state) IN (('indexed', 'active'), ('indexed', 'reindexing'), ('pending', 'reindexing'), ('failed', 'reindexing'), ('failed', 'active')), false) AS coherent FROM v_index_jobs j JOIN v_book_lifecycle l USING (book_id)""")
def status_coherence(t):
    """Whether a job's and its book's states may stand together."""
    allowed = {"active": ["indexed", "failed"], "reindexing": ["indexed", "pending", "failed"]}
    fits = reduce(lambda a, b: a | b, [(F.col("book_state") == b) & F.col("job_state").isin(*js) for b, js in allowed.items()])
    both = V.index_jobs(t).select("job_id", "book_id", F.col("state").alias("job_state")).join(V.book_lifecycle(t).select("book_id", F.col("state").alias("book_state")), "book_id")
    return both.select("job_id", "job_state", "book_state", F.coalesce(fits, F.lit(False)).alias("coherent"))


@query(rf"SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '{UNSAFE}')) AS BIGINT) AS n_unsafe FROM conversations")
def safe_text(t):
    """Characters of a turn that must not be shown: controls, formats, line and paragraph separators, replacements."""
    return t("conversations").select("conv_id", "turn", F.size(F.regexp_extract_all("text", F.lit(UNSAFE), 0)).cast("long").alias("n_unsafe"))


_MARKERS = "[" + ", ".join(f"'{m}'" for m in META_PHRASES) + "]"


@query(rf"SELECT conv_id, turn, len(list_filter({_MARKERS}, lambda m: contains(x, m))) > 0 AS meta FROM (SELECT conv_id, turn, lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) AS x FROM conversations)")
def meta_phrases(t):
    x = F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")))
    return t("conversations").select("conv_id", "turn", reduce(lambda a, b: a | b, [x.contains(m) for m in META_PHRASES]).alias("meta"))


@query("SELECT job_id, book_id FROM v_index_jobs j WHERE NOT EXISTS (SELECT 1 FROM v_book_lifecycle l WHERE l.book_id = j.book_id AND l.state = 'deleting') AND NOT EXISTS (SELECT 1 FROM v_index_jobs k WHERE k.book_id = j.book_id AND k.lifecycle_version > j.lifecycle_version)")
def fenced_writes(t):
    """Jobs that may still write: their book is not being deleted and no newer lifecycle fences them off."""
    jobs = V.index_jobs(t)
    newest = jobs.groupBy("book_id").agg(F.max("lifecycle_version").alias("lifecycle_version"))
    going = V.book_lifecycle(t).where("state = 'deleting'").select("book_id")
    return jobs.join(newest, ["book_id", "lifecycle_version"], "left_semi").join(going, "book_id", "left_anti").select("job_id", "book_id")


@query("""SELECT j.job_id, s.shard, b.title, CAST(s.n AS BIGINT) AS n, l.state FROM (SELECT book_id, CAST((page_no - 1) // 8 AS INTEGER) AS shard, count(*) AS n FROM v_pages GROUP BY ALL) s JOIN v_index_jobs j USING (book_id) JOIN v_books b USING (book_id) JOIN v_book_lifecycle l USING (book_id) WHERE j.state <> 'failed'""")
def batch_work_items(t):
    """A batch with its job, the book's metadata and its lifecycle, all joined on the book."""
    batches = V.pages(t).groupBy("book_id", F.floor((F.col("page_no") - 1) / 8).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    jobs = V.index_jobs(t).where("state <> 'failed'").select("job_id", "book_id")
    return batches.join(jobs, "book_id").join(V.books(t).select("book_id", "title"), "book_id").join(V.book_lifecycle(t).select("book_id", "state"), "book_id").select("job_id", "shard", "title", "n", "state")


@query("""SELECT f.event_id, f.book_id, f.lifecycle_version, u.event_id AS upload_id, u.payload_digest FROM v_facts f JOIN (SELECT book_id, lifecycle_version, arg_max(event_id, (occurred_at, event_id)) AS event_id, arg_max(payload_digest, (occurred_at, event_id)) AS payload_digest FROM v_facts WHERE kind = 'uploaded' GROUP BY 1, 2) u USING (book_id, lifecycle_version) WHERE f.kind = 'failed'""")
def retry_payloads(t):
    """Each failure with the newest upload of its book and lifecycle, from which it can be tried again."""
    f = V.facts(t)
    order = F.struct("occurred_at", "event_id")
    uploads = f.where("kind = 'uploaded'").groupBy("book_id", "lifecycle_version").agg(F.max_by("event_id", order).alias("upload_id"), F.max_by("payload_digest", order).alias("payload_digest"))
    return f.where("kind = 'failed'").select("event_id", "book_id", "lifecycle_version").join(uploads, ["book_id", "lifecycle_version"]).select("event_id", "book_id", "lifecycle_version", "upload_id", "payload_digest")


@query("SELECT l_orderkey AS job_id, count(*) AS expected, count(*) FILTER (WHERE l_linestatus <> 'F') AS remaining, count(*) FILTER (WHERE l_linestatus <> 'F') = 0 AS final, coalesce(min(l_linenumber) FILTER (WHERE l_linestatus <> 'F'), 0) AS next_batch FROM lineitem GROUP BY 1")
def batch_completion(t):
    """Batches (lines) of each job (order) that are not done; a job is final once there is none."""
    left = F.col("l_linestatus") != "F"
    return t("lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count(F.lit(1)).alias("expected"), F.count_if(left).alias("remaining"), (F.count_if(left) == 0).alias("final"), F.coalesce(F.min(F.when(left, F.col("l_linenumber"))), F.lit(0)).alias("next_batch"))


@query("SELECT query_id, book_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, book_id) AS BIGINT) AS position FROM (SELECT query_id, book_id, max(score) AS score FROM v_scored WHERE score >= 0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, book_id) <= 5")
def documents_trimmed(t):
    """The five best books of each query by their best passage, in order again after the cut."""
    each = blocks.nearest(V.chunk_vectors(t), V.query_vectors(t), "vec_id", 1, "book_id")
    best = each.where("score >= 0").groupBy("query_id", "book_id").agg(F.max("score").alias("score"))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "book_id"))
    return best.withColumn("position", at.cast("long")).where("position <= 5").select("query_id", "book_id", "score", "position")


@query(f"SELECT event_id FROM v_outbox WHERE published AND next_attempt_at < TIMESTAMP '{NOW}' - INTERVAL 3 YEARS ORDER BY next_attempt_at, event_id LIMIT 500")
def bounded_expiry(t):
    """The oldest 500 entries that are over; one round of a clean-up that takes a bounded number at a time."""
    over = F.col("published") & (F.col("next_attempt_at") < F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 3 YEARS"))
    return V.outbox(t).where(over).orderBy("next_attempt_at", "event_id").limit(500).select("event_id")


@query(r"""SELECT doc_id, sha256(CASE WHEN length(x) > 400 THEN concat(regexp_replace(substr(x, 1, 399), ' +$', ''), '…') ELSE x END) AS digest, length(x) > 400 AS cut FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g')) AS x FROM documents)""")
def summary_text(t):
    """White space collapsed, and an ellipsis where more than 400 code points would be shown."""
    x = F.col("x")
    shown = F.when(F.length(x) > 400, F.concat(F.rtrim(F.substring(x, 1, 399)), F.lit("…"))).otherwise(x)
    return t("documents").select("doc_id", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r]+", " ")).alias("x")).select("doc_id", F.sha2(shown.cast("binary"), 256).alias("digest"), (F.length(x) > 400).alias("cut"))


_SENTENCES = r"list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\r]+', concat('\1', chr(1)), 'g'), chr(1)), lambda s: trim(s) <> '')"


@query(rf"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, sha256(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def sentence_split(t):
    """Sentences end at a full stop, a question or an exclamation mark before white space."""
    s = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"([.!?])[ \t\n\r]+", "$1\x01"), "\x01"), lambda x: F.trim(x) != "")
    return t("documents").select("doc_id", F.size(s).cast("long").alias("n"), F.sha2(F.array_join(s, "|").cast("binary"), 256).alias("digest"))


@query("SELECT evidence_id, concat(title, ' (', author, ', ', year, '), ', CASE WHEN page_start = page_end THEN concat('p. ', page_start) ELSE concat('pp. ', page_start, '–', page_end) END) AS citation FROM v_evidence")
def citation_text(t):
    place = F.when(F.col("page_start") == F.col("page_end"), F.concat(F.lit("p. "), F.col("page_start").cast("string"))).otherwise(F.concat(F.lit("pp. "), F.col("page_start").cast("string"), F.lit("–"), F.col("page_end").cast("string")))
    return V.evidence(t).select("evidence_id", F.concat("title", F.lit(" ("), "author", F.lit(", "), F.col("year").cast("string"), F.lit("), "), place).alias("citation"))


def _pads(key: bytes) -> tuple[bytes, bytes]:
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


_INNER, _OUTER = _pads(b"fixture-key")


@query(f"SELECT query_id, sha256(from_hex('{_OUTER.hex()}') || from_hex(sha256(from_hex('{_INNER.hex()}') || encode(concat('question', chr(0), question))))) AS mac FROM v_questions")
def keyed_fingerprint(t):
    """HMAC-SHA256 of a namespace and a value, made of two plain digests over the padded key."""
    message = F.concat(F.lit("question\0"), "question").cast("binary")
    inner = F.unhex(F.sha2(F.concat(F.lit(_INNER), message), 256))
    return V.questions(t).select("query_id", F.sha2(F.concat(F.lit(_OUTER), inner), 256).alias("mac"))


@query("SELECT book_id, sha256(concat(strlen(title), ':', title, strlen(author_norm), ':', author_norm, strlen(array_to_string(tags_norm, ',')), ':', array_to_string(tags_norm, ','))) AS digest FROM v_books")
def filter_fingerprint(t):
    return V.books(t).select("book_id", T.fingerprint(F.col("title"), F.col("author_norm"), F.array_join("tags_norm", ",")).alias("digest"))


@query("""SELECT book_id, cursor, concat('book-', json_extract_string(decode(from_base64(replace(replace(rpad(cursor, CAST(ceil(length(cursor) / 4.0) * 4 AS INTEGER), '='), '-', '+'), '_', '/'))), '$.id')) AS back
FROM (SELECT book_id, replace(replace(rtrim(base64(encode(concat('{"v":1,"at":"', strftime(created_at, '%Y-%m-%dT%H:%M:%S'), '","id":"', book_no, '"}'))), '='), '+', '-'), '/', '_') AS cursor FROM v_books)""")
def cursor_tokens(t):
    """Opaque cursors: base64url without padding of a small JSON object, and back again."""
    body = F.concat(F.lit('{"v":1,"at":"'), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('","id":"'), F.col("book_no").cast("string"), F.lit('"}'))
    token = F.rtrim(F.translate(F.base64(body.cast("binary")), "+/", "-_"), F.lit("="))
    padded = F.rpad("cursor", (F.ceil(F.length("cursor") / 4) * 4).cast("int"), "=")
    back = F.get_json_object(F.unbase64(F.translate(padded, "-_", "+/")).cast("string"), "$.id")
    return V.books(t).select("book_id", token.alias("cursor")).select("book_id", "cursor", F.concat(F.lit("book-"), back).alias("back"))


@query("""SELECT user_id, min(ts) AS revoked_at FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS use FROM events) WHERE use = 2 GROUP BY 1""")
def refresh_rotation(t):
    """A family (user) is revoked when one of its tokens (kinds of event) is shown for the second time."""
    use = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return t("events").select("user_id", "ts", use.alias("use")).where("use = 2").groupBy("user_id").agg(F.min("ts").alias("revoked_at"))


@query(r"SELECT sha256(lower(trim(question))) AS flight_key, min(query_id) AS leader, count(*) - 1 AS followers FROM v_questions GROUP BY 1")
def single_flight(t):
    """Equal questions in flight are asked once: the first leads, the others take its answer."""
    return V.questions(t).groupBy(F.sha2(F.lower(F.trim("question")).cast("binary"), 256).alias("flight_key")).agg(F.min("query_id").alias("leader"), (F.count(F.lit(1)) - 1).alias("followers"))


@query("SELECT event_id, CASE WHEN published THEN 'done' WHEN attempts >= 5 THEN 'dead_letter' WHEN attempts > 0 THEN 'retry' ELSE 'deliver' END AS route FROM v_outbox")
def delivery_route(t):
    return V.outbox(t).select("event_id", F.when(F.col("published"), "done").when(F.col("attempts") >= 5, "dead_letter").when(F.col("attempts") > 0, "retry").otherwise("deliver").alias("route"))


@query("SELECT j.job_id, CASE WHEN l.state = 'deleting' THEN 'deleted' WHEN j.state = 'failed' THEN 'failed' ELSE 'superseded' END AS reason FROM v_index_jobs j JOIN v_book_lifecycle l USING (book_id) WHERE j.state <> 'pending' AND (l.state = 'deleting' OR j.state = 'failed' OR (l.active_job_id IS NOT NULL AND j.job_id <> l.active_job_id AND j.lifecycle_version < l.lifecycle_version))")
def cleanup_due(t):
    """Jobs whose vectors may go: of books being deleted, failed, or behind a newer active generation."""
    life = V.book_lifecycle(t).select("book_id", F.col("state").alias("book_state"), "active_job_id", F.col("lifecycle_version").alias("latest"))
    j = V.index_jobs(t).where("state <> 'pending'").join(life, "book_id")
    due = "book_state = 'deleting' OR state = 'failed' OR (active_job_id IS NOT NULL AND job_id <> active_job_id AND lifecycle_version < latest)"
    return j.where(due).select("job_id", F.when(F.col("book_state") == "deleting", "deleted").when(F.col("state") == "failed", "failed").otherwise("superseded").alias("reason"))


@query("""SELECT event_id, CASE WHEN NOT regexp_full_match(event_id, '[A-Za-z0-9_-]{1,64}') THEN 'event_id' WHEN kind NOT IN ('uploaded', 'started', 'chunks_ready', 'indexed') THEN 'kind' WHEN lifecycle_version < 1 THEN 'version' WHEN NOT regexp_full_match(payload_digest, '[0-9a-f]{64}') THEN 'digest' WHEN occurred_at IS NULL THEN 'time' END AS reason FROM v_deliveries""")
def envelope_check(t):
    """The first fault of every delivered envelope; a fact of unknown kind is no command."""
    checks = [
        (~F.col("event_id").rlike("^[A-Za-z0-9_-]{1,64}$"), "event_id"), (~F.col("kind").isin("uploaded", "started", "chunks_ready", "indexed"), "kind"), (F.col("lifecycle_version") < 1, "version"),
        (~F.col("payload_digest").rlike("^[0-9a-f]{64}$"), "digest"), (F.col("occurred_at").isNull(), "time"),
    ]
    return V.deliveries(t).select("event_id", first_reason(checks).alias("reason"))


@query("""SELECT concat('events_total{type="', event_type, '"} ', count(*)) AS line FROM events GROUP BY event_type""")
def metrics_text(t):
    """Counters in the text form that scrapers read."""
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit('events_total{type="'), "event_type", F.lit('"} '), F.col("n").cast("string")).alias("line"))


@query("""SELECT event_id, CASE WHEN lifecycle_version < newest THEN 'stale' WHEN nth > 1 THEN 'repeat' ELSE 'applied' END AS outcome FROM (SELECT event_id, lifecycle_version, max(lifecycle_version) OVER (PARTITION BY book_id) AS newest, row_number() OVER (PARTITION BY book_id, lifecycle_version, kind ORDER BY occurred_at, event_id) AS nth FROM v_facts)""")
def lifecycle_commands(t):
    """A command counts once in its book's newest lifecycle; older lifecycles are fenced off."""
    newest = F.max("lifecycle_version").over(Window.partitionBy("book_id"))
    nth = F.row_number().over(Window.partitionBy("book_id", "lifecycle_version", "kind").orderBy("occurred_at", "event_id"))
    return V.facts(t).withColumns({"newest": newest, "nth": nth}).select("event_id", F.when(F.col("lifecycle_version") < F.col("newest"), "stale").when(F.col("nth") > 1, "repeat").otherwise("applied").alias("outcome"))


@query("""SELECT u.book_id, CASE WHEN min(r.occurred_at) <= min(u.at) + INTERVAL 15 DAYS THEN 'selected' ELSE 'fallback' END AS outcome FROM (SELECT book_id, min(occurred_at) AS at FROM v_facts WHERE kind = 'uploaded' GROUP BY 1) u LEFT JOIN v_facts r ON r.book_id = u.book_id AND r.kind = 'chunks_ready' AND r.occurred_at >= u.at GROUP BY 1""")
def selection_timeout(t):
    """Books whose result came in time after the first upload; the others go on without (the wait is 15 days on these facts)."""
    f = V.facts(t).withColumn("at", F.min(F.when(F.col("kind") == "uploaded", F.col("occurred_at"))).over(Window.partitionBy("book_id"))).where("at IS NOT NULL")
    ready = F.min(F.when((F.col("kind") == "chunks_ready") & (F.col("occurred_at") >= F.col("at")), F.col("occurred_at")))
    return f.groupBy("book_id").agg(ready.alias("ready"), F.min("at").alias("at")).select("book_id", F.when(F.col("ready") <= F.col("at") + F.expr("INTERVAL 15 DAYS"), "selected").otherwise("fallback").alias("outcome"))


@query("SELECT query_id, evidence_id FROM v_scored WHERE score >= (query_id % 300) / 1000.0")
def answer_visibility(t):
    """Passages at or above the least score that their own request asks for."""
    asked = V.query_vectors(t).withColumn("least", (F.col("query_id") % 300) / 1000)
    return blocks.reaching(V.chunk_vectors(t), asked, "evidence_id")


@query("""SELECT l_orderkey, l_linenumber, CAST(max(arrival - before) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) + before AS BIGINT) AS granted_at FROM (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_linenumber * 25 AS arrival, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem)""")
def token_pacing(t):
    """When each of a key's requests is let through, in order, if a unit takes a second: a running maximum instead of a loop."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    asked = t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_linenumber") * 25).alias("arrival"), F.coalesce(F.sum(F.col("l_quantity").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return asked.select("l_orderkey", "l_linenumber", (F.max(F.col("arrival") - F.col("before")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")).cast("long").alias("granted_at"))


#: Stated search strings, and the same as conditions on `` words `` in SQL.
SEARCHES = {
    "all": ("chapter section", "contains(d, ' chapter ') AND contains(d, ' section ')"),
    "phrase": ('"chapter 1" title', "contains(d, ' chapter 1 ') AND contains(d, ' title ')"),
    "either": ("forum or wiki", "(contains(d, ' forum ') OR contains(d, ' wiki '))"),
    "without": ('chapter -"section 3"', "contains(d, ' chapter ') AND NOT contains(d, ' section 3 ')"),
}
_DOC = r"concat(' ', array_to_string(list_filter(string_split_regex(regexp_replace(lower(concat_ws(' ', title, author, passage)), '[^\p{L}\p{N}]', ' ', 'g'), '\s+'), lambda w: w <> ''), ' '), ' ')"


@query("WITH d AS (SELECT evidence_id, " + _DOC + " AS d FROM v_evidence) " + " UNION ALL ".join(f"SELECT '{k}' AS search, evidence_id FROM d WHERE {c}" for k, (_, c) in SEARCHES.items()))
def lexical_websearch(t):
    """Search strings with phrases, alternatives and exclusions over title, author and passage; each passage is read once."""
    words = T.words(F.concat_ws(" ", "title", "author", "passage"))
    d = V.evidence(t).select("evidence_id", words.alias("w"))
    hits = F.array(*[F.when(websearch.matches(F.col("w"), text), F.lit(k)) for k, (text, _) in SEARCHES.items()])
    return d.select("evidence_id", F.explode(F.array_compact(hits)).alias("search")).select("search", "evidence_id")


_LINES = "SELECT book_id, page_no, line, pos, count(*) OVER (PARTITION BY book_id, page_no) AS n FROM (SELECT book_id, page_no, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM v_pages)"


@query(rf"""SELECT book_id, page_no, CAST(pos AS BIGINT) AS pos, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '\.{{4}}') THEN 'leader' WHEN pos = n AND regexp_full_match(trim(line), '[0-9]{{1,4}}') THEN 'page_footer'
WHEN upper(line) = line AND lower(line) <> line AND len(regexp_extract_all(line, '[^ ]+')) <= 14 THEN 'section_header' WHEN regexp_matches(line, '[ ][.]*[0-9]+[.]*$') THEN 'index_entry' ELSE 'text' END AS label FROM ({_LINES})""")
def layout_line_labels(t):
    """A label for every line of a page by its looks: dotted leaders, page numbers, capitals of at most 14 words, entries that end in a number."""
    line = F.col("line")
    rows = V.pages(t).withColumn("lines", F.split("text", "\n")).select("book_id", "page_no", F.size("lines").alias("n"), F.posexplode("lines").alias("at", "line"))
    label = (
        F.when(F.trim(line) == "", "blank").when(line.rlike(r"\.{4}"), "leader").when((F.col("at") + 1 == F.col("n")) & F.trim(line).rlike("^[0-9]{1,4}$"), "page_footer")
        .when((F.upper(line) == line) & (F.lower(line) != line) & (F.size(F.regexp_extract_all(line, F.lit("[^ ]+"), 0)) <= 14), "section_header").when(line.rlike("[ ][.]*[0-9]+[.]*$"), "index_entry").otherwise("text")
    )
    return rows.select("book_id", "page_no", (F.col("at") + 1).cast("long").alias("pos"), label.alias("label"))
