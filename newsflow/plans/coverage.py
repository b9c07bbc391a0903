"""Named queries that show operators one by one which others only use, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsflow.functions import entities as en
from newsflow.functions import fingerprints as fp
from newsflow.functions import semantics as sem
from newsflow.functions import text as tx
from newsflow.operators import cache, clustering, dml, enrich, first_source, graph, names, overview, topics
from newsflow.plans import analytics
from newsflow.plans import relational as rel
from newsflow.session import shared_folder
from newsflow.sources import events, sinks, staging, testbed
from newsflow.sources.testbed import table, with_ctes
from newsflow.streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_ctes(sql)
        return f

    return put


def of(name: str, *columns):
    """A projection of one of the driver's tables."""
    return lambda s, d: table(s, d, name).select(*(c() if callable(c) else c for c in columns))


# sources and streams

@query("S04_envelope", """SELECT event_id AS id, CASE WHEN event_id % 19 = 1 THEN 'invalid_json' WHEN event_id % 17 = 1 OR event_id < 1 THEN 'invalid_schema' WHEN event_id % 13 = 1 THEN 'invalid_event_id' WHEN event_id % 23 = 2 THEN 'missing_key' WHEN event_id % 29 = 3 THEN 'invalid_key' END AS reason FROM events""")
def envelope(s, d):
    raw = analytics.event_values(s, d).withColumn("key", F.when(F.col("event_id") % 23 == 2, None).when(F.col("event_id") % 29 == 3, F.lit("other:9")).otherwise(F.col("key")))
    return events.decode(raw.withColumnRenamed("event_id", "id")).select("id", "reason")


@query("K14_dead_letters", """SELECT CASE WHEN event_id % 23 = 2 THEN 'unknown:0' ELSE concat_ws(':', event_type, event_id) END AS key, CASE WHEN event_id % 19 = 1 THEN 'invalid_json' WHEN event_id % 17 = 1 OR event_id < 1 THEN 'invalid_schema' WHEN event_id % 13 = 1 THEN 'invalid_event_id' ELSE 'missing_key' END AS reason
    FROM events WHERE event_id % 19 = 1 OR event_id % 17 = 1 OR event_id < 1 OR event_id % 13 = 1 OR event_id % 23 = 2""")
def dead_letters(s, d):
    raw = analytics.event_values(s, d).withColumn("key", F.when(F.col("event_id") % 23 == 2, None).otherwise(F.col("key")))
    return events.rejected(events.decode(raw.drop("event_id"))).select("key", "reason")


query("S05_table_scan", "SELECT n_nationkey, n_name FROM nation")(lambda s, d: events.files(s, f"{d}/nation.parquet", columns=["n_nationkey", "n_name"]))
query("S07_projection", "SELECT doc_id, lang FROM documents")(lambda s, d: events.files(s, f"{d}/documents.parquet", columns=["doc_id", "lang"]))
query("S08_newest_first", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 100")(
    lambda s, d: events.days(table(s, d, "events"), "ts", "2024-01-10 00:00:00", "2024-01-20 00:00:00").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
)
query("S16_source_errors", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'flood_wait' WHEN 1 THEN 'not_found' WHEN 2 THEN 'private' ELSE 'inaccessible' END AS reason, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey % 500 AS INT) END AS retry_after, p_partkey % 4 IN (1, 2) AS permanent FROM part")(
    of("part", "p_partkey", lambda: events.source_error(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("FloodWait: "), F.col("p_partkey") % 500, F.lit(" s"))).when(F.col("p_partkey") % 4 == 1, "Invalid username").when(F.col("p_partkey") % 4 == 2, "Channel is PRIVATE").otherwise("timeout")).alias("e"))
)
_errors = QUERIES["S16_source_errors"]
QUERIES["S16_source_errors"] = lambda s, d: _errors(s, d).select("p_partkey", "e.*")
query("T02_processing_ids", "SELECT concat_ws(':', 'sentiment', event_type, event_id) AS id FROM events")(of("events", lambda: ingest.processing_id("sentiment", F.concat_ws(":", "event_type", "event_id")).alias("id")))
query("T04_backoff", "SELECT event_id, CAST(least(30, pow(2, event_id % 8)) AS INT) AS seconds FROM events")(of("events", "event_id", lambda: ingest.backoff(F.col("event_id") % 8).alias("seconds")))
query("T09_due", "SELECT user_id AS key, count(*) AS n, count(*) >= 5 OR min(ts) <= TIMESTAMP '2024-01-01 12:00:00' AS due FROM events GROUP BY 1")(
    lambda s, d: ingest.due(table(s, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at")), "2024-01-01 12:00:30", 5, 30)
)
query("T10_all_runs", "SELECT event_id, max_by(public_cluster_id, run_id) AS public_cluster_id FROM assignments WHERE cluster_id >= 0 GROUP BY 1")(rel.over(overview.of_all_runs))
query("T12_latencies", "SELECT event_type, count(*) AS n, sum(event_id % 600) / count(*) AS mean_seconds, CAST(max(event_id % 600) AS DOUBLE) AS max_seconds FROM events GROUP BY 1")(
    lambda s, d: ingest.latencies(table(s, d, "events").withColumn("done", F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 600)), "ts", "done", "event_type")
)

# writes

query("K08_claims", """WITH p AS (SELECT o_orderkey AS event_id, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END AS status, o_orderkey % 3 AS retry_count FROM orders WHERE o_orderkey % 2 = 0), a AS (SELECT o_orderkey AS event_id FROM orders WHERE o_orderkey % 3 = 0)
    SELECT event_id, CASE WHEN a.event_id IS NOT NULL AND coalesce(status, '') <> 'completed' THEN 'processing' ELSE status END AS status, CASE WHEN status IS NULL THEN 0 WHEN a.event_id IS NOT NULL AND status <> 'completed' THEN retry_count + 1 ELSE retry_count END AS retry_count,
    a.event_id IS NOT NULL AND coalesce(status, '') <> 'completed' AS claimed FROM p FULL JOIN a USING (event_id)""")(
    lambda s, d: (lambda o: dml.claim(o.where("event_id % 2 = 0").select("event_id", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), (F.col("event_id") % 3).alias("retry_count")), o.where("event_id % 3 = 0")))(table(s, d, "orders").withColumnRenamed("o_orderkey", "event_id"))
)


def _visibility(s, d):
    n = table(s, d, "nation")
    return dml.set_visibility(n.select(F.col("n_name").alias("channel"), (F.col("n_nationkey") % 2 == 0).alias("visible")), n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("channel"), (F.col("n_regionkey") > 1).alias("visible"), F.lit("root").alias("admin"), F.col("n_nationkey").alias("at")))


query("K16_visibility", "SELECT n_name AS channel, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey > 1 ELSE n_nationkey % 2 = 0 END AS visible FROM nation")(lambda s, d: _visibility(s, d)[0])
query("K16b_visibility_audit", "SELECT 'root' AS admin, 'set_visibility' AS action, n_name AS target_id, concat('{\"visible\":', n_nationkey % 2 = 0, '}') AS old_value, concat('{\"visible\":', n_regionkey > 1, '}') AS new_value, n_nationkey AS created_at FROM nation WHERE n_nationkey % 3 = 0")(lambda s, d: _visibility(s, d)[1])
query("K17_sessions", """WITH l AS (SELECT CAST(o_orderkey AS VARCHAR) AS token, o_custkey AS user_id, o_orderdate AS expires_at, o_orderkey % 5 = 0 AS used FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01')
    SELECT CASE WHEN used THEN sha256(concat_ws('|', token, '1996-01-01 00:00:00')) ELSE token END AS token, user_id, CASE WHEN used THEN TIMESTAMP '1996-01-08' ELSE expires_at END AS expires_at FROM l""")(
    lambda s, d: (lambda o: dml.rotate_sessions(o.select("token", "user_id", "expires_at"), o.where("k % 5 = 0"), "1996-01-01 00:00:00", 7))(table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("token"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("expires_at")))
)
query("O09_audit_page", "SELECT event_id AS id, ts AS created_at FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 5")(
    lambda s, d: dml.audit_page(table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("action")), "error", 20, 5).select("id", "created_at")
)
query("N17_graph_commands", """WITH c AS (SELECT DISTINCT ON (event_id // 3) event_id // 3 AS k, user_id AS id, event_id % 4 AS more, event_id AS t FROM events ORDER BY event_id // 3, event_id, user_id), f AS (SELECT id, sum(more) AS more, min(t) AS low, max(t) AS high FROM c WHERE k % 7 <> 0 GROUP BY 1),
    g AS (SELECT c_custkey AS id, 10 AS count, 50 AS first_seen, 60 AS last_seen FROM customer WHERE c_custkey % 2 = 0)
    SELECT id, coalesce(count, 0) + coalesce(more, 0) AS count, least(first_seen, low) AS first_seen, greatest(last_seen, high) AS last_seen FROM g FULL JOIN f USING (id)""")(
    lambda s, d: (lambda e: dml.applied_commands(table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit(10).cast("long").alias("count"), F.lit(50).cast("long").alias("first_seen"), F.lit(60).cast("long").alias("last_seen")), e, e.where("idempotency_key % 7 = 0").select("idempotency_key").distinct()))(
        table(s, d, "events").select(F.expr("event_id div 3").alias("idempotency_key"), F.col("user_id").alias("id"), (F.col("event_id") % 4).alias("increment"), F.col("event_id").alias("at")))
)

# filters and parameters

query("F02_optional", f"SELECT event_id FROM raw_messages WHERE channel = 'BUILDING' AND {rel.WINDOW}")(lambda s, d: sem.optional(sem.optional(testbed.raw_messages(s, d), "channel", "BUILDING"), "text", None).where(sem.within("message_date", rel.START, rel.END)).select("event_id"))
query("F14_pages", "SELECT * FROM (VALUES ('20', '0', 20, 0), ('x', 'y', 50, 0), ('900', '-4', 200, 0), ('0', '7', 1, 7), ('-3', '12', 1, 12)) AS v(asked_limit, asked_offset, page_limit, page_offset)")(
    lambda s, d: s.createDataFrame([(a, b, *overview.page(a, b)) for a, b in (("20", "0"), ("x", "y"), ("900", "-4"), ("0", "7"), ("-3", "12"))], "asked_limit string, asked_offset string, page_limit int, page_offset int")
)


def _stamp(suffix: str):
    return F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(suffix))


query("F15_times", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 IN (1, 2) THEN date_trunc('second', ts) - INTERVAL 150 MINUTE ELSE date_trunc('second', ts) END AS t FROM events")(
    of("events", "event_id", lambda: sem.utc_time(F.when(F.col("event_id") % 5 == 0, _stamp("Z")).when(F.col("event_id") % 5 == 1, _stamp(" 02:30")).when(F.col("event_id") % 5 == 2, _stamp("+02:30")).when(F.col("event_id") % 5 == 3, _stamp("")).otherwise("soon")).alias("t"))
)
query("F16_decoded_ids", "SELECT event_id, concat('run_b:', event_id, '+x%') AS id FROM events")(of("events", "event_id", lambda: sem.decoded_id(F.concat(F.lit("run_b%253A"), "event_id", F.lit("+x%2525"))).alias("id")))
_TYPE = "CASE p_partkey % 6 WHEN 0 THEN 'person' WHEN 1 THEN 'PER' WHEN 2 THEN 'Org' WHEN 3 THEN 'LOC' WHEN 4 THEN 'ALL' END"
query("F17_entity_types", f"SELECT p_partkey, CASE WHEN upper({_TYPE}) IN ('PERSON', 'PER') THEN 'PER' WHEN upper({_TYPE}) IN ('ORG', 'LOC') THEN upper({_TYPE}) ELSE 'MISC' END AS shown, CASE WHEN upper({_TYPE}) = 'PER' THEN 'PERSON' WHEN upper({_TYPE}) IN ('ORG', 'LOC') THEN upper({_TYPE}) END AS stored FROM part")(
    of("part", "p_partkey", lambda: sem.shown_type(F.expr(_TYPE)).alias("shown"), lambda: sem.stored_type(F.expr(_TYPE)).alias("stored"))
)

# joins and order

query("J01_fact_join", f"SELECT event_id, public_cluster_id, channel FROM ({rel.CLUSTERED})")(lambda s, d: overview.clustered(rel.relations(s, d), rel.START, rel.END).select("event_id", "public_cluster_id", "channel"))
query("J02_left_join", "SELECT event_id, channel, sentiment_label FROM raw_messages LEFT JOIN sentiment_results USING (event_id)")(lambda s, d: testbed.raw_messages(s, d).join(testbed.sentiment_results(s, d), "event_id", "left").select("event_id", "channel", "sentiment_label"))
query("J04_star_join", f"SELECT public_cluster_id, channel, entity_type, count(*) AS n FROM ({rel.CLUSTERED}) JOIN ner_results USING (event_id) GROUP BY ALL")(
    lambda s, d: (lambda r: overview.clustered(r, rel.START, rel.END).join(r.ner, "event_id").groupBy("public_cluster_id", "channel", "entity_type").agg(F.count("*").alias("n")))(rel.relations(s, d))
)
query("J05_expression_join", f"SELECT r_regionkey, count(*) AS n FROM ner_results JOIN region ON ascii({rel.KEY}) % 5 = r_regionkey GROUP BY 1")(lambda s, d: testbed.ner_results(s, d).join(table(s, d, "region"), F.ascii(sem.entity_key()) % 5 == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.count("*").alias("n")))
query("J06_theta_filter", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name")(
    lambda s, d: (lambda n: n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey and a.n_name <> b.n_name")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b")))(table(s, d, "nation"))
)
query("J10_run_totals", "WITH l AS (SELECT max_by(run_id, run_timestamp) AS run_id FROM cluster_runs), n AS (SELECT run_id, count(*) AS rows, count(DISTINCT cluster_id) AS clusters FROM assignments GROUP BY 1) SELECT run_id, rows, clusters, l.run_id IS NOT NULL AS latest FROM n LEFT JOIN l USING (run_id)".replace("l.run_id IS NOT NULL", "run_id = (SELECT run_id FROM l)"))(
    lambda s, d: (lambda r: r.assignments.groupBy("run_id").agg(F.count("*").alias("rows"), F.countDistinct("cluster_id").alias("clusters")).join(F.broadcast(overview.latest_run(r.runs).withColumn("l", F.lit(True))), "run_id", "left").select("run_id", "rows", "clusters", F.col("l").isNotNull().alias("latest")))(rel.relations(s, d))
)
query("J17_earliest_link", "WITH f AS (SELECT doc_id % 50 AS u, min(doc_id) AS first FROM documents GROUP BY 1) SELECT concat_ws(':', source, doc_id) AS event_id, CASE WHEN first = doc_id THEN 'unknown' ELSE 'exact_url' END AS source_type, CASE WHEN first = doc_id THEN 0.0 ELSE 0.92 END AS confidence, CASE WHEN first <> doc_id THEN (SELECT concat_ws(':', x.source, x.doc_id) FROM documents x WHERE x.doc_id = first) END AS source_event_id FROM documents JOIN f ON u = doc_id % 50")(
    lambda s, d: (lambda m: first_source.exact_sources(m, m).select("event_id", "source_type", "confidence", "source_event_id"))(
        analytics.source_messages(s, d).withColumns({"primary_url": F.concat(F.lit("u"), F.col("message_id") % 50), "reply_to_message_id": F.lit(None).cast("long"), "forward_from_message_id": F.lit(None).cast("long")}))
)
query("J18_lists_per_cluster", f"SELECT public_cluster_id, array_to_string(list_sort(list(DISTINCT channel)), '|') AS channels, min(message_date) AS first_seen FROM ({rel.CLUSTERED}) GROUP BY 1")(
    lambda s, d: overview.clustered(rel.relations(s, d), rel.START, rel.END).groupBy("public_cluster_id").agg(F.array_join(F.array_sort(F.collect_set("channel")), "|").alias("channels"), F.min("message_date").alias("first_seen"))
)
query("J19_merges", "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")(lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic"))
query("O01_mixed_order", "SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 200")(lambda s, d: table(s, d, "orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey"))
query("O02_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")(lambda s, d: table(s, d, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25).select("l_orderkey", "l_linenumber", "l_extendedprice"))
query("O05_stable_order", "SELECT event_id FROM raw_messages ORDER BY views % 10 DESC, message_date, event_id LIMIT 50")(lambda s, d: testbed.raw_messages(s, d).orderBy(F.desc(F.col("views") % 10), "message_date", "event_id").limit(50).select("event_id"))

# texts

query("X04_emoji", "SELECT doc_id, concat('a ', doc_id, ' b c') AS cleaned FROM documents")(of("documents", "doc_id", lambda: tx.cleaned(F.concat(F.lit("A \U0001f600\U0001f680 "), "doc_id", F.lit(" b✅ 中文 c\U0001fa71"))).alias("cleaned")))
query("X07_flags", "SELECT doc_id, regexp_matches(text, '(?i)(https?://|www\\.)[^\\s\\p{Z}]') AS has_urls, regexp_matches(text, '@[A-Za-z0-9_]') AS has_mentions, regexp_matches(text, '#[A-Za-z0-9_]') AS has_hashtags FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", tx.flags(F.col("text")).alias("f")).select("doc_id", "f.*"))
query("X10_detected", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'other' WHEN doc_id % 10 < 6 THEN 'und' WHEN doc_id % 3 = 0 THEN 'other' ELSE lang END AS language FROM documents")(
    of("documents", "doc_id", lambda: tx.detected_language(F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 3 == 0, "zh-cn").otherwise(F.col("lang")), (F.col("doc_id") % 10) / 10, F.lit("other")).alias("language"))
)
query("X11_squeezed", f"SELECT doc_id, {analytics.SQ.format('text')} AS plain FROM documents")(of("documents", "doc_id", lambda: tx.squeeze(F.col("text")).alias("plain")))
query("X13_labels", f"SELECT doc_id, CASE WHEN length(c) > 48 THEN concat(rtrim(c[1:48]), '...') ELSE c END AS label FROM (SELECT doc_id, {analytics.SQ.format('text')} AS c FROM documents)")(of("documents", "doc_id", lambda: tx.graph_label(F.col("text")).alias("label")))
query("X14_topic_labels", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'given' WHEN 1 THEN 'strict' WHEN 2 THEN concat(p_brand, ' / ', p_type) ELSE p_type[1:80] END AS label FROM part")(
    of("part", "p_partkey", lambda: tx.topic_label(F.when(F.col("p_partkey") % 4 == 0, "given"), F.when(F.col("p_partkey") % 4 == 1, "strict").otherwise(""), F.when(F.col("p_partkey") % 4 == 2, F.array("p_brand", "p_type", "p_brand")).otherwise(F.array().cast("array<string>")), F.col("p_type"), F.lit("id")).alias("label"))
)
query("X15_source_status", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'exact' WHEN n_nationkey % 4 = 0 THEN 'probable' ELSE 'unknown' END AS status FROM nation")(
    of("nation", "n_nationkey", lambda: tx.source_status(F.when(F.col("n_nationkey") % 3 == 0, "exact_url").otherwise("unknown"), F.when(F.col("n_nationkey") % 4 == 0, "quoted")).alias("status"))
)
query("X20_registry_status", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'validating' WHEN p_partkey % 5 = 1 THEN 'validation_failed' WHEN p_partkey % 3 > 0 THEN 'backfilling' WHEN p_partkey % 2 = 0 THEN 'live_enabled' ELSE 'ready' END AS status FROM part")(
    of("part", "p_partkey", lambda: tx.registry_status(F.when(F.col("p_partkey") % 5 == 0, "pending").otherwise("ok"), F.when(F.col("p_partkey") % 5 == 1, "validation_failed").when(F.col("p_partkey") % 2 == 0, "live_enabled").otherwise("known"), F.col("p_partkey") % 3).alias("status"))
)
query("X27_quotes", "SELECT p_partkey, p_partkey % 2 = 0 AS quoted FROM part")(
    of("part", "p_partkey", lambda: fp.quotes_match(F.concat(F.lit("He said «The price of  PART "), "p_partkey", F.lit(" is too high» again")), F.concat(F.lit("well, the price of part "), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).otherwise(-1), F.lit(" is  too high, they say"))).alias("quoted"))
)
query("X29_theme_scores", "SELECT p_partkey, round(0.6 * (p_partkey % 10) / 10 + 0.25 * (p_partkey % 4) / 4 + 0.15 * CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE exp(-(p_partkey % 48) / 24) END, 9) AS score FROM part")(
    of("part", "p_partkey", lambda: F.round(fp.theme_score((F.col("p_partkey") % 10) / 10, (F.col("p_partkey") % 4) / 4, F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 48)), 9).alias("score"))
)
_E = "exp((p_partkey % {0}) / 3.0)"
query("X30_softmax", "WITH e AS (SELECT p_partkey, [" + ", ".join(_E.format(k) for k in (5, 7, 3)) + "] AS e FROM part), p AS (SELECT p_partkey, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e) SELECT p_partkey, round(list_max(p), 9) AS score, CASE WHEN list_max(p) < 0.55 THEN 'neutral' ELSE ['negative', 'neutral', 'positive'][list_position(p, list_max(p))] END AS label FROM p")(
    lambda s, d: table(s, d, "part").select("p_partkey", fp.softmax(F.array(*((F.col("p_partkey") % k) / 3.0 for k in (5, 7, 3)))).alias("p")).select("p_partkey", F.round(F.array_max("p"), 9).alias("score"), fp.label_of(F.col("p"), enrich.LABELS).alias("label"))
)
query("X33_composite_buckets", "SELECT event_id, concat(coalesce(CASE WHEN event_id % 3 > 0 THEN event_type END, 'unknown'), '|', strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M:%S')) AS bucket FROM events")(
    of("events", "event_id", lambda: clustering.composite_bucket(F.when(F.col("event_id") % 3 > 0, F.col("event_type")), F.col("ts")).alias("bucket"))
)
query("X34_intervals", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 36 HOUR AND ts <= TIMESTAMP '2024-01-20 12:00:00'")(lambda s, d: (lambda now: table(s, d, "events").where((F.col("ts") > now - F.make_dt_interval(hours=F.lit(36))) & (F.col("ts") <= now)).select("event_id"))(F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")))
query("X36_numeric", "SELECT c_custkey, CAST(CAST(c_acctbal / 7 AS DECIMAL(12, 4)) AS DOUBLE) AS four, least(greatest(c_acctbal, 0), 5000) AS clamped, round(ln(abs(c_acctbal) + 1), 6) AS logged FROM customer")(
    of("customer", "c_custkey", lambda: (F.col("c_acctbal") / 7).cast("decimal(12,4)").cast("double").alias("four"), lambda: F.least(F.greatest("c_acctbal", F.lit(0.0)), F.lit(5000.0)).alias("clamped"), lambda: F.round(F.log(F.abs("c_acctbal") + 1), 6).alias("logged"))
)
query("X37_extremes", "SELECT doc_id, greatest(coalesce(quality, -1), toxic) AS high, least(quality, toxic) AS low FROM documents LEFT JOIN labels USING (doc_id)")(lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", F.greatest(F.coalesce("quality", F.lit(-1)), "toxic").alias("high"), F.least("quality", "toxic").alias("low")))
query("X38_strings", "SELECT c_custkey, concat('REQ-', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) AS id, length(c_name) AS size, lower(c_mktsegment) AS low FROM customer")(of("customer", "c_custkey", lambda: F.concat(F.lit("REQ-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("id"), lambda: F.length("c_name").alias("size"), lambda: F.lower("c_mktsegment").alias("low")))
query("X40_json_lists", "SELECT r_regionkey, coalesce(concat('[', string_agg(concat('{\"id\":', n_nationkey, ',\"name\":\"', n_name, '\"}'), ',' ORDER BY n_nationkey), ']'), '[]') AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 3 GROUP BY 1")(
    lambda s, d: table(s, d, "region").join(table(s, d, "nation").where("n_nationkey > 3"), F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.when(F.col("n_nationkey").isNotNull(), F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))))).alias("nations"))
)
query("X41_ordered_distinct", "SELECT p_partkey, CASE WHEN split_part(p_type, ' ', 1) = p_brand THEN p_brand ELSE concat(p_brand, '|', split_part(p_type, ' ', 1)) END AS names FROM part")(of("part", "p_partkey", lambda: F.array_join(F.array_distinct(F.array("p_brand", F.split("p_type", " ")[0], "p_brand")), "|").alias("names")))
query("X42_flattened", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat_ws('|', 'per', p_brand, 'loc') ELSE concat_ws('|', p_brand, 'loc') END AS names FROM part")(
    of("part", "p_partkey", lambda: F.array_join(en.flattened(F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("per"), F.col("p_brand"))), F.array("p_brand"), F.array(F.lit("loc"), F.col("p_brand"))), "|").alias("names"))
)
_NAME = "CASE p_partkey % 6 WHEN 0 THEN concat('12 ', p_partkey) WHEN 1 THEN 'A-b' WHEN 2 THEN 'Банк' WHEN 3 THEN 'банк развития' WHEN 4 THEN p_type END"
query("X44_noise", f"SELECT p_partkey, p_partkey % 6 IN (0, 1, 2, 5) AS noise FROM part")(of("part", "p_partkey", lambda: en.is_noise(F.expr(_NAME)).alias("noise")))
query("X45_synonyms", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Россия' END AS synonym, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'ООО' END AS bare FROM customer")(
    of("customer", "c_custkey", lambda: en.synonym(F.when(F.col("c_custkey") % 3 == 0, "РФ").otherwise(F.col("c_name")), F.lit("LOC")).alias("synonym"), lambda: en.without_legal_forms(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ООО "), "c_name", F.lit(" пао."))).otherwise("ООО")).alias("bare"))
)
query("X46_surface", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('Brand - ', p_partkey) ELSE concat('Big Bank Of ', p_partkey) END AS name FROM part")(
    of("part", "p_partkey", lambda: tx.surface(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("«Brand— — "), F.lit("("), "p_partkey", F.lit(")»"))).otherwise(F.concat(F.lit(" \"BIG BANK  OF "), "p_partkey", F.lit("\" ")))).alias("name"))
)
ORACLE_SQL["X46_surface"] = ORACLE_SQL["X46_surface"].replace("concat('Brand - ', p_partkey)", "concat('Brand- - ', p_partkey)")

# models and topics

query("M02_blank", "SELECT doc_id, 'neutral' AS label, 1.0 AS score FROM documents WHERE doc_id % 10 = 0")(lambda s, d: enrich.sentiment(table(s, d, "documents").where("doc_id % 10 = 0").withColumn("text", F.when(F.col("doc_id") % 20 == 0, " \n "))).select("doc_id", "label", "score"))
query("M03_label_names", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN 2 THEN 'negative' WHEN 3 THEN 'neutral' ELSE 'neutral' END AS label FROM part")(
    of("part", "p_partkey", lambda: enrich.normalized_label(F.expr("CASE p_partkey % 5 WHEN 0 THEN 'LABEL_0' WHEN 1 THEN 'LABEL_2' WHEN 2 THEN 'Neg' WHEN 3 THEN 'LABEL_1' ELSE 'other' END")).alias("label"))
)
query("M04_mean_probabilities", "SELECT p_partkey, (p_partkey % 10 / 10.0 + p_partkey % 4 / 4.0) / 2 AS first, (p_partkey % 7 / 10.0 + p_partkey % 3 / 4.0) / 2 AS second FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", enrich.mean_probabilities(*(F.array((F.col("p_partkey") % a) / n, (F.col("p_partkey") % b) / n) for a, b, n in ((10, 7, 10.0), (4, 3, 4.0)))).alias("p")).select("p_partkey", F.col("p")[0].alias("first"), F.col("p")[1].alias("second"))
)
query("M05_emotions", "SELECT p_partkey, round(greatest(p_partkey % 7 / 7.0, p_partkey % 5 / 5.0), 4) AS joy, round(p_partkey % 3 / 3.0, 4) AS fear FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", enrich.emotions(F.array(*map(F.lit, ("Joy", "happiness", "FEAR", "other"))), F.array((F.col("p_partkey") % 7) / 7.0, (F.col("p_partkey") % 5) / 5.0, (F.col("p_partkey") % 3) / 3.0, F.lit(9.0)), {"joy": "joy", "happiness": "joy", "fear": "fear"}).alias("e")).select("p_partkey", F.col("e")["joy"].alias("joy"), F.col("e")["fear"].alias("fear"))
)
query("M07_gate", "SELECT doc_id, lang IN ('ru', 'en') AND doc_id % 4 <> 0 AS analysed FROM documents")(
    lambda s, d: (lambda full, rest: full.select("doc_id", F.lit(True).alias("analysed")).unionByName(rest.select("doc_id", F.lit(False).alias("analysed"))))(*enrich.language_gate(table(s, d, "documents").select("doc_id", F.col("lang").alias("language"), F.when(F.col("doc_id") % 4 != 0, "full").alias("analysis_mode"))))
)
query("M09_canonical", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'UNO' WHEN 1 THEN 'Brand' ELSE 'Umbrella' END AS name FROM part")(of("part", "p_partkey", lambda: en.canonical(F.expr("CASE p_partkey % 3 WHEN 0 THEN 'UNO' WHEN 1 THEN 'bRAND' ELSE 'UMBRELLA' END")).alias("name")))
query("M11_full_names", """WITH p AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE concat(p_brand, ' ', p_type) END AS name FROM part), n AS (SELECT name, count(*) AS n, list_last(string_split(name, ' ')) AS surname FROM p GROUP BY 1),
    b AS (SELECT surname, name, row_number() OVER (PARTITION BY surname ORDER BY n DESC, length(name) DESC, name DESC) AS r FROM n WHERE contains(name, ' ')) SELECT surname, b.name FROM b WHERE r = 1 AND surname IN (SELECT name FROM n WHERE NOT contains(name, ' '))""")(
    lambda s, d: enrich.full_names(table(s, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.concat_ws(" ", "p_brand", "p_type")).alias("name")))
)
query("M14_report", """WITH p AS (SELECT o_orderkey % 3 AS a, o_orderkey % 5 % 3 AS p FROM orders), l AS (SELECT k, count(*) FILTER (a = k) AS n, count(*) FILTER (p = k) AS m, count(*) FILTER (a = k AND p = k) AS hit FROM p, range(3) AS u(k) GROUP BY 1)
    SELECT sum(hit) / sum(n) AS accuracy, avg(CASE WHEN hit = 0 THEN 0 ELSE 2 * hit / (n + m) END) AS macro_f1 FROM l""")(lambda s, d: enrich.classification_report(table(s, d, "orders").select((F.col("o_orderkey") % 3).alias("actual"), (F.col("o_orderkey") % 5 % 3).alias("predicted"))))
query("M14_topic_classifier")(lambda s, d: enrich.classification_report(enrich.train_topics(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")))[1]))
query("C06_global_labels", "WITH n AS (SELECT n_regionkey AS b, max(n_nationkey % 3) + 1 AS n FROM nation GROUP BY 1) SELECT n_name AS event_id, n_nationkey % 3 + (SELECT coalesce(sum(n), 0) FROM n WHERE b < n_regionkey) AS cluster_id, 1.0 AS probability FROM nation")(
    lambda s, d: clustering.global_labels(table(s, d, "nation").select(F.col("n_regionkey").alias("bucket"), F.col("n_name").alias("event_id"), (F.col("n_nationkey") % 3).alias("label"), F.lit(1.0).alias("probability"), F.col("n_regionkey").alias("first")))
)
query("C07_strategy", "SELECT n_regionkey AS run_id, max_by(CASE WHEN n_nationkey % 2 = 0 THEN 'density' ELSE 'similarity' END, n_nationkey) AS strategy FROM nation GROUP BY 1")(
    lambda s, d: clustering.run_strategy(table(s, d, "nation").select(F.col("n_regionkey").alias("run_id"), F.col("n_nationkey").alias("place"), F.when(F.col("n_nationkey") % 2 == 0, "density").otherwise("similarity").alias("strategy")))
)
query("C08_assignment_events", "SELECT event_id AS key, public_cluster_id AS topic, round(probability / 3, 6) AS probability FROM assignments")(
    lambda s, d: clustering.assignment_events(testbed.assignments(s, d).withColumns({"message_id": F.col("event_id").cast("long"), "channel": F.lit("c"), "trace_id": F.lit("t"), "run_timestamp": F.lit("2024-01-02T00:00:00Z"), "bucket_id": F.lit("b"), "probability": F.col("probability") / 3})).select("key", F.get_json_object("value", "$.payload.public_cluster_id").alias("topic"), F.get_json_object("value", "$.payload.cluster_probability").cast("double").alias("probability"))
)
_PAIRS = """WITH f AS (SELECT vec_id, embedding::DOUBLE[] AS e, md5(CAST(vec_id AS VARCHAR)) AS h FROM embeddings ORDER BY h LIMIT 100), p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, md5(concat(a.h, b.h)) AS r FROM f a JOIN f b ON a.h < b.h),
    u AS (SELECT *, 'top' AS kind FROM (SELECT * FROM p ORDER BY cosine DESC, a, b LIMIT 10) UNION ALL SELECT *, 'borderline' FROM (SELECT * FROM p WHERE cosine BETWEEN 0.5 AND 0.6 ORDER BY a, b LIMIT 10) UNION ALL SELECT *, 'random' FROM (SELECT * FROM p ORDER BY r LIMIT 10))"""
query("C10_pair_examples", f"{_PAIRS} SELECT kind, a, b, cosine, round(0.6 * cosine + 0.15 * exp(-abs(a - b) / 24), 6) AS score FROM u")(
    lambda s, d: clustering.pair_examples(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.array().cast("array<string>").alias("entities"), "embedding", F.timestamp_add("HOUR", F.col("vec_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("at")), sample=100).select("kind", "a", "b", "cosine", F.round("score", 6).alias("score"))
)

_AND, _OF = ("and", "et", "und", "y"), ("the", "de", "der", "la")
query("M01_chunked_sentiment", f"""WITH w AS (SELECT doc_id, trim(text) = '' AS blank, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, blank, words, unnest(range(0, 1 + CAST(greatest(ceil((len(words) - 382) / 318.0), 0) AS INT))) AS k FROM w), l AS (SELECT *, words[k * 318 + 1 : k * 318 + 382] AS p FROM c),
    s AS (SELECT doc_id, any_value(blank) AS blank, CASE WHEN any_value(len(words)) = 0 THEN 0 ELSE count(*) END AS chunks, avg(2.0 * len(list_filter(p, lambda x: x IN {_OF}))) AS bad, avg(2.0 * len(list_filter(p, lambda x: x IN {_AND}))) AS good FROM l GROUP BY 1),
    g AS (SELECT *, CASE WHEN chunks = 0 THEN 0 ELSE 1 END AS mid, greatest(bad, good, 1) AS m FROM s), e AS (SELECT *, exp(bad - m) AS b, exp(mid - m) AS n, exp(good - m) AS a FROM g), z AS (SELECT *, greatest(b, n, a) / (b + n + a) AS top FROM e)
    SELECT doc_id, chunks, CASE WHEN blank OR top < 0.55 THEN 'neutral' WHEN b >= n AND b >= a THEN 'negative' WHEN n >= a THEN 'neutral' ELSE 'positive' END AS label, round(CASE WHEN blank THEN 1.0 ELSE top END, 9) AS score FROM z""")(
    lambda s, d: enrich.chunked_sentiment(table(s, d, "documents").where("text is not null"), logits=lambda w: enrich.word_logits(w, _AND, _OF)).select("doc_id", "chunks", "label", F.round("score", 9).alias("score"))
)
query("M15_tfidf_terms", """WITH w AS (SELECT source AS cluster, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: length(x) >= 2 AND x NOT IN ('the', 'and', 'de')) AS w FROM documents WHERE source IS NOT NULL),
    t AS (SELECT cluster, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS term FROM w), c AS (SELECT cluster, term, count(*) AS tf FROM t GROUP BY 1, 2),
    f AS (SELECT term, sum(tf) AS total, count(*) AS df FROM c GROUP BY 1 ORDER BY total DESC, term LIMIT 5000), x AS (SELECT cluster, term, tf * (ln((1 + (SELECT count(DISTINCT cluster) FROM w)) / (1 + df)) + 1) AS weight FROM c JOIN f USING (term)),
    s AS (SELECT cluster, term, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY cluster)), 9) AS score FROM x) SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS place FROM s QUALIFY place <= 10""")(
    lambda s, d: enrich.tfidf_terms(table(s, d, "documents").select(F.col("source").alias("cluster"), "text"), stop=("the", "and", "de"))
)

# results that are kept for a time

_KEPT = """k AS (SELECT public_cluster_id AS c, sha256(concat_ws('|', 'v1', public_cluster_id, 'a', 'b')) AS cache_key, min(cluster_id) % 3 AS r FROM assignments WHERE cluster_id >= 0 GROUP BY 1),
    n AS (SELECT public_cluster_id AS c, count(*) AS n FROM assignments GROUP BY 1), a AS (SELECT cache_key, c, CASE WHEN r = 0 THEN -1 ELSE n END AS payload, r = 0 AS hit FROM k JOIN n USING (c))"""


def _kept(s, d):
    """A third of the topics is kept with a payload of -1, a third has been kept too long, a third is missing."""
    rows = testbed.assignments(s, d).where("cluster_id >= 0")
    keys = rows.groupBy("public_cluster_id").agg((F.min("cluster_id") % 3).alias("r")).withColumn("cache_key", dml.cache_key(F.lit("v1"), F.col("public_cluster_id"), F.lit("a"), F.lit("b")))
    until = F.when(F.col("r") == 0, F.lit("2024-01-02 00:00:01")).otherwise(F.lit("2024-01-02 00:00:00")).cast("timestamp_ntz")
    old = keys.where("r < 2").select("cache_key", F.lit(-1).cast("long").alias("payload"), until.alias("expires_at"))
    sizes = testbed.assignments(s, d).groupBy("public_cluster_id").agg(F.count("*").alias("payload"))
    return keys, old, cache.read_through(old, keys, lambda missing: missing.join(sizes, "public_cluster_id"), "2024-01-02 00:00:00", 30)


query("K13_read_through", f"WITH {_KEPT} SELECT cache_key, payload, hit FROM a")(lambda s, d: _kept(s, d)[2][0])
query("K13_cache_afterwards", f"WITH {_KEPT} SELECT cache_key, payload, CASE WHEN hit THEN TIMESTAMP '2024-01-02 00:00:01' ELSE TIMESTAMP '2024-01-02 00:01:00' END AS expires_at FROM a")(lambda s, d: _kept(s, d)[2][1])


@query("K13_top_nodes", f"""WITH {_KEPT}, e AS (SELECT public_cluster_id AS c, {rel.KEY} AS node, count(*) AS m FROM assignments JOIN ner_results USING (event_id) GROUP BY 1, 2), f AS (SELECT c, node, row_number() OVER (PARTITION BY c ORDER BY m DESC, node) AS place FROM e)
    SELECT cache_key, node, place FROM a JOIN f USING (c) WHERE NOT hit AND place <= 3 UNION ALL SELECT cache_key, 'old', 1 FROM a WHERE hit""")
def _top_nodes(s, d):
    keys, old, (answers, _) = _kept(s, d)
    n = testbed.assignments(s, d).join(testbed.ner_results(s, d), "event_id").groupBy("public_cluster_id", sem.entity_key().alias("node")).agg(F.count("*").alias("m"))
    new = n.withColumn("place", F.row_number().over(Window.partitionBy("public_cluster_id").orderBy(F.desc("m"), "node"))).where("place <= 3").join(keys, "public_cluster_id").select("cache_key", "node", "place")
    return cache.replace_parts(old.select("cache_key", F.lit("old").alias("node"), F.lit(1).alias("place")), answers, new)


# reads of the graph store

_NOW = "1998-01-01 00:00:00"
query("G30_top_entities", f"""SELECT entity_type AS type, {rel.KEY} AS name, count(DISTINCT event_id) AS mention_count, CAST(sum(CAST({testbed.SIGNED} AS DECIMAL(18, 4))) AS DOUBLE) / count({testbed.SIGNED}) AS avg_sentiment FROM (SELECT DISTINCT event_id, entity_type, {rel.KEY} AS entity_text, NULL AS normalized_text FROM ner_results) JOIN raw_messages USING (event_id) LEFT JOIN sentiment_results USING (event_id)
    WHERE message_date >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY GROUP BY 1, 2 ORDER BY mention_count DESC, type, name LIMIT 20""")(rel.over(overview.mentioned_lately, _NOW))
query("G30_daily_sentiment", f"SELECT CAST(message_date AS DATE) AS day, CAST(sum(CAST({testbed.SIGNED} AS DECIMAL(18, 4))) AS DOUBLE) / count({testbed.SIGNED}) AS avg_sentiment, count(*) AS message_count FROM raw_messages LEFT JOIN sentiment_results USING (event_id) WHERE channel = 'BUILDING' AND message_date >= TIMESTAMP '{_NOW}' - INTERVAL 30 DAY GROUP BY 1")(rel.over(overview.daily_sentiment, _NOW, "BUILDING"))
query("G30_co_occurrence", f"""WITH e AS (SELECT DISTINCT event_id, {rel.KEY} AS name, entity_type AS type FROM ner_results JOIN raw_messages USING (event_id) WHERE entity_type IN ('STANDARD', 'PROMO', 'ECONOMY') AND message_date >= TIMESTAMP '{_NOW}' - INTERVAL 2000 DAY)
    SELECT a.name AS entity1, b.name AS entity2, count(*) AS together, a.type AS type1, b.type AS type2 FROM e a JOIN e b ON a.event_id = b.event_id AND (a.name, a.type) < (b.name, b.type) GROUP BY ALL HAVING count(*) >= 5 ORDER BY together DESC, entity1, entity2, type1, type2 LIMIT 100""")(rel.over(overview.found_together, _NOW, ("STANDARD", "PROMO", "ECONOMY"), 2000))

# the same over whole tables

query("F09b_latest_run_of_events", "SELECT arg_max(event_id, ts) AS run_id FROM events")(lambda s, d: overview.latest_run(table(s, d, "events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("run_timestamp"))))
query("F14b_asked_pages", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 50 ELSE least(200, greatest(1, user_id * 7 - 50)) END AS page_limit, greatest(0, event_id - 100) AS page_offset FROM events""")(
    lambda s, d: table(s, d, "events").select("event_id", overview.page_of(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise((F.col("user_id") * 7 - 50).cast("string")), (F.col("event_id") - 100).cast("string")).alias("p")).select("event_id", F.col("p.limit").alias("page_limit"), F.col("p.offset").alias("page_offset"))
)
query("O07b_backfill_jobs", """WITH c AS (SELECT user_id AS channel, CAST(min(ts) AS DATE) AS start FROM events GROUP BY 1)
    SELECT channel, CAST(DATE '2024-01-10' - CAST(place AS INT) AS DATE) AS job_date, CAST(place AS INT) AS place FROM (SELECT channel, unnest(range(0, DATE '2024-01-10' - greatest(start, DATE '2024-01-03') + 1)) AS place FROM c WHERE start <= DATE '2024-01-10')""")(
    lambda s, d: dml.backfill_jobs(table(s, d, "events").groupBy(F.col("user_id").alias("channel")).agg(F.min("ts").cast("date").alias("start")), "2024-01-10", 7)
)
query("O08b_sample_by_hash", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")(lambda s, d: table(s, d, "documents").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(100).select("doc_id"))
_GOOD, _BAD = tuple(enrich.GOOD.split()), tuple(enrich.BAD.split())
query("M02b_all_documents", f"""WITH w AS (SELECT doc_id, trim(coalesce(text, '')) = '' AS blank, string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
    l AS (SELECT doc_id, blank, 2.0 * len(list_filter(w, lambda x: x IN {_BAD})) AS bad, 2.0 * len(list_filter(w, lambda x: x IN {_GOOD})) AS good FROM w), m AS (SELECT *, greatest(bad, good, 1) AS m FROM l),
    z AS (SELECT doc_id, blank, bad, good, exp(greatest(bad, good, 1) - m) / (exp(bad - m) + exp(1 - m) + exp(good - m)) AS top FROM m)
    SELECT doc_id, CASE WHEN blank OR top < 0.55 THEN 'neutral' WHEN bad >= 1 AND bad >= good THEN 'negative' WHEN good <= 1 THEN 'neutral' ELSE 'positive' END AS label, round(CASE WHEN blank THEN 1.0 ELSE top END, 9) AS score FROM z""")(
    lambda s, d: enrich.sentiment(analytics.docs(s, d, "doc_id", "text")).select("doc_id", "label", F.round("score", 9).alias("score"))
)

# written and read back

def _folder(s) -> str:
    return f"{shared_folder(s)}/written-{uuid.uuid4().hex}"


@query("K02_json_lines", "SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_type = 'click'")
def _json_lines(s, d):
    path, e = _folder(s), table(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    sinks.to_json_lines(e, path)
    sinks.to_json_lines(e.where("event_type = 'click'"), path)  # replaces
    return events.files(s, path, "json", e.schema)


@query("K03_csv", "SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c_mktsegment, 2 AS n FROM customer) GROUP BY 1")
def _csv(s, d):
    path, c = _folder(s), table(s, d, "customer").select("c_custkey", "c_mktsegment")
    sinks.to_csv(c, path)
    sinks.to_csv(c, path)  # adds
    return events.files(s, path, "csv").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("K05_parquet_partitions", "SELECT event_type, count(*) FILTER (event_type <> 'error' OR event_id % 2 = 0) AS n FROM events GROUP BY 1")
def _partitions(s, d):
    path, e = _folder(s), table(s, d, "events").select("event_id", "event_type")
    sinks.to_parquet(e, path, "event_type")
    sinks.to_parquet(e.where("event_type = 'error' AND event_id % 2 = 0"), path, "event_type")  # replaces one partition
    return s.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


def _assigned(s, d):
    a, m = testbed.assignments(s, d).where("run_id = 'run_b'"), testbed.raw_messages(s, d)
    return a.join(m.select("event_id", "channel", "message_id"), "event_id").withColumn("cluster_probability", F.round("probability", 6)), m


@query("S10_staged_lines", "SELECT event_id, channel, message_id, run_id, cluster_id, public_cluster_id, round(probability, 6) AS cluster_probability, '[]' AS topic_keywords FROM assignments JOIN raw_messages USING (event_id) WHERE run_id = 'run_b'")
def _staged(s, d):
    path, (a, m) = _folder(s), _assigned(s, d)
    sinks.to_json_lines(a.drop("probability"), path)
    staged = staging.staged_lines(s, path).where("is_json")
    return staging.checked(staged, m).select("event_id", "channel", "message_id", "run_id", "cluster_id", "public_cluster_id", "cluster_probability", "topic_keywords")


query("F21_violations", """WITH a AS (SELECT event_id, channel, message_id, CASE WHEN message_id % 50 = 0 THEN 'other' ELSE run_id END AS run_id, cluster_id, public_cluster_id, probability FROM assignments JOIN raw_messages USING (event_id) WHERE run_id = 'run_b')
    SELECT count(DISTINCT run_id) AS runs, count(*) FILTER (run_id = 'other') AS invalid, count(*) FILTER (message_id % 7 = 0) AS orphans, 0 AS duplicates FROM a""")(
    lambda s, d: (lambda a, m: staging.violations(a.withColumn("run_id", F.when(F.col("message_id") % 50 == 0, "other").otherwise(F.col("run_id"))), m.where("message_id % 7 <> 0")))(*_assigned(s, d))
)


@query("S11_staged_csv", "SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders")
def _staged_csv(s, d):
    path = _folder(s)
    sinks.to_csv(table(s, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day")), path)
    return staging.staged_csv(s, path, "o_orderkey long, o_totalprice double, day date").where("_broken is null").drop("_broken")


query("M09_canonical_names")(lambda s, d: names.canonical_names(enrich.entities(table(s, d, "documents"), ("doc_id",))).select("doc_id", "start_pos", "entity_text", "canonical"))

# first sources

_EXACT = """m AS (SELECT concat('run_b:', CAST(floor(doc_id / 100) AS BIGINT)) AS c, concat_ws(':', source, doc_id) AS event_id, source, doc_id, CASE WHEN doc_id % 11 = 5 THEN doc_id - 40 END AS f, CASE WHEN doc_id % 7 = 3 THEN doc_id - 20 END AS r FROM documents),
    x AS (SELECT m.c, m.event_id, m.doc_id, CASE WHEN a.doc_id IS NOT NULL THEN 'exact_forward' WHEN b.doc_id IS NOT NULL THEN 'exact_reply' ELSE 'unknown' END AS kind, CASE WHEN a.doc_id IS NOT NULL THEN 1.0 WHEN b.doc_id IS NOT NULL THEN 0.97 ELSE 0.0 END AS sure, coalesce(a.doc_id, b.doc_id) AS s, coalesce(a.event_id, b.event_id) AS sid
    FROM m LEFT JOIN m a ON a.source = m.source AND a.doc_id = m.f LEFT JOIN m b ON b.source = m.source AND b.doc_id = m.r)"""


def _exact(s, d):
    m = analytics.source_messages(s, d).withColumn("primary_url", F.lit(None).cast("string"))
    return m, first_source.exact_sources(m, m)


query("R05b_strict_cluster_sources", f"WITH {_EXACT}, b AS (SELECT c, kind, sure, sid, row_number() OVER (PARTITION BY c ORDER BY kind = 'unknown', s, sure DESC, sid, kind) AS n FROM x) SELECT c AS public_cluster_id, kind AS source_type, CAST(sure AS DOUBLE) AS confidence, sid AS source_event_id FROM b WHERE n = 1")(lambda s, d: first_source.cluster_exact(_exact(s, d)[1]))


def _inferred(m):
    """The earliest message of a topic as everybody's inferred source."""
    first = first_source.cluster_inferred(m)
    return m.select("public_cluster_id", "event_id").join(first, "public_cluster_id").withColumn("source_type", F.lit("earliest_in_cluster"))


_LINKS = f"{_EXACT}, l AS (SELECT c, min(doc_id) AS d, arg_min(event_id, doc_id) AS e FROM m GROUP BY 1), k AS (SELECT c AS public_cluster_id, event_id AS child, coalesce(sid, CASE WHEN e <> event_id THEN e END) AS parent, CASE WHEN sid IS NOT NULL THEN kind ELSE 'earliest_in_cluster' END AS link_type, CASE WHEN sid IS NOT NULL THEN CAST(sure AS DOUBLE) ELSE 0.35 END AS confidence FROM x JOIN l USING (c))"
query("R07b_links", f"WITH {_LINKS} SELECT * FROM k WHERE parent IS NOT NULL")(lambda s, d: (lambda m, e: first_source.propagation_links(e, _inferred(m)))(*_exact(s, d)))
#: The first links of each topic's chain: by the child's time, then its id.
_CHAIN = f"{_LINKS}, h AS (SELECT k.*, a.source AS child_channel, a.doc_id AS child_id, b.source AS parent_channel, b.doc_id AS parent_id, row_number() OVER (PARTITION BY k.public_cluster_id ORDER BY a.doc_id, k.child) AS place FROM k JOIN m a ON a.event_id = k.child LEFT JOIN m b ON b.event_id = k.parent WHERE parent IS NOT NULL QUALIFY place <= 12)"


def _linked(s, d, topic: str | None = None):
    """The first links of all topics, or of one, and the messages that they, or that topic, need: no others are cleaned."""
    m, e = _exact(s, d)
    links = first_source.propagation_links(e, _inferred(m))
    few = analytics.written(topics.first_links(m, links if topic is None else links.where(F.col("public_cluster_id") == topic)))
    ids = few.select(F.explode(F.array("child", "parent")).alias("event_id"))
    return _known(s, d, ids if topic is None else ids.unionByName(m.where(F.col("public_cluster_id") == topic).select("event_id"))), few


def _known(s, d, ids):
    return analytics.written_messages(analytics.cleaned_messages(s, d, ids).withColumn("primary_url", F.lit(None).cast("string")))


query("O06_chains", f"WITH {_CHAIN} SELECT public_cluster_id, place, child, parent, child_channel, child_id AS child_message_id, parent_channel, parent_id AS parent_message_id, link_type, confidence AS link_confidence, CASE WHEN starts_with(link_type, 'exact') THEN 'exact' ELSE 'inferred' END AS resolution_kind FROM h")(
    lambda s, d: topics.chains(*_linked(s, d)).drop("child_message_date", "parent_message_date", "evidence")
)
query("N13_propagation_graph", f"""WITH {_CHAIN}, t AS (SELECT * FROM m WHERE c = 'run_b:1' ORDER BY doc_id DESC LIMIT 30)
    SELECT 'topic-run_b:1' AS source, concat('msg-', event_id) AS target, 1 AS weight, 'contains' AS kind FROM t UNION ALL SELECT concat('msg-', parent), concat('msg-', child), CAST(round(confidence * 100) AS INT), CASE WHEN starts_with(link_type, 'exact') THEN 'propagates_exact' ELSE 'propagates_inferred' END FROM h WHERE public_cluster_id = 'run_b:1'""")(
    lambda s, d: topics.propagation_graph(*_linked(s, d, "run_b:1"), "run_b:1")[1]
)
query("N13b_propagation_nodes", f"""WITH {_CHAIN}, t AS (SELECT m.*, {analytics.SQ.format('text')} AS x FROM m JOIN documents USING (doc_id, source) WHERE c = 'run_b:1' ORDER BY doc_id DESC LIMIT 30), g AS (SELECT * FROM h WHERE public_cluster_id = 'run_b:1'),
    a AS (SELECT concat('msg-', event_id) AS id, coalesce(nullif(CASE WHEN length(x) > 48 THEN concat(rtrim(x[1:48]), '...') ELSE x END, ''), concat(source, ' #', doc_id)) AS label, 1 AS weight, NULL AS source_status, 0 AS r FROM t
    UNION ALL SELECT concat('msg-', parent), concat(parent_channel, ' #', parent_id), 2, CASE WHEN starts_with(link_type, 'exact') THEN 'exact' ELSE 'probable' END, 2 * place FROM g UNION ALL SELECT concat('msg-', child), concat(child_channel, ' #', child_id), 1, CASE WHEN starts_with(link_type, 'exact') THEN 'exact' ELSE 'probable' END, 2 * place + 1 FROM g)
    SELECT id, label, 'message' AS type, weight, source_status FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY r) = 1 UNION ALL SELECT concat('topic-', c), c, 'topic', count(*), NULL FROM m WHERE c = 'run_b:1' GROUP BY c""")(lambda s, d: topics.propagation_graph(*_linked(s, d, "run_b:1"), "run_b:1")[0])


def _payload(s, d):
    m, e = _exact(s, d)
    strict = analytics.written(first_source.cluster_exact(e).where("source_type <> 'unknown'"))
    likely = analytics.written(first_source.cluster_inferred(m).withColumn("source_type", F.lit("earliest_in_cluster")))
    few = analytics.written(topics.first_links(m, first_source.propagation_links(e, _inferred(m))))
    # the earliest message of each topic is among them, so every topic is
    ids = few.select(F.explode(F.array("child", "parent")).alias("event_id")).unionByName(strict.select(F.col("source_event_id").alias("event_id"))).unionByName(likely.select(F.col("source_event_id").alias("event_id")))
    found = topics.first_sources(_known(s, d, ids), strict, likely, few)
    return found.select("public_cluster_id", "source_status", F.col("exact.source_event_id").alias("exact_event"), F.col("exact.source_confidence").alias("exact_confidence"), F.col("inferred.source_event_id").alias("inferred_event"), F.col("shown.source_channel").alias("shown_channel"), F.col("shown.source_message_id").alias("shown_message_id"), F.col("shown.source_type").alias("shown_type"), F.coalesce(F.size("chain"), F.lit(0)).alias("links"), F.col("chain")[0]["child"].alias("first_child"))


query("R08_first_source_payload", f"""WITH {_CHAIN}, b AS (SELECT c, kind, sure, sid, s FROM x WHERE kind <> 'unknown' QUALIFY row_number() OVER (PARTITION BY c ORDER BY s, sure DESC, sid, kind) = 1), l2 AS (SELECT public_cluster_id AS c, count(*) AS links, arg_min(child, place) AS first_child FROM h GROUP BY 1)
    SELECT l.c AS public_cluster_id, CASE WHEN b.c IS NULL THEN 'probable' ELSE 'exact' END AS source_status, b.sid AS exact_event, CAST(b.sure AS DOUBLE) AS exact_confidence, l.e AS inferred_event, n.source AS shown_channel, n.doc_id AS shown_message_id, coalesce(b.kind, 'earliest_in_cluster') AS shown_type, coalesce(links, 0) AS links, first_child
    FROM l LEFT JOIN b ON b.c = l.c JOIN m n ON n.event_id = coalesce(b.sid, l.e) LEFT JOIN l2 ON l2.c = l.c""")(_payload)

_TOPICS = f"""t AS (SELECT public_cluster_id AS c, count(*) AS n, max(message_date) AS l, concat('topic-', public_cluster_id) AS id FROM ({rel.CLUSTERED}) GROUP BY 1 ORDER BY n DESC, l DESC, c LIMIT 30),
    o AS (SELECT *, row_number() OVER (ORDER BY n DESC, l DESC, c) AS place FROM t),
    ch AS (SELECT c, channel, k, row_number() OVER (PARTITION BY c ORDER BY k DESC, channel) AS pos FROM (SELECT public_cluster_id AS c, channel, count(*) AS k FROM ({rel.CLUSTERED}) GROUP BY 1, 2)),
    e0 AS (SELECT public_cluster_id AS c, {rel.KEY} AS key, entity_type AS ty, {rel.TEXT} AS label, count(*) AS k FROM ({rel.CLUSTERED}) JOIN ner_results USING (event_id) GROUP BY 1, 2, 3),
    e1 AS (SELECT * FROM e0 QUALIFY row_number() OVER (PARTITION BY c, key ORDER BY k DESC, label, ty) = 1),
    e AS (SELECT *, CASE WHEN upper(ty) IN ('PERSON', 'PER') THEN 'PER' WHEN upper(ty) IN ('ORG', 'LOC') THEN upper(ty) ELSE 'MISC' END AS kind, row_number() OVER (PARTITION BY c ORDER BY k DESC, label, ty) AS pos FROM e1),
    g AS (SELECT place, pos, o.id AS source, concat('ch-', channel) AS target, channel AS label, 'channel' AS type, k AS weight, 'publishes' AS edge FROM o JOIN ch USING (c) WHERE pos <= 2
    UNION ALL SELECT place, 100 + pos, o.id, concat('ent-', kind, ':', key), label, concat('entity_', lower(kind)), k, 'mentions' FROM o JOIN e USING (c) WHERE pos <= 2)"""
query("N12_overview_edges", f"WITH {_TOPICS} SELECT source, target, weight, edge AS type FROM g")(rel.over(lambda r: topics.overview_graph(topics.topic_list(r, rel.START, rel.END))[1]))
query("N12b_overview_nodes", f"""WITH {_TOPICS}, lb AS (SELECT c, string_agg(label, ' / ' ORDER BY pos) AS label FROM e WHERE pos <= 2 GROUP BY 1)
    SELECT id, lb.label, 'topic' AS type, n AS weight, 'probable' AS source_status FROM o LEFT JOIN lb USING (c) UNION ALL SELECT target, label, type, weight, NULL FROM g QUALIFY row_number() OVER (PARTITION BY target ORDER BY place, pos) = 1""")(rel.over(lambda r: topics.overview_graph(topics.topic_list(r, rel.START, rel.END))[0]))
query("N12c_focus", f"WITH {_TOPICS} SELECT source, target, weight, edge AS type FROM g WHERE source = 'topic-{rel.CLUSTER}'")(rel.over(lambda r: topics.overview_graph(topics.topic_list(r, rel.START, rel.END), f"topic-{rel.CLUSTER}")[1]))

# graphs

query("N08_bridge_scores", "SELECT p_partkey, least(1.0, p_partkey % 10 / 10.0 + CASE WHEN p_partkey % 4 >= 2 THEN 0.2 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 0.3 ELSE 0 END) AS score FROM part")(
    of("part", "p_partkey", lambda: graph.bridge_score((F.col("p_partkey") % 10) / 10, F.col("p_partkey") % 4, F.col("p_partkey") % 3 == 0).alias("score"))
)
_RANKED = f"{analytics.GRAPH}, e AS (SELECT cluster, a AS id, b AS o, weight FROM edges UNION ALL SELECT cluster, b, a, weight FROM edges), w AS (SELECT cluster, id, any_value(label) AS label, any_value(kind) AS kind, sum(e.weight) AS p, count(DISTINCT o) AS g FROM nodes LEFT JOIN e USING (cluster, id) GROUP BY 1, 2)".replace("sum(e.weight)", "coalesce(sum(e.weight), 0)").replace("nodes LEFT JOIN e USING", "(SELECT cluster, id, label, kind FROM nodes) LEFT JOIN e USING")


def _weighed(s, d):
    nodes, edges = analytics.topic_graph(s, d)
    n = nodes.select(F.col("cluster").alias("cluster"), F.col("id").alias("id"), F.col("label").alias("label"), F.col("kind").alias("kind"))
    return n.join(graph.degrees(nodes, edges), ["cluster", "id"]).select("cluster", "id", "label", "kind", F.col("weighted_degree").alias("pagerank"), F.col("degree").alias("degree_centrality"))


query("W08_node_rank", f"{_RANKED} SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY p DESC, g DESC, label, id) AS rank FROM w")(lambda s, d: graph.ranked(_weighed(s, d)).select("cluster", "id", "rank"))
query("N11_top_nodes", f"{_RANKED} SELECT cluster, kind, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster, kind ORDER BY p DESC, g DESC, label, id) AS rank FROM w) WHERE rank <= 10")(lambda s, d: graph.top_nodes(_weighed(s, d)).select("cluster", "kind", "id", "rank"))
query("N11b_bridges")(lambda s, d: (lambda n, e: graph.top_bridges(graph.measures(n, e).withColumn("label", F.col("id"))).select("cluster", "id", "rank"))(*analytics.topic_graph(s, d)))

# routes

query("API_sentiment_dynamics_of_one_channel", "SELECT date_trunc('day', message_date) AS bucket, " + ", ".join(f"count(*) FILTER ({rel._LABELS} = '{x}') AS {x}" for x in ("positive", "neutral", "negative")) + f" FROM raw_messages LEFT JOIN sentiment_results USING (event_id) WHERE {rel.WINDOW} AND channel = 'BUILDING' GROUP BY 1")(rel.over(overview.sentiment_dynamics, rel.START, rel.END, "day", "BUILDING"))
#: Routes that give what a query with SQL gives.
ROUTES = {"API_overview": "G22_kpis", "API_cluster_related": "G11_related_clusters", "API_entities_top": "G06_top_entities", "API_sentiment_dynamics": "G10_sentiment_dynamics", "API_graph": "N12_overview_edges"}
ORACLE_SQL |= {route: (rel.ORACLE_SQL | ORACLE_SQL)[name] for route, name in ROUTES.items()}
ORACLE_SQL["API_messages"] = with_ctes(
    f"SELECT event_id, channel, message_id, text, message_date, coalesce(views, 0) AS views, coalesce(forwards, 0) AS forwards, public_cluster_id, {rel._LABELS} AS sentiment_label, coalesce(sentiment_score, 0) AS sentiment_confidence, CAST({testbed.SIGNED} AS DOUBLE) AS ui_sentiment_score"
    f" FROM raw_messages LEFT JOIN ({rel.LATEST_ONLY}) USING (event_id) LEFT JOIN sentiment_results USING (event_id) WHERE {rel.WINDOW} ORDER BY message_date DESC, event_id DESC LIMIT 50"
)
ORACLE_SQL["API_cluster_documents"] = with_ctes(
    f"SELECT run_id, cluster_id, event_id, probability, public_cluster_id, channel, message_id, text, message_date, views, forwards, sentiment_label, sentiment_score, positive_prob, negative_prob FROM ({rel.OF_CLUSTER}) LEFT JOIN sentiment_results USING (event_id) ORDER BY message_date DESC, event_id DESC LIMIT 50"
)
