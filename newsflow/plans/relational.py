"""Named queries over the relations: filters, joins, aggregations, windows, order, sets and DML, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow.functions.semantics import contains_text, entity_key, label_or_neutral, mean, signed_sentiment, truncated, within
from newsflow.operators import dml, overview
from newsflow.sources import testbed
from newsflow.sources.testbed import SIGNED, table, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

START, END, MIDDLE = "1995-01-01 00:00:00", "1997-12-31 00:00:00", "1996-06-01 00:00:00"
BEFORE = "1992-01-01 00:00:00"
CLUSTER = "run_b:3"
LATEST = "assignments AS a JOIN (SELECT max_by(run_id, run_timestamp) AS run_id FROM cluster_runs) USING (run_id)"
WINDOW = f"message_date >= TIMESTAMP '{START}' AND message_date <= TIMESTAMP '{END}'"
KEY = "lower(coalesce(normalized_text, entity_text))"
TEXT = "coalesce(max(normalized_text), min(entity_text))"
MEAN = "CAST(sum(CAST({0} AS DECIMAL(18, 4))) AS DOUBLE) / count({0})"
STATS = f"count(*) AS message_count, count(DISTINCT channel) AS channel_count, coalesce({MEAN.format('signed')}, 0) AS avg_sentiment, min(message_date) AS first_seen, max(message_date) AS last_seen"


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_ctes(sql)
        return f

    return put


def relations(spark: SparkSession, d: str) -> overview.Relations:
    return overview.Relations(testbed.raw_messages(spark, d), testbed.ner_results(spark, d), testbed.sentiment_results(spark, d), testbed.cluster_runs(spark, d), testbed.assignments(spark, d))


def over(f, *args, **named):
    """A query that reads the relations."""
    return lambda spark, d: f(relations(spark, d), *args, **named)


CLUSTERED = f"SELECT * FROM {LATEST} JOIN raw_messages USING (event_id) WHERE cluster_id >= 0 AND {WINDOW}"
OF_CLUSTER = f"SELECT * FROM assignments JOIN raw_messages USING (event_id) WHERE public_cluster_id = '{CLUSTER}' AND {WINDOW}"
LATEST_ONLY = f"SELECT event_id, public_cluster_id FROM {LATEST} WHERE cluster_id >= 0"

query("G01_cluster_overview", f"SELECT public_cluster_id, {STATS} FROM (SELECT c.*, {SIGNED} AS signed FROM ({CLUSTERED}) c LEFT JOIN sentiment_results USING (event_id)) GROUP BY 1")(over(overview.cluster_overview, START, END))
query("G02_cluster_stats", f"SELECT {STATS} FROM (SELECT c.*, {SIGNED} AS signed FROM ({OF_CLUSTER}) c LEFT JOIN sentiment_results USING (event_id))")(over(overview.cluster_stats, CLUSTER, START, END))
query("G03_totals", f"SELECT count(*) AS total_messages, count(DISTINCT channel) AS active_channels FROM raw_messages WHERE {WINDOW}")(over(overview.totals, START, END))
query("G04_cluster_entities", f"SELECT public_cluster_id, {KEY} AS entity_key, entity_type, {TEXT} AS entity_text, count(*) AS mention_count FROM ({CLUSTERED}) JOIN ner_results USING (event_id) GROUP BY ALL")(over(overview.entities_per_cluster, START, END))
query("G05_cluster_channels", f"SELECT public_cluster_id, channel, count(*) AS message_count FROM ({CLUSTERED}) GROUP BY ALL")(over(overview.channels_per_cluster, START, END))
query("G05b_channels_of_one_cluster", f"SELECT channel, count(*) AS message_count FROM ({OF_CLUSTER}) GROUP BY ALL")(over(overview.cluster_channels, CLUSTER, START, END))
query("G06_top_entities", f"""SELECT {KEY} AS entity_key, entity_type, {TEXT} AS entity_text, count(*) AS mention_count, count(DISTINCT coalesce(public_cluster_id, 'unclustered')) AS topic_count, count(DISTINCT channel) AS channel_count
    FROM raw_messages JOIN ner_results USING (event_id) LEFT JOIN ({LATEST_ONLY}) USING (event_id) WHERE {WINDOW} GROUP BY 1, 2 ORDER BY mention_count DESC, entity_text, entity_type LIMIT 50""")(over(overview.top_entities, START, END))
query("G07_entities_of_one_cluster", f"SELECT {KEY} AS entity_key, entity_type, {TEXT} AS entity_text, count(*) AS mention_count FROM ({OF_CLUSTER}) JOIN ner_results USING (event_id) GROUP BY 1, 2 ORDER BY mention_count DESC, entity_text, entity_type LIMIT 10")(over(overview.cluster_entities, CLUSTER, START, END))
query("G08_sentiment_breakdown", f"SELECT lower(coalesce(sentiment_label, 'neutral')) AS sentiment_label, count(*) AS message_count FROM ({OF_CLUSTER}) LEFT JOIN sentiment_results USING (event_id) GROUP BY 1")(over(overview.sentiment_breakdown, CLUSTER, START, END))
query("G09_volume_timeline", f"SELECT date_trunc('hour', message_date) AS bucket, count(*) AS message_count FROM ({OF_CLUSTER}) GROUP BY 1")(over(overview.volume, CLUSTER, START, END))
_LABELS = "lower(coalesce(sentiment_label, 'neutral'))"
query("G10_sentiment_dynamics", f"SELECT date_trunc('day', message_date) AS bucket, " + ", ".join(f"count(*) FILTER ({_LABELS} = '{x}') AS {x}" for x in ("positive", "neutral", "negative")) + f" FROM raw_messages LEFT JOIN sentiment_results USING (event_id) WHERE {WINDOW} GROUP BY 1")(over(overview.sentiment_dynamics, START, END))
query("G11_related_clusters", f"""SELECT public_cluster_id, count(*) AS overlap, least(CAST(0.99 AS DOUBLE), CAST(0.35 AS DOUBLE) + CAST(0.08 AS DOUBLE) * count(*)) AS similarity FROM assignments JOIN ner_results USING (event_id)
    WHERE run_id = 'run_b' AND public_cluster_id <> '{CLUSTER}' AND {KEY} IN (SELECT {KEY} FROM assignments JOIN ner_results USING (event_id) WHERE public_cluster_id = '{CLUSTER}') GROUP BY 1 ORDER BY overlap DESC, public_cluster_id LIMIT 10""")(over(overview.related_clusters, CLUSTER))
query("G12_mentions_per_message", f"SELECT event_id, {KEY} AS entity_key, entity_type, {TEXT} AS entity_text, count(*) AS mention_count FROM ner_results GROUP BY 1, 2, 3")(lambda s, d: overview.mention_counts(testbed.ner_results(s, d), "event_id"))
query("G13_entity_sets", f"SELECT event_id, array_to_string(list_sort(list(DISTINCT {KEY})), '|') AS entities FROM ner_results GROUP BY 1")(
    lambda s, d: testbed.ner_results(s, d).groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set(entity_key())), "|").alias("entities"))
)
query("G14_filtered_counts", "SELECT run_id, count(*) FILTER (cluster_id >= 0) AS clustered, count(*) FILTER (cluster_id < 0) AS noise, count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS n_clusters FROM assignments GROUP BY 1")(
    lambda s, d: testbed.assignments(s, d).groupBy("run_id").agg(F.count_if(F.col("cluster_id") >= 0).alias("clustered"), F.count_if(F.col("cluster_id") < 0).alias("noise"), F.countDistinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"))
)
query("G15_distinct_clusters", "SELECT count(DISTINCT public_cluster_id) FILTER (cluster_id >= 0) AS n FROM assignments")(lambda s, d: testbed.assignments(s, d).agg(F.countDistinct(F.when(F.col("cluster_id") >= 0, F.col("public_cluster_id"))).alias("n")))


@query("G16_channel_stats", f"""SELECT channel, count(DISTINCT event_id) AS messages, {MEAN.format('views')} AS avg_views, {MEAN.format('forwards')} AS avg_forwards, {MEAN.format('sentiment_score')} AS avg_score,
    count(DISTINCT CASE WHEN sentiment_label = 'positive' THEN event_id END) AS positive, count(DISTINCT CASE WHEN sentiment_label = 'negative' THEN event_id END) AS negative FROM raw_messages LEFT JOIN sentiment_results USING (event_id) GROUP BY 1""")
def channel_stats(s, d):
    j = testbed.raw_messages(s, d).join(testbed.sentiment_results(s, d), "event_id", "left")
    of = lambda label: F.countDistinct(F.when(F.col("sentiment_label") == label, F.col("event_id"))).alias(label)
    return j.groupBy("channel").agg(F.countDistinct("event_id").alias("messages"), mean(F.col("views")).alias("avg_views"), mean(F.col("forwards")).alias("avg_forwards"), mean(F.col("sentiment_score")).alias("avg_score"), of("positive"), of("negative"))


@query("G17_top_entities_view", f"""SELECT {KEY} AS entity_key, entity_type, count(*) AS mentions, count(DISTINCT event_id) AS messages, {MEAN.format('confidence')} AS avg_confidence, min(message_date) AS first_seen, max(message_date) AS last_seen
    FROM ner_results JOIN raw_messages USING (event_id) WHERE confidence >= 0.5 GROUP BY 1, 2 HAVING count(*) >= 3""")
def top_entities_view(s, d):
    mentions = testbed.ner_results(s, d).where("confidence >= 0.5").select("event_id", entity_key().alias("entity_key"), "entity_type", "confidence")
    # by event, so an event's mentions are counted where they were joined
    j = testbed.joined(mentions, testbed.raw_messages(s, d).select("event_id", "message_date"), "event_id", table(s, d, "lineitem").count())
    g = j.groupBy("entity_key", "entity_type").agg(F.count("*").alias("mentions"), F.countDistinct("event_id").alias("messages"), mean(F.col("confidence")).alias("avg_confidence"), F.min("message_date").alias("first_seen"), F.max("message_date").alias("last_seen"))
    return g.where("mentions >= 3")


query("G18_duplicate_keys", "SELECT event_id, entity_text, count(*) AS n FROM ner_results GROUP BY 1, 2 HAVING count(*) > 1")(lambda s, d: testbed.ner_results(s, d).groupBy("event_id", "entity_text").agg(F.count("*").alias("n")).where("n > 1"))
query("G19_ordered_json", "SELECT event_id, array_to_string(list(concat(start_pos, ':', entity_text) ORDER BY start_pos, entity_text), ',') AS mentions FROM ner_results GROUP BY 1")(
    lambda s, d: testbed.ner_results(s, d).groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_pos", "entity_text"))), lambda x: F.concat_ws(":", x["start_pos"], x["entity_text"])), ",").alias("mentions"))
)
query("G20_channel_range", "SELECT lower(channel) AS name, min(message_date) AS first_seen, max(message_date) AS last_seen, count(*) AS n FROM raw_messages GROUP BY 1")(
    lambda s, d: testbed.raw_messages(s, d).groupBy(F.lower("channel").alias("name")).agg(F.min("message_date").alias("first_seen"), F.max("message_date").alias("last_seen"), F.count("*").alias("n"))
)
_SLOT = f"CAST(least(greatest(floor((epoch_us(message_date) - epoch_us(TIMESTAMP '{START}')) * 12 / (epoch_us(TIMESTAMP '{END}') - epoch_us(TIMESTAMP '{START}'))), 0), 11) AS INT)"
query("G21_sparkline", f"""WITH s AS (SELECT public_cluster_id, {_SLOT} AS slot FROM ({CLUSTERED})),
    g AS (SELECT t.public_cluster_id, i, count(slot) AS c FROM (SELECT DISTINCT public_cluster_id FROM s) t, range(12) AS r(i) LEFT JOIN s ON s.public_cluster_id = t.public_cluster_id AND s.slot = r.i GROUP BY t.public_cluster_id, i)
    SELECT public_cluster_id, array_to_string(list(c ORDER BY i), ',') AS sparkline FROM g GROUP BY 1""")(
    lambda s, d: overview.sparkline(relations(s, d), START, END).withColumn("sparkline", F.array_join("sparkline", ","))
)
_TOTALS = "SELECT count(*) AS n, count(DISTINCT channel) AS c FROM raw_messages WHERE message_date >= TIMESTAMP '{}' AND message_date <= TIMESTAMP '{}'"
query("G22_kpis", f"""WITH t AS (SELECT public_cluster_id, {STATS} FROM (SELECT c.*, {SIGNED} AS signed FROM ({CLUSTERED}) c LEFT JOIN sentiment_results USING (event_id)) GROUP BY 1)
    SELECT a.n AS now_messages, a.c AS now_channels, b.n AS before_messages, b.c AS before_channels, t2.topics, t2.new_topics, t2.avg_sentiment, CASE WHEN b.n = 0 THEN CASE WHEN a.n = 0 THEN 0.0 ELSE 100.0 END ELSE (a.n - b.n) * 100 / b.n END AS message_change
    FROM ({_TOTALS.format(START, END)}) a, ({_TOTALS.format(BEFORE, START)}) b, (SELECT count(*) AS topics, count(*) FILTER (first_seen >= TIMESTAMP '{MIDDLE}') AS new_topics, coalesce({MEAN.format('avg_sentiment')}, 0) AS avg_sentiment FROM t) t2""")(over(overview.kpis, START, END, BEFORE, MIDDLE))


@query("G23_reactions", "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS likes, count(*) FILTER (event_type = 'error') AS dislikes FROM events GROUP BY 1")
def reactions(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("likes"), F.count_if(F.col("event_type") == "error").alias("dislikes"))


query("G24_progress", "SELECT user_id, CAST(ts AS DATE) AS job_date, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS published FROM events GROUP BY 1, 2")(
    lambda s, d: table(s, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("job_date")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("published"))
)
query("G25_mode_by_count_and_length", "SELECT user_id, event_type AS most FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, length(event_type) DESC, event_type DESC) AS r FROM events GROUP BY 1, 2) WHERE r = 1")(
    lambda s, d: table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max_by("event_type", F.struct("n", F.length("event_type"), "event_type")).alias("most"))
)
query("G26_cluster_quality", """WITH n AS (SELECT run_id, cluster_id, count(*) AS c FROM assignments GROUP BY 1, 2) SELECT run_id, CAST(sum(c) FILTER (cluster_id < 0) AS DOUBLE) / CAST(sum(c) AS DOUBLE) AS noise_ratio,
    count(*) FILTER (cluster_id >= 0) AS n_clusters, CAST(max(c) FILTER (cluster_id >= 0) AS DOUBLE) / CAST(sum(c) AS DOUBLE) AS largest_ratio FROM n GROUP BY 1""")(lambda s, d: overview_quality(testbed.assignments(s, d)))


def overview_quality(assigned: DataFrame) -> DataFrame:
    n = assigned.groupBy("run_id", "cluster_id").agg(F.count("*").alias("c"))
    share = lambda x: x.cast("double") / F.sum("c").cast("double")
    return n.groupBy("run_id").agg(share(F.sum(F.when(F.col("cluster_id") < 0, F.col("c")))).alias("noise_ratio"), F.count_if(F.col("cluster_id") >= 0).alias("n_clusters"), share(F.max(F.when(F.col("cluster_id") >= 0, F.col("c")))).alias("largest_ratio"))


query("G27_alias_report", f"SELECT count(*) AS raw, count(normalized_text) AS kept, 1 - CAST(count(normalized_text) AS DOUBLE) / count(*) AS noise_ratio, count(DISTINCT {KEY}) AS n_unique, count(DISTINCT entity_text) AS aliases FROM ner_results")(
    lambda s, d: testbed.ner_results(s, d).agg(F.count("*").alias("raw"), F.count("normalized_text").alias("kept"), (1 - F.count("normalized_text").cast("double") / F.count("*")).alias("noise_ratio"), F.countDistinct(entity_key()).alias("n_unique"), F.countDistinct("entity_text").alias("aliases"))
)
query("G29_run_summary", "SELECT run_id, count(*) AS total, min(message_date) AS first_ts, max(message_date) AS last_ts, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels FROM assignments JOIN raw_messages USING (event_id) GROUP BY 1")(
    lambda s, d: testbed.assignments(s, d).join(testbed.raw_messages(s, d), "event_id").groupBy("run_id").agg(F.count("*").alias("total"), F.min("message_date").alias("first_ts"), F.max("message_date").alias("last_ts"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))
)
query("G30_engagement", "SELECT channel, sum(views + 10 * forwards) AS engagement FROM raw_messages GROUP BY 1")(lambda s, d: testbed.raw_messages(s, d).groupBy("channel").agg(F.sum(F.col("views") + 10 * F.col("forwards")).alias("engagement")))


@query("G31_top_entities_per_message", f"""SELECT event_id, array_to_string(list(k ORDER BY n DESC, k) FILTER (r <= 3), ', ') AS entities FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, k) AS r FROM (SELECT event_id, {KEY} AS k, count(*) AS n FROM ner_results GROUP BY 1, 2)) GROUP BY 1""")
def top_per_message(s, d):
    n = testbed.ner_results(s, d).groupBy("event_id", entity_key().alias("k")).agg((-F.count("*")).alias("n"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("n", "k"))), 1, 3)
    return n.groupBy("event_id").agg(F.array_join(F.transform(first, lambda x: x["k"]), ", ").alias("entities"))


query("F01_closed_window", f"SELECT event_id, message_date FROM raw_messages WHERE {WINDOW}")(lambda s, d: testbed.raw_messages(s, d).where(within("message_date", START, END)).select("event_id", "message_date"))
query("F03_search", "SELECT event_id FROM raw_messages WHERE lower(coalesce(text, '')) LIKE '%urgent%0_%'")(lambda s, d: testbed.raw_messages(s, d).where(contains_text("text", "URGENT%0_")).select("event_id"))
query("F04_in_list", "SELECT event_id, entity_text FROM ner_results WHERE event_id IN ('1', '2', '3', '5', '7')")(lambda s, d: testbed.ner_results(s, d).where(F.col("event_id").isin("1", "2", "3", "5", "7")).select("event_id", "entity_text"))
query("F06_signed_sentiment", f"SELECT event_id, CAST(CAST({SIGNED} AS DECIMAL(18, 4)) AS DOUBLE) AS signed FROM raw_messages LEFT JOIN sentiment_results USING (event_id)")(
    lambda s, d: testbed.raw_messages(s, d).join(testbed.sentiment_results(s, d), "event_id", "left").select("event_id", signed_sentiment().cast("decimal(18,4)").cast("double").alias("signed"))
)
query("F07_defaults", f"SELECT event_id, {_LABELS} AS label, coalesce(sentiment_score, 0) AS score FROM raw_messages LEFT JOIN sentiment_results USING (event_id)")(
    lambda s, d: testbed.raw_messages(s, d).join(testbed.sentiment_results(s, d), "event_id", "left").select("event_id", label_or_neutral().alias("label"), F.coalesce("sentiment_score", F.lit(0.0)).alias("score"))
)
query("F08_entity_key", f"SELECT DISTINCT {KEY} AS entity_key FROM ner_results")(lambda s, d: testbed.ner_results(s, d).select(entity_key().alias("entity_key")).distinct())
query("F09_latest_run", "SELECT run_id FROM cluster_runs ORDER BY run_timestamp DESC LIMIT 1")(lambda s, d: overview.latest_run(testbed.cluster_runs(s, d)))
query("F05_without_noise", f"SELECT event_id, public_cluster_id FROM {LATEST} WHERE cluster_id >= 0")(lambda s, d: overview.of_latest_run(relations(s, d)).select("event_id", "public_cluster_id"))
query("F10_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")(lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"))
query("F10b_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")(
    lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
)
query("F11_case_insensitive_key", "SELECT n_name, c_name FROM nation JOIN customer ON lower(concat('N', n_nationkey)) = lower(concat('n', c_nationkey))")(lambda s, d: table(s, d, "nation").withColumn("k", F.concat(F.lit("N"), "n_nationkey")).join(table(s, d, "customer").withColumn("j", F.concat(F.lit("n"), "c_nationkey")), F.lower("k") == F.lower("j")).select("n_name", "c_name"))
query("F12_regex", "SELECT c_name FROM customer WHERE regexp_matches(c_name, '^[A-Za-z0-9_#]+$')")(lambda s, d: table(s, d, "customer").where(F.col("c_name").rlike("^[A-Za-z0-9_#]+$")).select("c_name"))
query("F13_either", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 7")(lambda s, d: table(s, d, "customer").where("c_mktsegment = 'BUILDING' OR c_nationkey = 7").select("c_custkey"))
query("F18_sampling_filter", "SELECT doc_id FROM documents WHERE lang IN ('en', 'ru') AND length(text) >= 80 AND NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")(
    lambda s, d: table(s, d, "documents").where("lang in ('en', 'ru') and length(text) >= 80").join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id")
)
query("F19_nullif", "SELECT doc_id, coalesce(nullif(trim(text), ''), source) AS shown FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.coalesce(F.nullif(F.trim("text"), F.lit("")), "source").alias("shown")))
query("F20_migration_defaults", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'full' WHEN lang IS NULL THEN 'unknown' ELSE 'partial' END AS analysis_mode, greatest(n_chars, 100) AS at_least FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "full").when(F.col("lang").isNull(), "unknown").otherwise("partial").alias("analysis_mode"), F.greatest("n_chars", F.lit(100)).alias("at_least"))
)
query("F21_staged_violations", """SELECT (SELECT count(DISTINCT run_id) FROM assignments) AS runs, (SELECT count(*) FROM assignments WHERE probability < 0 OR probability > 1) AS out_of_range,
    (SELECT count(*) FROM assignments WHERE event_id NOT IN (SELECT event_id FROM sentiment_results)) AS orphans, (SELECT count(*) FROM (SELECT event_id FROM assignments GROUP BY 1 HAVING count(*) > 1)) AS duplicates""")(
    lambda s, d: dml.staged_violations(testbed.assignments(s, d), testbed.sentiment_results(s, d))
)
query("F22_record_errors", """SELECT event_id, array_to_string(list_filter([CASE WHEN cluster_id < 0 THEN 'cluster_id' END, CASE WHEN probability > 0.9 THEN 'probability' END, CASE WHEN NOT regexp_matches(public_cluster_id, '^run_b:') THEN 'public_cluster_id' END], lambda x: x IS NOT NULL), ';') AS errors
    FROM assignments WHERE cluster_id < 0 OR probability > 0.9 OR NOT regexp_matches(public_cluster_id, '^run_b:')""")(
    lambda s, d: dml.record_errors(testbed.assignments(s, d), {"cluster_id": F.col("cluster_id") < 0, "probability": F.col("probability") > 0.9, "public_cluster_id": ~F.col("public_cluster_id").rlike("^run_b:")}).select("event_id", F.array_join("errors", ";").alias("errors"))
)

query("J03_conditional_left_join", f"SELECT event_id, public_cluster_id FROM raw_messages LEFT JOIN ({LATEST_ONLY}) USING (event_id)")(
    lambda s, d: (r := relations(s, d)).raw.join(overview.of_latest_run(r).select("event_id", "public_cluster_id"), "event_id", "left").select("event_id", "public_cluster_id")
)
query("J07_two_lookups", "SELECT a.o_orderkey AS child, c.message_date AS child_date, p.message_date AS parent_date FROM orders a LEFT JOIN raw_messages c ON c.message_id = a.o_orderkey LEFT JOIN raw_messages p ON p.message_id = a.o_orderkey - 1")(
    lambda s, d: (lambda raw, o: o.join(raw.select(F.col("message_id").alias("child"), F.col("message_date").alias("child_date")), "child", "left").join(raw.select(F.col("message_id").alias("parent"), F.col("message_date").alias("parent_date")), "parent", "left").select("child", "child_date", "parent_date"))(
        testbed.raw_messages(s, d), table(s, d, "orders").select(F.col("o_orderkey").alias("child"), (F.col("o_orderkey") - 1).alias("parent")))
)
query("J08_either_missing", "SELECT doc_id FROM documents LEFT JOIN (SELECT doc_id, 1 AS q FROM labels WHERE quality = 1) USING (doc_id) LEFT JOIN (SELECT doc_id, 1 AS t FROM labels WHERE toxic = 0) USING (doc_id) WHERE q IS NULL OR t IS NULL")(
    lambda s, d: (lambda lab: table(s, d, "documents").join(lab.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1)).alias("q"), F.max(F.when(F.col("toxic") == 0, 1)).alias("t")), "doc_id", "left").where("q is null or t is null").select("doc_id"))(table(s, d, "labels"))
)
query("J09_anti_join", "SELECT event_id FROM raw_messages WHERE event_id NOT IN (SELECT event_id FROM sentiment_results)")(lambda s, d: testbed.raw_messages(s, d).join(testbed.sentiment_results(s, d), "event_id", "left_anti").select("event_id"))
query("J11_lateral_count", "SELECT c_mktsegment AS name, c_custkey, n FROM customer, LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey)")(
    lambda s, d: table(s, d, "customer").join(table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), "c_custkey", "left").select(F.col("c_mktsegment").alias("name"), "c_custkey", F.coalesce("n", F.lit(0)).alias("n"))
)
query("J12_lateral_first", "SELECT channel, event_id AS first_event FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY message_date, event_id) AS r FROM raw_messages) WHERE r = 1")(
    lambda s, d: testbed.raw_messages(s, d).groupBy("channel").agg(F.min_by("event_id", F.struct("message_date", "event_id")).alias("first_event"))
)
query("J13_lateral_top_k", f"SELECT event_id, array_to_string(list(k ORDER BY c DESC, k), ',') AS top FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY c DESC, k) AS r FROM (SELECT event_id, {KEY} AS k, CAST(max(confidence) * 100 AS INT) AS c FROM ner_results GROUP BY 1, 2)) WHERE r <= 2 GROUP BY 1")(
    lambda s, d: testbed.ner_results(s, d).groupBy("event_id", entity_key().alias("k")).agg(F.round(F.max("confidence") * 100).cast("int").alias("c")).groupBy("event_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "k"))), 1, 2), lambda x: x["k"]), ",").alias("top"))
)
query("J14_natural_join", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem NATURAL JOIN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40)")(
    lambda s, d: (lambda li: li.select("l_orderkey", "l_linenumber", "l_quantity").join(li.where("l_quantity > 40").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]))(table(s, d, "lineitem"))
)
query("J20_outer_lookup", "SELECT conv_id, turn, source FROM conversations LEFT JOIN documents ON conv_id = doc_id")(lambda s, d: (lambda c, x: c.join(x, c.conv_id == x.doc_id, "left").select("conv_id", "turn", "source"))(table(s, d, "conversations"), table(s, d, "documents")))
query("J21_final_table", "SELECT doc_id, CASE WHEN length(text) > 220 THEN concat(rtrim(text[1:217]), '...') ELSE text END AS snippet, quality, toxic FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g')) AS text FROM documents) LEFT JOIN labels USING (doc_id)")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"[ \n\t\r]+", " ")).alias("text")).join(table(s, d, "labels"), "doc_id", "left").select("doc_id", F.when(F.length("text") > 220, F.concat(F.rtrim(F.col("text").substr(1, 217)), F.lit("..."))).otherwise(F.col("text")).alias("snippet"), "quality", "toxic")
)

query("W01_latest_per_channel", "SELECT event_id, channel FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY message_date DESC, message_id DESC) AS r FROM raw_messages) WHERE r <= 50")(
    lambda s, d: testbed.raw_messages(s, d).withColumn("r", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("message_date"), F.desc("message_id")))).where("r <= 50").select("event_id", "channel")
)
query("W02_request_ids", "SELECT n_nationkey, concat('req_', lpad(CAST(row_number() OVER (ORDER BY n_name) AS VARCHAR), 4, '0')) AS request_id FROM nation")(lambda s, d: dml.request_ids(table(s, d, "nation"), "n_name").select("n_nationkey", "request_id"))
query("W03_representatives", "SELECT public_cluster_id, event_id, avg_probability FROM (SELECT *, row_number() OVER (PARTITION BY public_cluster_id ORDER BY probability DESC, event_id) AS r, CAST(sum(CAST(probability AS DECIMAL(18, 4))) OVER w AS DOUBLE) / count(*) OVER w AS avg_probability FROM assignments WINDOW w AS (PARTITION BY public_cluster_id)) WHERE r = 1")(
    lambda s, d: testbed.assignments(s, d).groupBy("public_cluster_id").agg(F.min_by("event_id", F.struct(-F.col("probability"), "event_id")).alias("event_id"), mean(F.col("probability")).alias("avg_probability"))
)
query("W04_one_per_group", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, value DESC, event_id DESC")(
    lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("value", "event_id")).alias("m")).select("user_id", "m.event_id", "m.event_type")
)
query("W05_two_cuts", "SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w DESC, src) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r1 FROM (SELECT s_nationkey AS src, p_brand AS dst, count(*) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)) WHERE r1 <= 5) WHERE r2 <= 3")(
    lambda s, d: dml.two_cuts(table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("s_nationkey").alias("src"), F.col("p_brand").alias("dst")).agg(F.count("*").alias("w")), 5, 3)
)
_COUNTS = f"SELECT public_cluster_id, {KEY} AS entity_key, entity_type, {TEXT} AS entity_text, count(*) AS mention_count FROM ({CLUSTERED}) JOIN ner_results USING (event_id) GROUP BY ALL"
query("W06_distinct_entities", f"""SELECT public_cluster_id, entity_key, entity_type, entity_text, mention_count, place FROM (SELECT *, row_number() OVER (PARTITION BY public_cluster_id ORDER BY mention_count DESC, entity_text, entity_type) AS place
    FROM (SELECT *, row_number() OVER (PARTITION BY public_cluster_id, entity_key ORDER BY mention_count DESC, entity_text, entity_type) AS n FROM ({_COUNTS})) WHERE n = 1) WHERE place <= 5""")(
    lambda s, d: overview.distinct_entities(overview.entities_per_cluster(relations(s, d), START, END), 5)
)
query("W07_slices", "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:3], ',') AS best FROM orders GROUP BY 1")(
    lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))), 1, 3), lambda x: x["o_orderkey"].cast("string")), ",").alias("best"))
)
query("O03_message_page", f"""SELECT event_id, channel, message_id, text, message_date, views, forwards, public_cluster_id, {_LABELS} AS sentiment_label, coalesce(sentiment_score, 0) AS sentiment_confidence, {SIGNED} AS ui_sentiment_score
    FROM raw_messages LEFT JOIN ({LATEST_ONLY}) USING (event_id) LEFT JOIN sentiment_results USING (event_id) WHERE {WINDOW} AND channel = 'BUILDING' AND lower(text) LIKE '%high%' ORDER BY message_date DESC, event_id DESC LIMIT 50 OFFSET 10""")(
    over(overview.messages, START, END, channel="BUILDING", search="high", offset=10)
)
query("O04_nulls_last", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality ASC NULLS LAST, doc_id LIMIT 100")(
    lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", "quality").orderBy(F.asc_nulls_last("quality"), "doc_id").limit(100)
)
query("O07_dates_newest_first", "SELECT CAST(unnest(range(DATE '2026-04-11', DATE '2026-04-15', INTERVAL 1 DAY)) AS DATE) AS job_date")(lambda s, d: dml.backfill_dates(s, "2026-04-10", "2026-04-14", 3))
query("O08_seeded_sample")(lambda s, d: table(s, d, "documents").orderBy(F.xxhash64("doc_id", F.lit(42)), "doc_id").limit(100).select("doc_id"))
query("U01_distinct", "SELECT DISTINCT run_id, cluster_id FROM assignments")(lambda s, d: testbed.assignments(s, d).select("run_id", "cluster_id").distinct())
query("U02_keyed_dedup", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")(lambda s, d: dml.first_per_key(table(s, d, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey"))
query("U03_union", "SELECT c_name AS name, 'c' AS kind FROM customer UNION ALL SELECT s_name, 's' FROM supplier")(
    lambda s, d: table(s, d, "customer").select(F.col("c_name").alias("name"), F.lit("c").alias("kind")).unionByName(table(s, d, "supplier").select(F.col("s_name").alias("name"), F.lit("s").alias("kind")))
)
query("U05_node_union", "SELECT id, min(kind) AS kind FROM (SELECT c_nationkey AS id, 'a' AS kind FROM customer UNION ALL SELECT s_nationkey, 'b' FROM supplier) GROUP BY 1")(
    lambda s, d: dml.first_per_key(table(s, d, "customer").select(F.col("c_nationkey").alias("id"), F.lit("a").alias("kind")).unionByName(table(s, d, "supplier").select(F.col("s_nationkey").alias("id"), F.lit("b").alias("kind"))), ["id"], ["kind"])
)

query("K06_insert_ignore", "SELECT o_orderkey AS k, 'old' AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0")(
    lambda s, d: (lambda o: dml.insert_ignore(o.where("k % 2 = 0").withColumn("v", F.lit("old")), o.where("k % 3 = 0").withColumn("v", F.lit("new")), ["k"]))(table(s, d, "orders").select(F.col("o_orderkey").alias("k")))
)
query("K07_upsert", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")(
    lambda s, d: (lambda o: dml.upsert(o.where("k % 2 = 0").withColumn("v", F.lit("old")), o.where("k % 3 = 0").withColumn("v", F.lit("new")), ["k"]))(table(s, d, "orders").select(F.col("o_orderkey").alias("k")))
)
query("K09_merge_upsert", "SELECT k, coalesce(n.v, o.v) AS v, greatest(o.t, n.t) AS t FROM (SELECT o_orderkey AS k, 'old' AS v, 5 AS t FROM orders WHERE o_orderkey % 2 = 0) o FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'new' END AS v, o_orderkey % 10 AS t FROM orders WHERE o_orderkey % 3 = 0) n USING (k)")(
    lambda s, d: (lambda o: dml.merge_upsert(o.where("k % 2 = 0").select("k", F.lit("old").alias("v"), F.lit(5).cast("long").alias("t")), o.where("k % 3 = 0").select("k", F.when(F.col("k") % 5 == 0, "new").alias("v"), (F.col("k") % 10).alias("t")), ["k"], {"v": "newest", "t": "greatest"}))(table(s, d, "orders").select(F.col("o_orderkey").alias("k")))
)
query("K10_replace", "SELECT l_orderkey, 'kept' AS v FROM lineitem WHERE l_orderkey % 2 = 0 UNION ALL SELECT DISTINCT l_orderkey, 'new' FROM lineitem WHERE l_orderkey % 2 <> 0")(
    lambda s, d: (lambda li: dml.replace_by_key(li.withColumn("v", F.lit("kept")), li.where("l_orderkey % 2 <> 0").distinct().withColumn("v", F.lit("new")), ["l_orderkey"]))(table(s, d, "lineitem").select("l_orderkey"))
)
query("K11_update_from", "SELECT c_custkey, CASE WHEN n IS NULL THEN 'idle' WHEN f > 0 THEN 'failed' ELSE 'ready' END AS status, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1) USING (c_custkey)")(
    lambda s, d: table(s, d, "customer").join(table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f")), "c_custkey", "left").select("c_custkey", F.when(F.col("n").isNull(), "idle").when(F.col("f") > 0, "failed").otherwise("ready").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))
)
query("K12_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")(lambda s, d: dml.retained(table(s, d, "events"), "ts", "2024-01-31 00:00:00", 7).select("event_id"))
query("K13_cache_keys", "SELECT DISTINCT sha256(concat_ws('|', 'v1', public_cluster_id, 'a', 'b')) AS cache_key FROM assignments")(lambda s, d: testbed.assignments(s, d).select(dml.cache_key(F.lit("v1"), F.col("public_cluster_id"), F.lit("a"), F.lit("b")).alias("cache_key")).distinct())
query("K15_reaction_toggle", "SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")(
    lambda s, d: dml.latest(table(s, d, "events"), ["user_id"], ["event_id"]).where("event_type <> 'error'").select("user_id", F.col("event_type").alias("last"))
)
