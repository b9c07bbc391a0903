"""Named queries for texts, fingerprints, enrichment, first sources, topics, graphs, events and the read API."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions import fingerprints as fp
from newsflow.functions import text as tx
from newsflow.functions.semantics import entity_key, title_case, truncated
from newsflow.operators import clustering, density, enrich, first_source, graph, graph_tables, overview
from newsflow.plans import api
from newsflow.plans import relational as rel
from newsflow.session import written
from newsflow.sources import events, testbed
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


def docs(s, d, *columns: str) -> DataFrame:
    """documents, or some columns of it over all cores, for work on whole texts."""
    found = table(s, d, "documents")
    return testbed.spread(found.select(*columns)) if columns else found


SQ = "trim(regexp_replace({0}, '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
CLEAN = SQ.format("regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(https?://|www\\.)\\S+', ' ', 'g'), '@[A-Za-z0-9_]{1,64}', ' ', 'g'), '#[A-Za-z0-9_]{1,64}', ' ', 'g')), '[^\\p{L}\\p{N}_\\s\\p{Z}%]', ' ', 'g')")

query("X01_urls", "SELECT page_id, array_to_string(regexp_extract_all(html, '(?i)(https?://|www\\.)[^\\s\\p{Z}]+'), ' ') AS urls FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit(f"({tx.URL})"), F.lit(1)), " ").alias("urls")))
query("X02_mentions_tags", "SELECT doc_id, array_to_string(regexp_extract_all(text, '@[A-Za-z0-9_]{1,64}'), ' ') AS mentions, array_to_string(regexp_extract_all(text, '#[A-Za-z0-9_]{1,64}'), ' ') AS tags FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", F.array_join(tx.mentions(F.col("text")), " ").alias("mentions"), F.array_join(tx.hashtags(F.col("text")), " ").alias("tags"))
)
query("X03_cleaned", f"SELECT doc_id, {CLEAN} AS cleaned FROM documents")(lambda s, d: docs(s, d, "doc_id", "text").select("doc_id", tx.cleaned(F.col("text")).alias("cleaned")))
query("X05_tokens", f"SELECT doc_id, len(list_filter(string_split({CLEAN}, ' '), lambda x: x <> '')) AS n_words FROM documents")(lambda s, d: docs(s, d, "doc_id", "text").select("doc_id", tx.cleaned(F.col("text")).alias("c")).select("doc_id", F.size(tx.tokens(F.col("c"))).alias("n_words")))
query("X06_sentences", "SELECT doc_id, CASE WHEN trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) = '' THEN 0 ELSE greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '[\\s\\p{Z}]+', ' ', 'g')) <> ''))) END AS n FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", tx.sentences(F.col("text")).alias("n"))
)
query("X08_language", """WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\\p{L}')) AS letters, len(regexp_extract_all(text, '[A-Za-z]')) AS latin, regexp_extract_all(lower(text), '[A-Za-z]{2,}') AS words FROM documents),
    s AS (SELECT *, latin / letters AS share, len(list_filter(words, lambda w: w IN (""" + ", ".join(f"'{w}'" for w in tx.ENGLISH) + """))) AS hits FROM c)
    SELECT doc_id, CASE WHEN letters = 0 OR share < 0.55 OR len(words) = 0 THEN 'und' WHEN greatest(share * least(1.0, hits / 2), CASE WHEN hits > 0 THEN 0.5 ELSE 0 END) >= 0.55 THEN 'en' ELSE 'other' END AS language FROM s""")(
    lambda s, d: docs(s, d, "doc_id", "text").select("doc_id", tx.language(F.col("text"))["language"].alias("language"))
)
query("X09_routing", "SELECT doc_id, CASE WHEN lang IN ('ru', 'en') THEN 'full' ELSE 'partial' END AS mode FROM documents")(lambda s, d: docs(s, d).select("doc_id", tx.analysis_mode(F.col("lang")).alias("mode")))
query("X12_snippets", f"SELECT doc_id, CASE WHEN length(c) > 220 THEN concat(rtrim(c[1:217]), '...') ELSE c END AS snippet FROM (SELECT doc_id, {SQ.format('text')} AS c FROM documents)")(lambda s, d: docs(s, d).select("doc_id", tx.snippet(F.col("text")).alias("snippet")))
query("X16_title_case", "SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(c_mktsegment || ' o''neil-' || c_name, '[a-zA-Z]+|[^a-zA-Z]+'), lambda p: concat(upper(p[1]), lower(p[2:]))), '') AS shown FROM customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", title_case(F.concat("c_mktsegment", F.lit(" o'neil-"), "c_name")).alias("shown"))
)
query("X17_mood", "SELECT c_custkey, CASE WHEN c_acctbal / 10000 > 0.2 THEN 'positive' WHEN c_acctbal / 10000 < -0.2 THEN 'negative' ELSE 'neutral' END AS mood FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", tx.mood(F.col("c_acctbal") / 10000).alias("mood")))
_REFS = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('@name_', p_partkey) WHEN 1 THEN concat('https://t.me/s/name_', p_partkey) WHEN 2 THEN concat('t.me/+secret', p_partkey) ELSE concat('https://example.com/n', p_partkey) END AS ref FROM part"
query("X18_channel_names", f"SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN concat('name_', p_partkey) END AS name FROM ({_REFS})")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("@name_"), "p_partkey")).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("https://t.me/s/name_"), "p_partkey")).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("t.me/+secret"), "p_partkey")).otherwise(F.concat(F.lit("https://example.com/n"), "p_partkey")).alias("ref")).select("p_partkey", tx.channel_name(F.col("ref")).alias("name"))
)
query("X19_start_dates", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1995-01-01' THEN least(CAST(o_orderdate AS DATE), DATE '1997-01-01') END AS start FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", tx.start_date(F.col("o_orderdate").cast("date"), F.lit("1997-01-01").cast("date"), "1995-01-01").alias("start"))
)
query("X21_normalized_urls", "SELECT page_id, concat(regexp_extract(lower(url), '^[a-z]+://[^/?#]*'), CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/+$', '') END, CASE WHEN q = '' THEN '' ELSE concat('?', q) END) AS url FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(ref|utm_[a-z]*)='))), '&') AS q FROM pages)")(
    lambda s, d: table(s, d, "pages").select("page_id", fp.normalized_url(F.col("url")).alias("url"))
)
query("X22_text_hash", "SELECT doc_id, CASE WHEN trim(text) <> '' THEN sha256(trim(text)) END AS h FROM documents")(lambda s, d: docs(s, d).select("doc_id", fp.text_hash(F.col("text")).alias("h")))
query("X23_url_fingerprints")(lambda s, d: table(s, d, "pages").select("page_id", F.array_join(fp.url_fingerprints(F.array("url", F.concat("url", F.lit("#again")))), ",").alias("prints")))
query("X24_simhash64")(lambda s, d: docs(s, d, "doc_id", "text").select("doc_id", fp.simhash64(tx.cleaned(F.col("text"))).alias("simhash")))
query("X25_hamming", "SELECT l_orderkey, l_linenumber, bit_count(xor(l_partkey, l_suppkey)) AS d FROM lineitem")(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", fp.hamming(F.col("l_partkey"), F.col("l_suppkey")).alias("d")))
query("X26_jaccard", """WITH e AS (SELECT event_id, list_sort(list(DISTINCT lower(coalesce(normalized_text, entity_text)))) AS s FROM ner_results GROUP BY 1)
    SELECT a.event_id, CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, b.s))) AS j FROM e a JOIN e b ON CAST(a.event_id AS INT) = CAST(b.event_id AS INT) + 1""")(
    lambda s, d: (lambda e: e.alias("a").join(e.alias("b"), F.col("a.n") == F.col("b.n") + 1).select("a.event_id", fp.jaccard(F.col("a.s"), F.col("b.s")).alias("j")))(testbed.ner_results(s, d).groupBy("event_id").agg(F.collect_set(entity_key()).alias("s")).withColumn("n", F.col("event_id").cast("int")))
)
query("X28_cosine", "SELECT a.vec_id, CAST(CAST(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS DECIMAL(9, 6)) AS DOUBLE) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1")(
    lambda s, d: (lambda e: e.alias("a").join(e.alias("b"), F.col("a.vec_id") == F.col("b.vec_id") + 1).select("a.vec_id", fp.cosine(F.col("a.embedding"), F.col("b.embedding")).cast("decimal(9,6)").cast("double").alias("cosine")))(table(s, d, "embeddings"))
)
query("X31_truncated", "SELECT event_id, date_trunc('hour', ts) AS h, date_trunc('day', ts) AS d FROM events")(lambda s, d: table(s, d, "events").select("event_id", truncated("hour", "ts").alias("h"), truncated("day", "ts").alias("d")))
query("X32_six_hours", "SELECT event_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS bucket FROM events")(lambda s, d: table(s, d, "events").select("event_id", clustering.bucket_of(F.col("ts")).alias("bucket")))
query("X35_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso")))
query("X39_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")))
query("X43_slugs", "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_type)), '[^\\p{L}\\p{N}_]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", tx.slug(F.col("p_type")).alias("slug")))

query("M01_sentiment")(lambda s, d: enrich.sentiment(docs(s, d, "doc_id", "text")).select("doc_id", "label", "score"))
query("M13_embeddings")(lambda s, d: enrich.hashed_embeddings(docs(s, d, "doc_id", "text")).select("doc_id", F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding")))
# texts are embedded once; the vectors are counted, dealt and compared as written
query("M13_clusters")(lambda s, d: clustering.similarity_clusters(written(enrich.hashed_embeddings(docs(s, d)).select(F.col("lang").alias("bucket"), F.col("doc_id").cast("string").alias("event_id"), F.col("doc_id").alias("event_timestamp"), "embedding")), 0.8, probabilities=False).select("bucket", "event_id", "label"))
query("M06_chunks", "SELECT o_orderkey, 1 + CAST(greatest(ceil((o_orderkey % 1000 + 1 - 384) / 320.0), 0) AS INT) AS n FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.size(enrich.chunks(F.sequence(F.lit(0), (F.col("o_orderkey") % 1000).cast("int")))).alias("n")))
query("M08_entities")(lambda s, d: enrich.entities(docs(s, d), ("doc_id",)))
query("M10_relations", """WITH f AS (SELECT event_id, lower(coalesce(normalized_text, entity_text)) AS k, min(start_pos) AS at FROM ner_results GROUP BY 1, 2)
    SELECT a.event_id, a.k AS subject, 'CO_OCCURS_WITH' AS predicate, b.k AS object, 1.0 AS confidence FROM f a JOIN f b ON a.event_id = b.event_id AND (a.at < b.at OR a.at = b.at AND a.k < b.k)""")(lambda s, d: enrich.relations(testbed.ner_results(s, d)))
query("M12_display_names", "SELECT entity_key, entity_text AS shown, aliases FROM (SELECT k AS entity_key, entity_text, count(*) OVER (PARTITION BY k) AS aliases, row_number() OVER (PARTITION BY k ORDER BY n DESC, length(entity_text) DESC, entity_text DESC) AS r FROM (SELECT lower(coalesce(normalized_text, entity_text)) AS k, entity_text, count(*) AS n FROM ner_results GROUP BY 1, 2)) WHERE r = 1")(
    lambda s, d: enrich.display_names(testbed.ner_results(s, d).withColumn("entity_key", entity_key()))
)
query("M15_cluster_terms")(lambda s, d: enrich.cluster_terms(docs(s, d).select(F.col("source").alias("cluster"), "text")))


def source_messages(s, d) -> DataFrame:
    """documents as messages, one a minute: topics of 100 messages, channels by source, the whole text stands for a link."""
    return _with_tokens(cleaned_messages(s, d))


def written_messages(m: DataFrame) -> DataFrame:
    """Cleaned messages, written once; the tokens are split from the cleaned text where they are read."""
    return _with_tokens(written(m))


def _with_tokens(m: DataFrame) -> DataFrame:
    return m.select(*(tx.tokens(F.col("clean")).alias("tokens") if c == "clean" else c for c in m.columns))


def cleaned_messages(s, d, only: DataFrame | None = None) -> DataFrame:
    """source_messages with clean in the place of tokens; with ``only`` (event_id, repeats allowed) the others are left out before their texts are cleaned."""
    m = docs(s, d).withColumn("event_id", F.concat_ws(":", "source", "doc_id"))
    m = m if only is None else m.join(only.distinct(), "event_id", "left_semi")
    m = m.withColumn("message_date", F.timestamp_add("MINUTE", F.col("doc_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    m = m.withColumn("c", tx.cleaned(F.col("text")))
    return m.select(
        F.concat_ws(":", F.lit("run_b"), F.floor(F.col("doc_id") / 100)).alias("public_cluster_id"), "event_id", F.col("source").alias("channel"), F.col("doc_id").alias("message_id"), "message_date", "text",
        F.col("c").alias("clean"), F.array("lang").alias("entities"), F.array(F.sha2("c", 256)).alias("url_fingerprints"), fp.text_hash(F.col("c")).alias("text_hash"), fp.simhash64(F.col("c")).alias("simhash"),
        F.when(F.col("doc_id") % 5 == 0, F.sha2("c", 256)).alias("primary_url"), F.crc32("source").alias("channel_id"),
        F.when(F.col("doc_id") % 7 == 3, F.col("doc_id") - 20).alias("reply_to_message_id"), F.when(F.col("doc_id") % 11 == 5, F.crc32("source")).alias("forward_from_channel_id"), F.when(F.col("doc_id") % 11 == 5, F.col("doc_id") - 40).alias("forward_from_message_id"),
    )


def source_sides(s, d, topic: str | None = None):
    """Messages and their exact and inferred sources, of one topic or of all; exact sources may come from any topic."""
    every = cleaned_messages(s, d)
    m = written_messages(every if topic is None else every.where(F.col("public_cluster_id") == topic))
    everything = m if topic is None else written(every.select("event_id", "channel", "message_id", "message_date", "channel_id", "primary_url"))
    return m, first_source.exact_sources(m, everything), first_source.inferred_sources(m)


query("R01_exact_sources", """WITH m AS (SELECT concat_ws(':', source, doc_id) AS event_id, source, doc_id, CASE WHEN doc_id % 11 = 5 THEN doc_id - 40 END AS f, CASE WHEN doc_id % 7 = 3 THEN doc_id - 20 END AS r FROM documents)
    SELECT m.event_id, CASE WHEN a.doc_id IS NOT NULL THEN 'exact_forward' WHEN b.doc_id IS NOT NULL THEN 'exact_reply' ELSE 'unknown' END AS source_type, CASE WHEN a.doc_id IS NOT NULL THEN 1.0 WHEN b.doc_id IS NOT NULL THEN 0.97 ELSE 0.0 END AS confidence, coalesce(a.event_id, b.event_id) AS source_event_id
    FROM m LEFT JOIN m a ON a.source = m.source AND a.doc_id = m.f LEFT JOIN m b ON b.source = m.source AND b.doc_id = m.r""")(
    lambda s, d: (lambda m: first_source.exact_sources(m, m).select("event_id", "source_type", "confidence", "source_event_id"))(source_messages(s, d).withColumn("primary_url", F.lit(None).cast("string")))
)
# topics of one source each grow with the table
query("R02_inferred_sources")(lambda s, d: first_source.inferred_sources(written_messages(cleaned_messages(s, d).withColumn("public_cluster_id", F.concat_ws(":", F.lit("run_b"), "channel")))))
query("R05_cluster_exact")(lambda s, d: first_source.cluster_exact(source_sides(s, d)[1]))
query("R06_cluster_inferred", "SELECT concat('run_b:', CAST(floor(doc_id / 100) AS BIGINT)) AS public_cluster_id, arg_min(concat_ws(':', source, doc_id), doc_id) AS source_event_id, 0.35 AS confidence FROM documents GROUP BY 1")(lambda s, d: first_source.cluster_inferred(source_messages(s, d)))
query("R07_propagation_links")(lambda s, d: (lambda m, e, i: first_source.propagation_links(e, i))(*source_sides(s, d)))
query("R09_pending_clusters", "SELECT DISTINCT public_cluster_id FROM assignments WHERE cluster_id >= 0 AND cluster_id % 2 = 1 ORDER BY 1 LIMIT 20")(
    lambda s, d: (lambda a: first_source.pending(a, a.where("cluster_id % 2 = 0").select("public_cluster_id", F.explode(F.array(F.lit("exact"), F.lit("inferred"))).alias("resolution_kind"))))(testbed.assignments(s, d))
)


def vectors(s, d) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("label").alias("bucket"), F.col("vec_id").cast("string").alias("event_id"), F.col("vec_id").alias("event_timestamp"), "embedding")


query("C04_similarity_clusters")(lambda s, d: clustering.global_labels(clustering.similarity_clusters(vectors(s, d))))
query("C04_components", """WITH RECURSIVE v AS (SELECT label AS bucket, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.bucket IS NOT DISTINCT FROM b.bucket AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.68),
    r AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), m AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
    SELECT bucket, CAST(vec_id AS VARCHAR) AS event_id, CAST(dense_rank() OVER (PARTITION BY bucket ORDER BY root) - 1 AS INT) AS label FROM v JOIN m ON m.id = v.vec_id""")(lambda s, d: clustering.similarity_clusters(vectors(s, d), probabilities=False).select("bucket", "event_id", "label"))
query("C03_density_topics")(lambda s, d: density.density_topics(vectors(s, d)).select("bucket", "event_id", "label", F.round("probability", 9).alias("probability"), "strategy"))
query("C03_core_distances", """WITH v AS (SELECT label AS bucket, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    d AS (SELECT a.bucket, a.vec_id, 2 - 2 * list_cosine_similarity(a.x, b.x) AS d FROM v a JOIN v b ON a.bucket = b.bucket AND a.vec_id <> b.vec_id)
    SELECT bucket, CAST(vec_id AS VARCHAR) AS event_id, round(d, 6) AS core FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS k FROM d) WHERE k = 3""")(
    lambda s, d: density.core_distances(clustering.numbered_rows(vectors(s, d), density.TOGETHER), [3]).select("bucket", "event_id", F.round(F.col("cores")[0], 6).alias("core"))
)
#: Settings that are tried, as (rows of a cluster, samples of a core distance).
SETTINGS = ((15, 5), (25, 5), (25, 10), (50, 10), (50, 15), (5, 3))
query("C09_sweep")(lambda s, d: density.sweep(vectors(s, d), SETTINGS))
query("C01_pending", "SELECT event_id FROM raw_messages WHERE event_id NOT IN (SELECT event_id FROM assignments WHERE run_id = 'run_a')")(lambda s, d: clustering.pending(testbed.raw_messages(s, d), testbed.assignments(s, d).where("run_id = 'run_a'")).select("event_id"))
query("C09_config_scores", "SELECT n_nationkey, (CASE WHEN n_nationkey / 25.0 <= 0.35 THEN 1.0 ELSE 0.0 END + CASE WHEN n_regionkey / 5.0 > 0.05 AND n_regionkey / 5.0 < 0.9 THEN 1.0 ELSE 0.0 END + CASE WHEN n_nationkey > 2 THEN 0.5 ELSE 0.0 END + least(n_nationkey / 20.0, 1.0) - n_nationkey / 25.0) AS score FROM nation")(
    lambda s, d: table(s, d, "nation").select("n_nationkey", clustering.config_score(F.col("n_nationkey") / 25, F.col("n_regionkey") / 5, F.col("n_nationkey")).alias("score"))
)
query("G28_run_id", "SELECT concat('run_', sha1(concat('similarity|', string_agg(CAST(n_name AS VARCHAR), '|' ORDER BY n_name)))[1:12]) AS run_id FROM nation")(lambda s, d: table(s, d, "nation").agg(clustering.run_id(F.col("n_name")).alias("run_id")))


def topic_mentions(s, d) -> DataFrame:
    r = rel.relations(s, d)
    m = overview.of_latest_run(r).join(r.raw, "event_id").join(r.ner, "event_id")
    return overview.mention_counts(m, "public_cluster_id", "event_id", "channel").withColumnRenamed("public_cluster_id", "cluster")


def topic_graph(s, d) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all topics. Mentions are counted once, and what reads the graph several times or in rounds finds it written: it is as small as the topics' entities are few, however many messages there are."""
    nodes, edges = graph.build(written(topic_mentions(s, d)))
    return written(nodes), written(edges)


MENTIONS = "SELECT public_cluster_id AS cluster, event_id, channel, lower(coalesce(normalized_text, entity_text)) AS k, entity_type AS ty, coalesce(max(normalized_text), min(entity_text)) AS t, count(*) AS n FROM assignments JOIN raw_messages USING (event_id) JOIN ner_results USING (event_id) WHERE run_id = 'run_b' AND cluster_id >= 0 GROUP BY 1, 2, 3, 4, 5"
ENT = "concat('ent-', upper(ty), ':', k)"
EDGES = f"SELECT cluster, concat('ch-', channel) AS a, {ENT} AS b, CAST(sum(n) AS DOUBLE) AS weight, 'mentions' AS kind FROM m GROUP BY 1, 2, 3 UNION ALL SELECT x.cluster, x.e, y.e, CAST(sum(least(x.n, y.n)) AS DOUBLE), 'co_occurs' FROM p x JOIN p y ON x.cluster = y.cluster AND x.event_id = y.event_id AND x.e < y.e GROUP BY 1, 2, 3"
GRAPH = f"WITH m AS ({MENTIONS}), p AS (SELECT cluster, event_id, {ENT} AS e, sum(n) AS n FROM m GROUP BY 1, 2, 3), edges AS ({EDGES}), nodes AS (SELECT cluster, concat('ch-', channel) AS id, max(channel) AS label, CAST(sum(n) AS DOUBLE) AS weight, 'channel' AS kind FROM m GROUP BY 1, 2 UNION ALL SELECT cluster, {ENT}, max(t), CAST(sum(n) AS DOUBLE), 'entity' FROM m GROUP BY 1, 2)"
query("N01_graph_nodes", f"{GRAPH} SELECT * FROM nodes")(lambda s, d: graph.build(written(topic_mentions(s, d)))[0])
query("N01_graph_edges", f"{GRAPH} SELECT * FROM edges")(lambda s, d: graph.build(written(topic_mentions(s, d)))[1])
query("N02_degrees", f"""{GRAPH}, e AS (SELECT cluster, a AS id, b AS o, weight FROM edges UNION ALL SELECT cluster, b, a, weight FROM edges), c AS (SELECT cluster, count(*) AS n FROM nodes GROUP BY 1)
    SELECT cluster, id, count(DISTINCT o) AS degree, coalesce(sum(e.weight), 0.0) AS weighted_degree, count(DISTINCT o) / greatest(any_value(n) - 1, 1) AS degree_centrality FROM nodes LEFT JOIN e USING (cluster, id) JOIN c USING (cluster) GROUP BY 1, 2""")(lambda s, d: graph.degrees(*topic_graph(s, d)))
query("N03_graph_measures")(lambda s, d: graph.measures(*topic_graph(s, d)))
query("N04_page_ranks")(lambda s, d: graph_tables.page_ranks(*topic_graph(s, d)).select("cluster", "id", F.round("pagerank", 9).alias("pagerank")))
query("N06_components", f"""{GRAPH.replace('WITH', 'WITH RECURSIVE', 1)}, e AS (SELECT cluster, a, b FROM edges UNION SELECT cluster, b, a FROM edges), r AS (SELECT cluster, id, id AS root FROM nodes UNION SELECT e.cluster, e.b, r.root FROM r JOIN e ON e.cluster = r.cluster AND e.a = r.id),
    q AS (SELECT cluster, id, min(root) AS root FROM r GROUP BY 1, 2) SELECT cluster, id, dense_rank() OVER (PARTITION BY cluster ORDER BY root) - 1 AS component FROM q""")(lambda s, d: graph_tables.component_numbers(*topic_graph(s, d)))
query("N09_graph_summary", f"{GRAPH} SELECT cluster, n AS node_count, coalesce(m, 0) AS edge_count, CASE WHEN n < 2 THEN 0.0 ELSE 2 * coalesce(m, 0) / (n * (n - 1)) END AS density, 2 * coalesce(m, 0) / n AS average_degree, n < 3 OR coalesce(m, 0) < 2 AS is_small FROM (SELECT cluster, count(*) AS n FROM nodes GROUP BY 1) LEFT JOIN (SELECT cluster, count(*) AS m FROM edges GROUP BY 1) USING (cluster)")(
    lambda s, d: graph.summary(*topic_graph(s, d))
)
query("N10_communities")(lambda s, d: (lambda n, e: graph.community_summary(graph.measures(n, e), n, e).withColumn("top", F.array_join("top", "|")))(*topic_graph(s, d)))
query("N14_pmi_edges", """WITH p AS (SELECT DISTINCT event_id, lower(coalesce(normalized_text, entity_text)) AS k FROM ner_results), s AS (SELECT k, count(*) AS n FROM p GROUP BY 1), t AS (SELECT count(DISTINCT event_id) AS total FROM p),
    b AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM p x JOIN p y ON x.event_id = y.event_id AND x.k < y.k GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT b.a, b.b, c AS "both", ln(c * total / (sa.n * sb.n)) AS pmi FROM b JOIN s sa ON sa.k = b.a JOIN s sb ON sb.k = b.b, t WHERE ln(c * total / (sa.n * sb.n)) >= 0""")(lambda s, d: graph.pmi_edges(testbed.ner_results(s, d).withColumn("entity_key", entity_key())))
query("N14b_theme_mentions", """WITH n AS (SELECT public_cluster_id AS cluster, lower(coalesce(normalized_text, entity_text)) AS entity_key, count(*) AS n FROM assignments JOIN ner_results USING (event_id) GROUP BY 1, 2)
    SELECT cluster, entity_key, n, n * (ln((1 + (SELECT count(DISTINCT cluster) FROM n)) / (1 + df)) + 1) AS weight FROM n JOIN (SELECT entity_key, count(*) AS df FROM n GROUP BY 1) USING (entity_key) WHERE n >= 3""")(
    lambda s, d: graph.theme_mentions(testbed.assignments(s, d).join(testbed.ner_results(s, d), "event_id").select(F.col("public_cluster_id").alias("cluster"), entity_key().alias("entity_key")))
)
query("N16_two_hops", f"""{GRAPH}, e AS (SELECT a, b FROM edges WHERE weight >= 3 UNION SELECT b, a FROM edges WHERE weight >= 3), one AS (SELECT DISTINCT b AS id FROM e WHERE a = 'ch-BUILDING')
    SELECT id, CAST(min(h) AS INT) AS hops FROM (SELECT id, 1 AS h FROM one UNION ALL SELECT b, 2 FROM e WHERE a IN (SELECT id FROM one)) WHERE id <> 'ch-BUILDING' GROUP BY 1""")(
    lambda s, d: graph.two_hops(topic_graph(s, d)[1], s.createDataFrame([("ch-BUILDING",)], "id string"))
)


def event_values(s, d) -> DataFrame:
    """events as envelopes, some of them broken."""
    e = table(s, d, "events")
    payload = F.struct(F.col("event_id").alias("message_id"), F.col("event_type").alias("channel"), F.lit("x").alias("text"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    own = F.concat_ws(":", "event_type", "event_id")
    whole = F.struct(F.when(F.col("event_id") % 13 == 1, F.lit("other:1")).otherwise(own).alias("event_id"), F.lit("raw_message").alias("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_timestamp"), F.when(F.col("event_id") % 17 != 1, F.lit("v1.0.0")).alias("event_version"), F.lit("t").alias("source_system"), F.lit("00000000-0000-0000-0000-000000000000").alias("trace_id"), payload.alias("payload"))
    return e.select(own.alias("key"), F.when(F.col("event_id") % 19 == 1, F.lit("{broken")).otherwise(F.to_json(whole)).alias("value"), "event_id")


query("S03_decode_reasons", "SELECT concat_ws(':', event_type, event_id) AS key, CASE WHEN event_id % 19 = 1 THEN 'invalid_json' WHEN event_id % 17 = 1 OR event_id < 1 THEN 'invalid_schema' WHEN event_id % 13 = 1 THEN 'invalid_event_id' END AS reason FROM events")(
    lambda s, d: events.decode(event_values(s, d)).select("key", "reason")
)
query("S13_valid_messages", "SELECT concat_ws(':', event_type, event_id) AS event_id, event_type AS channel, event_id AS message_id FROM events WHERE event_id >= 1 AND event_id % 19 <> 1 AND event_id % 17 <> 1 AND event_id % 13 <> 1")(lambda s, d: events.valid(events.decode(event_values(s, d))).select("event_id", "channel", "message_id"))
query("S09_day", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")(lambda s, d: events.days(table(s, d, "events"), "ts", "2024-01-05 00:00:00", "2024-01-06 00:00:00").select("event_id"))
query("S12_high_water", "SELECT channel, max(message_id) AS last_id FROM raw_messages GROUP BY 1")(lambda s, d: events.high_water(testbed.raw_messages(s, d)))
query("S14_media_types", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'photo' WHEN contains(lower(p_type), 'tin') THEN 'video' ELSE 'other' END AS kind FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", events.media_type(F.regexp_replace(F.regexp_replace(F.lower("p_type"), "brass", "MessageMediaPhoto"), "tin", "Video")).alias("kind"))
)
query("S15_targets", "SELECT DISTINCT ON (lower(name)) name FROM (SELECT c_mktsegment AS name, 0 AS r FROM customer UNION ALL SELECT lower(c_mktsegment), 1 FROM customer UNION ALL SELECT n_name, 1 FROM nation) ORDER BY lower(name), r, name")(
    lambda s, d: events.targets(table(s, d, "customer").select(F.col("c_mktsegment").alias("name")), table(s, d, "customer").select(F.lower("c_mktsegment").alias("name")).unionByName(table(s, d, "nation").select(F.col("n_name").alias("name"))))
)
query("T03_dedup", "SELECT DISTINCT o_custkey AS event_id FROM orders")(lambda s, d: ingest.deduplicated(table(s, d, "orders").select(F.col("o_custkey").alias("event_id"))))
query("T07_upstream", "SELECT doc_id, quality IS NULL AS missing_upstream FROM documents LEFT JOIN labels USING (doc_id)")(
    lambda s, d: ingest.with_upstream(docs(s, d).select("doc_id", F.lit("c").alias("channel"), F.col("doc_id").alias("message_id")), table(s, d, "labels").select(F.lit("c").alias("channel"), F.col("doc_id").alias("message_id"))).select("doc_id", "missing_upstream")
)
query("T14_job_states", """SELECT user_id AS channel, CAST(ts AS DATE) AS job_date, CASE WHEN last = 'error' AND failures < 3 THEN 'retrying' WHEN last = 'error' THEN 'failed' ELSE 'completed' END AS state, failures, CASE WHEN last = 'error' AND failures < 3 THEN CAST(least(30, pow(2, failures - 1)) AS INT) END AS wait_seconds
    FROM (SELECT user_id, CAST(ts AS DATE) AS ts, arg_max(event_type, event_id) AS last, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1, 2)""")(
    lambda s, d: ingest.job_states(table(s, d, "events").select(F.col("user_id").alias("channel"), F.col("ts").cast("date").alias("job_date"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("outcome")))
)
query("T09_event_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda s, d: ingest.windowed(table(s, d, "events"), "ts", "6 hours", "1 day", "event_type"))

for name, call in api.ROUTES.items():
    query(f"API_{name}")(call)
