"""Relational and stateful queries: argmax, ranks, quotas, statistics, limiters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.catalog.base import column, query, read
from pageloom.functions import urls
from pageloom.operators import articles, robots
from pageloom.plans import errors
from pageloom.streaming import state

_FETCH = "(SELECT event_id, ts, user_id, event_type <> 'error' AS ok, event_type = 'view' AS cached, CAST(floor(value * 10) AS BIGINT) AS ms, length(props) AS bytes, 'h' || user_id % 20 AS host FROM events)"


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log of fetches."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "view").alias("cached"), F.floor(F.col("value") * 10).cast("long").alias("ms"), F.length("props").cast("long").alias("bytes"), F.concat(F.lit("h"), F.col("user_id") % 20).alias("host"))


_TITLES = [f"Title number {i}" for i in range(10)]
_EXCERPTS = [f"Excerpt {i}" for i in range(5)]
_AUTHORS = ["A. Able", "B. Baker", "C. Cole", "D. Dean", "E. East"]


@query("SELECT url, event_id, confidence FROM (SELECT 'u' || user_id AS url, event_id, (event_id * 7 % 10) / CAST(10 AS DOUBLE) AS confidence, row_number() OVER (PARTITION BY user_id ORDER BY event_id * 7 % 10 DESC, event_id) AS n FROM events) WHERE n = 1")
def dedupe_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("url"), "event_id", (F.col("event_id") * 7 % 10 / 10).alias("confidence"))
    return articles.dedupe(e, order="event_id")


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.8 ELSE 0.6 END AS c, ts FROM events) ORDER BY c DESC, ts DESC, event_id LIMIT 1000")
def rank_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, 0.8).otherwise(0.6).alias("confidence"), "ts")
    return articles.rank(e, published="ts", guid="event_id").select("event_id")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 5")
def quota_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.quota(read(spark, sf_dir, "events"), "user_id", 5, F.col("ts"), F.col("event_id")).select("event_id", "user_id")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-28 00:00:00' - INTERVAL 48 HOUR ORDER BY ts DESC LIMIT 100000000")
def recent_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-28 00:00:00").cast("timestamp")
    return articles.recent(read(spark, sf_dir, "events"), "ts", now, most=100_000_000).select("event_id", "ts")


@query(
    "SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL AND n_chars < 2000 AND length(lang) < 5 THEN 'found' ELSE lang END AS title, CASE WHEN l.doc_id IS NOT NULL AND n_chars < 2000 THEN 'full' ELSE text END AS content,"
    " CASE WHEN l.doc_id IS NOT NULL AND n_chars < 2000 THEN 'q' || quality ELSE source END AS excerpt, CASE WHEN l.doc_id IS NOT NULL AND n_chars < 2000 THEN CAST(0.6 AS DOUBLE) + CAST(0.1 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS confidence FROM documents d LEFT JOIN labels l USING (doc_id)".replace("l.doc_id", "l.quality")
)
def enhance_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates, labels as what was extracted for some of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("title"), F.col("text").alias("content"), F.col("source").alias("excerpt"), F.lit(0.6).alias("confidence"))
    found = read(spark, sf_dir, "labels").select("doc_id", F.lit("found").alias("title"), F.lit("full").alias("content"), F.concat(F.lit("q"), "quality").alias("excerpt"))
    return articles.enhance(docs, found, "doc_id")


@query("SELECT count(*) AS attempted, count(*) FILTER (WHERE event_id % 10 >= 5) AS successful, CAST(3 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS filtered FROM events")
def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.extraction_stats(read(spark, sf_dir, "events").select((F.col("event_id") % 10 / 10).alias("confidence")), errors=3)


@query("SELECT count(*) AS discovered, count(*) FILTER (WHERE n_chars > 100) AS allowed, count(*) FILTER (WHERE n_chars > 100 AND lang = 'en') AS extracted, count(*) FILTER (WHERE n_chars > 1000 AND lang = 'en') AS passed FROM documents")
def funnel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return articles.funnel(read(spark, sf_dir, "documents"), allowed=n > 100, extracted=F.col("lang") == "en", passed=n > 1000)


@query("SELECT source, CASE WHEN count(*) FILTER (WHERE n_chars > 20000) > 0 THEN 'high' WHEN count(*) FILTER (WHERE n_chars > 15000) > 0 THEN 'medium' ELSE 'low' END AS confidence FROM documents GROUP BY source")
def confidence_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(articles.confidence_label(F.count_if(F.col("n_chars") > 20000), F.count_if(F.col("n_chars") > 15000)).alias("confidence"))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE NOT ok) AS failed, CAST(floor(sum(ms) / CAST(count(*) AS DOUBLE) + 0.5) AS BIGINT) AS average_ms FROM {_FETCH}")
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.batch_stats(fetches(spark, sf_dir))


@query("SELECT url AS source_url, url, 't' || page_id AS title FROM pages UNION ALL SELECT url, url || s, 's' || s FROM pages, (SELECT unnest(['a', 'b']) AS s)")
def flatten_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    found = lambda s: F.struct(F.concat("url", F.lit(s)).alias("url"), F.lit("s" + s).alias("title"))
    return articles.flatten(pages.select("url", F.concat(F.lit("t"), "page_id").alias("title")), pages.select("url", F.array(found("a"), found("b")).alias("articles")))


@query(f"SELECT count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(floor(sum(ms) / CAST(count(*) AS DOUBLE) + 0.5) AS BIGINT) AS avg_latency, count(*) FILTER (WHERE NOT ok) AS failures, count(*) FILTER (WHERE cached) AS hits, count(*) FILTER (WHERE NOT cached) AS misses, count(*) FILTER (WHERE cached) / CAST(count(*) AS DOUBLE) AS hit_rate FROM {_FETCH}")
def debug_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.debug_metrics(fetches(spark, sf_dir))


@query(f"SELECT host, count(*) AS requests, count(*) FILTER (WHERE NOT ok) AS failures FROM {_FETCH} GROUP BY host")
def host_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.host_stats(fetches(spark, sf_dir))


@query("SELECT count(*) AS n, max(ts) AS newest, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-28 00:00:00') AS recent FROM events")
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.agg(F.count("*").alias("n"), F.max("ts").alias("newest"), F.count_if(F.col("ts") >= F.lit("2024-01-28 00:00:00").cast("timestamp")).alias("recent"))


def _choices(values: list[str]) -> str:
    return repr(values)


@query(f"SELECT doc_id AS seed, {_choices(_TITLES)}[doc_id % 10 + 1] AS title, {_choices(_EXCERPTS)}[doc_id % 5 + 1] AS excerpt, {_choices(_AUTHORS)}[doc_id % 5 + 1] AS author, 500 + doc_id * 100 % 1000 AS word_count, CAST(ceil((500 + doc_id * 100 % 1000) / 200.0) AS BIGINT) AS reading_time, '2024-01-15' AS published FROM documents")
def mock_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.mock_articles(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seed")), _TITLES, _EXCERPTS, _AUTHORS)


column(
    "suggested_action",
    "events",
    "event_id",
    lambda: robots.suggested_action(F.col("event_type") != "error", F.col("user_id") % 11 == 0, F.col("user_id") % 7 != 0, F.col("event_id") % 5 == 0, F.when(F.col("event_id") % 9 == 0, 429).otherwise(200), F.col("value") * 100),
    "CASE WHEN event_type = 'error' THEN 'skip' WHEN user_id % 11 = 0 THEN 'requires-auth' WHEN user_id % 7 = 0 THEN 'skip' WHEN event_id % 5 = 0 OR event_id % 9 = 0 OR value * 100 > 5000 THEN 'use-proxy' ELSE 'scrape' END",
)
column("backoff_schedule", "events", "event_id", lambda: state.backoff_ms((F.col("event_id") % 8).cast("int"), multiplier=(F.col("user_id") % 3 + 1).cast("double")), "CAST(least(1000.0 * (user_id % 3 + 1) * pow(2, event_id % 8), 60000) AS BIGINT)")
column("retryable", "events", "event_id", lambda: state.retryable(F.when(F.col("event_id") % 4 == 0, 429).when(F.col("event_id") % 4 == 1, 503).when(F.col("event_id") % 4 == 2, 404)), "coalesce(event_id % 4 IN (0, 1), false)")
column("content_guid", "documents", "doc_id", lambda: urls.content_guid(F.col("text"), F.lit("2024-01-15"), F.col("source")), r"sha256(regexp_replace(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), '[^\w\s]', '', 'g') || '|2024-01-15|' || lower(trim(source)))")


#: The fetches of a key in the order of time, for recursion from one to the next.
_STEPS = "e AS (SELECT *, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM " + _FETCH + ")"


@query(
    f"WITH RECURSIVE {_STEPS.format(key='user_id')}, r AS (SELECT user_id, event_id, n, true AS allowed, [at_ms] AS times FROM e WHERE n = 1"
    " UNION ALL SELECT user_id, event_id, n, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, at_ms) ELSE kept END"
    " FROM (SELECT e.*, list_filter(r.times, lambda t: e.at_ms - t < 3600000) AS kept FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) AS x) SELECT user_id, event_id, allowed FROM r"
)
def sliding_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.replay(fetches(spark, sf_dir), lambda: state.SlidingLimiter(3, 3_600_000), "user_id", name="allowed")


@query(
    f"WITH RECURSIVE {_STEPS.format(key='user_id')}, r AS (SELECT user_id, event_id, n, 'closed' AS seen, CASE WHEN ok THEN 0 ELSE 1 END AS failures, CASE WHEN ok THEN 0 ELSE at_ms END AS last, 'closed' AS state FROM e WHERE n = 1"
    " UNION ALL SELECT user_id, event_id, n, now, CASE WHEN now = 'open' THEN failures WHEN ok THEN 0 ELSE failures + 1 END, CASE WHEN now = 'open' OR ok THEN last ELSE at_ms END,"
    " CASE WHEN now = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN failures + 1 >= 3 THEN 'open' ELSE now END"
    " FROM (SELECT e.*, r.failures, r.last, CASE WHEN r.state <> 'open' THEN r.state WHEN e.at_ms - r.last < 3600000 THEN 'open' ELSE 'half_open' END AS now FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) AS x)"
    " SELECT user_id, event_id, seen AS state FROM r"
)
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.replay(fetches(spark, sf_dir), lambda: state.CircuitBreaker(3, 3_600_000), "user_id", name="state")


@query(
    f"WITH RECURSIVE {_STEPS.format(key='host')}, r AS (SELECT host, event_id, n, false AS hit, [{{'item': user_id, 'until': at_ms + 3600000}}] AS held FROM e WHERE n = 1"
    " UNION ALL SELECT host, event_id, n, hit, list_append(CASE WHEN NOT hit AND len(others) >= 5 THEN others[len(others) - 3 :] ELSE others END, {'item': user_id, 'until': CASE WHEN hit THEN old ELSE at_ms + 3600000 END})"
    " FROM (SELECT e.*, list_filter(r.held, lambda h: h.item <> e.user_id) AS others, list_filter(r.held, lambda h: h.item = e.user_id)[1].until AS old,"
    " coalesce(e.at_ms < list_filter(r.held, lambda h: h.item = e.user_id)[1].until, false) AS hit FROM r JOIN e ON e.host = r.host AND e.n = r.n + 1) AS x) SELECT host, event_id, hit FROM r"
)
def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fetches(spark, sf_dir).withColumn("item", F.col("user_id"))
    return state.replay(log, lambda: state.TtlCache(3_600_000, 5), "host", name="hit")


@query(f"WITH {_STEPS.format(key='host')} SELECT host, event_id, CAST(max(at_ms - n * 1000000) OVER (PARTITION BY host ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + n * 1000000 AS BIGINT) AS at_ms FROM e")
def host_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.host_times(fetches(spark, sf_dir), 0.001, name="at_ms")


@query(None)
def priority_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fetches(spark, sf_dir).withColumn("priority", (F.col("event_id") % 3).cast("int"))
    return state.priority_times(log, "conservative", name="at_ms")


@query(f"SELECT count(*) FILTER (WHERE cached) AS hits, count(*) FILTER (WHERE NOT cached) AS misses, count(DISTINCT user_id) AS items, CAST(1000 AS BIGINT) AS max_size, count(*) FILTER (WHERE cached) / CAST(count(*) AS DOUBLE) AS hit_rate FROM {_FETCH}")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.cache_stats(fetches(spark, sf_dir), hit="cached", item="user_id")


@query(
    "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'INVALID_URL' WHEN event_id % 11 = 0 THEN 'CIRCUIT_OPEN' WHEN event_id % 7 = 0 THEN 'ROBOTS_BLOCKED' WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'REQUEST_TIMEOUT' WHEN event_id % 5 = 0 THEN 'RATE_LIMIT_EXCEEDED'"
    " WHEN event_id % 5 = 1 THEN 'INVALID_URL' WHEN event_id % 5 = 2 OR event_type = 'error' THEN 'SCRAPER_ERROR' WHEN event_type = 'view' THEN 'NO_CONTENT_FOUND' WHEN event_type = 'click' THEN 'CONTENT_EXTRACTION_FAILED' END AS code FROM events"
)
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fetches of which some went wrong."""
    e, n = read(spark, sf_dir, "events"), F.col("event_id")
    kind = F.col("event_type")
    message = F.when(kind == "error", F.when(F.col("user_id") % 2 == 0, "connection timed out").otherwise("refused"))
    status = F.element_at(F.array(*map(F.lit, (429, 404, 503, 200, 200))), (n % 5 + 1).cast("int"))
    code = errors.error_code(F.when(n % 13 == 0, "no url").otherwise("https://x.org/a"), status, message, F.when(kind != "view", kind != "click"), n % 7 != 0, F.when(n % 11 == 0, "open"))
    return e.select("event_id", code.alias("code"))
