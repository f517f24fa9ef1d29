"""Relational operations on article candidates: argmax, ranking, quotas, enrichment, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.functions import urls

#: Articles kept of one source.
MOST = 1000
FULL_CONTENT = 2000


def dedupe(df: DataFrame, url: str = "url", confidence: str = "confidence", order: str = "ord") -> DataFrame:
    """Of each URL the row of the highest confidence, the first of equals."""
    best = W.partitionBy(url).orderBy(F.desc(confidence), order)
    return df.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def rank(df: DataFrame, most: int = MOST, confidence: str = "confidence", published: str = "published_at", guid: str = "guid") -> DataFrame:
    """The best by confidence, then date; the guid breaks ties."""
    return df.orderBy(F.desc(confidence), F.desc(published), guid).limit(most)


def rank_sites(df: DataFrame, most: int | None = MOST, url: str = "url", confidence: str = "confidence", published: str = "published_at", guid: str = "guid") -> DataFrame:
    """Of each site the best as ``rank`` orders them, or all if ``most`` is None."""
    if most is None:
        return df
    return quota(df.withColumn("_site", urls.domain(F.col(url))), "_site", most, F.desc(confidence), F.desc(published), F.col(guid)).drop("_site")


def quota(df: DataFrame, group: str, most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows of each group."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def recent(df: DataFrame, ts: str, now: Column, hours: int = 48, most: int = 1000) -> DataFrame:
    """The newest rows of the last hours; rows without a time are none."""
    return df.where(F.col(ts) >= now - F.make_interval(hours=F.lit(hours))).orderBy(F.desc(ts)).limit(most)


def recent_stream(df: DataFrame, ts: str, key: str, hours: int = 48) -> DataFrame:
    """Of a stream the first row of each key; what is older than the newest time less ``hours`` is late and dropped, and
    so is the state of keys."""
    return df.where(F.col(ts).isNotNull()).withWatermark(ts, f"{hours} hours").dropDuplicatesWithinWatermark([key])


def enhance(articles: DataFrame, extracted: DataFrame, key: str = "url") -> DataFrame:
    """Articles (key, title, content, excerpt, confidence) of under 2000 characters take over what was extracted (same columns)."""
    e = extracted.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in ("title", "content", "excerpt")))
    joined = articles.join(e, F.col(key) == F.col("_k"), "left")
    due = F.col("_k").isNotNull() & (F.coalesce(F.length("content"), F.lit(0)) < FULL_CONTENT)
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    made = {
        "title": F.when(due & (F.coalesce(F.length("title"), F.lit(0)) < 5), F.coalesce(given("_title"), F.col("title"))).otherwise(F.col("title")),
        "content": F.when(due, F.col("_content")).otherwise(F.col("content")),
        "excerpt": F.when(due, F.coalesce(given("_excerpt"), F.col("excerpt"))).otherwise(F.col("excerpt")),
        "confidence": F.when(due, F.least(F.col("confidence") + 0.1, F.lit(1.0))).otherwise(F.col("confidence")),
    }
    return joined.select(*(made[c].alias(c) if c in made else F.col(c) for c in articles.columns))


def extraction_stats(df: DataFrame, confidence: str = "confidence", errors: int = 0) -> DataFrame:
    return df.agg(F.count("*").alias("attempted"), F.count_if(F.col(confidence) >= 0.5).alias("successful"), F.lit(errors).cast("long").alias("failed"), F.lit(0).cast("long").alias("filtered"))


def funnel(df: DataFrame, **steps: Column) -> DataFrame:
    """How many rows pass each step and all before it, in one pass."""
    passed, out = F.lit(True), [F.count("*").alias("discovered")]
    for name, test in steps.items():
        passed = passed & F.coalesce(test, F.lit(False))
        out.append(F.count_if(passed).alias(name))
    return df.agg(*out)


def confidence_label(passed: Column, extracted: Column) -> Column:
    return F.when(passed > 0, "high").when(extracted > 0, "medium").otherwise("low")


def batch_stats(df: DataFrame, ok: str = "ok", ms: str = "ms") -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(ok)).alias("successful"), F.count_if(~F.col(ok)).alias("failed"), F.floor(F.sum(ms) / F.count("*") + 0.5).cast("long").alias("average_ms"))


def flatten(articles: DataFrame, listings: DataFrame) -> DataFrame:
    """(source_url, url, title): articles as they are, and the articles of listings (url, articles)."""
    return articles.select(F.col("url").alias("source_url"), "url", "title").union(listings.select("url", F.explode("articles").alias("a")).select("url", "a.url", "a.title"))


def debug_metrics(df: DataFrame, size: str = "bytes", ms: str = "ms", ok: str = "ok", cached: str = "cached") -> DataFrame:
    hits = F.count_if(F.col(cached))
    return df.agg(
        F.count("*").alias("requests"),
        F.sum(size).cast("long").alias("total_bytes"),
        F.coalesce(F.floor(F.sum(ms) / F.count("*") + 0.5).cast("long"), F.lit(0)).alias("avg_latency"),
        F.count_if(~F.col(ok)).alias("failures"),
        hits.alias("hits"),
        F.count_if(~F.col(cached)).alias("misses"),
        (hits / F.count("*")).alias("hit_rate"),
    )


def host_stats(df: DataFrame, host: str = "host", ok: str = "ok") -> DataFrame:
    return df.groupBy(host).agg(F.count("*").alias("requests"), F.count_if(~F.col(ok)).alias("failures"))


def cache_stats(df: DataFrame, most: int = 1000, hit: str = "hit", item: str = "item") -> DataFrame:
    """Hits, misses, the share of hits, and the number of items looked up, of a log of lookups; ``max_size`` is the cache's."""
    hits = F.count_if(F.col(hit))
    rate = F.when(F.count("*") > 0, hits / F.count("*")).otherwise(0.0)
    return df.agg(hits.alias("hits"), F.count_if(~F.col(hit)).alias("misses"), F.count_distinct(item).alias("items"), F.lit(most).cast("long").alias("max_size"), rate.alias("hit_rate"))


def robots_stats(rules: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """(host, rules, sitemaps) of parsed robots.txt files: ``rules`` of ``robots.rules``, ``sitemaps`` (host, sitemap)."""
    counted = rules.groupBy("host").agg(F.count_if(F.col("kind").isin("allow", "disallow")).alias("rules"))
    named = sitemaps.groupBy("host").agg(F.count("*").alias("sitemaps"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counted.join(named, "host", "full").select("host", zero("rules"), zero("sitemaps"))


def source_stats(sites: DataFrame, allowed: DataFrame, feeds: DataFrame, entries: DataFrame, now: Column, url: str = "url", hours: int = 48, most: int = 100) -> DataFrame:
    """(url, robots_compliant, has_feed, has_sitemap, detected_type, estimated_articles) of each site.

    ``allowed`` (url, allowed) is what robots.txt says of it, ``feeds`` (page) the pages
    with feeds, ``entries`` (sitemap, lastmod) the entries of its host's sitemaps, of
    which the recent ones, ``most`` at most, are the estimate.
    """
    host = urls.domain(F.col(url))
    fed = feeds.select(F.col("page").alias(url)).distinct().withColumn("_fed", F.lit(True))
    mapped = entries.groupBy(urls.domain(F.col("sitemap")).alias("_host")).agg(F.count_if(F.col("lastmod") >= now - F.make_interval(hours=F.lit(hours))).alias("_recent"))
    joined = sites.select(url).distinct().withColumn("_host", host).join(allowed.select(url, "allowed").dropDuplicates([url]), url, "left").join(fed, url, "left").join(mapped, "_host", "left")
    has_feed, has_map = F.col("_fed").isNotNull(), F.col("_recent").isNotNull()
    kind = F.when(has_feed, "rss").when(has_map, "sitemap").otherwise("html")
    return joined.select(url, F.coalesce("allowed", F.lit(True)).alias("robots_compliant"), has_feed.alias("has_feed"), has_map.alias("has_sitemap"), kind.alias("detected_type"), F.least(F.coalesce("_recent", F.lit(0)), F.lit(most)).cast("long").alias("estimated_articles"))


def mock_articles(seeds: DataFrame, titles: list[str], excerpts: list[str], authors: list[str], seed: str = "seed") -> DataFrame:
    """Deterministic articles of a column of seeds."""
    s = F.col(seed)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (s % len(values) + 1).cast("int"))
    n = 500 + s * 100 % 1000
    return seeds.select(s, pick(titles).alias("title"), pick(excerpts).alias("excerpt"), pick(authors).alias("author"), n.alias("word_count"), F.ceil(n / 200).cast("long").alias("reading_time"), F.lit("2024-01-15").alias("published"))
