"""Queries over batches, validation, known sources and site statistics; inputs are made from ``pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.catalog.base import query, read
from pageloom.catalog.pages import _FOUND, _HEAD
from pageloom.catalog.urls import _PATH
from pageloom.operators import articles, discover, robots, validate
from pageloom.plans import batch

_NOW = "2024-02-01"
_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
#: A page's kind, by its id: the whole table is dealt to all of them.
_KINDS = 5


def _now() -> Column:
    return F.lit(_NOW).cast("timestamp")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as answers to requests: some fail, need a login, are slow, limited, moved or behind a paywall."""
    k, n = F.col("page_id"), F.col("page_id") % _KINDS
    body = F.when(n == 3, F.concat(F.col("html"), F.lit("Subscribe now to continue"))).otherwise(F.col("html"))
    return read(spark, sf_dir, "pages").select(
        "page_id",
        F.when(k % 17 == 0, F.concat(F.lit("no "), F.col("url"))).otherwise(F.col("url")).alias("url"),
        F.element_at(F.array(*map(F.lit, (200, 403, 503, 200, 200))), (n + 1).cast("int")).alias("status"),
        F.when(k % 4 == 0, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"),
        F.when(k % 3 == 0, 9000).otherwise(100).cast("long").alias("ms"),
        F.when(n == 4, F.concat("url", F.lit("/moved"))).otherwise(F.col("url")).alias("final_url"),
        F.when(k % 19 == 0, F.array(F.lit("WWW-Authenticate"))).otherwise(F.array(F.lit("Server"))).alias("headers"),
        body.alias("body"),
        F.when(k % 23 == 0, "refused").alias("error"),
    )


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, body): the same robots.txt for every site."""
    hosts = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")).distinct()
    return hosts.withColumn("body", F.lit("User-agent: *\nDisallow: /de/\nDisallow: /fr/1\nSitemap: https://x.org/a.xml\nSitemap: https://x.org/b.xml"))


_VALID = (
    "SELECT *, CASE WHEN NOT valid OR NOT reachable THEN 'skip' WHEN auth THEN 'requires-auth' WHEN NOT allowed THEN 'skip' WHEN paywall OR ms > 5000 THEN 'use-proxy' ELSE 'scrape' END AS action FROM"
    " (SELECT *, valid AND NOT failed AND status = 200 AS reachable, valid AND NOT failed AND (status = 403 OR page_id % 19 = 0) AS auth, valid AND NOT failed AND status = 200 AND page_id % 4 <> 0 AND (n = 3) AS paywall FROM"
    " (SELECT page_id, page_id % 5 AS n, url AS address, CASE WHEN page_id % 17 = 0 THEN 'no ' || url ELSE url END AS url, page_id % 17 <> 0 AS valid, page_id % 23 = 0 AS failed, [200, 403, 503, 200, 200][page_id % 5 + 1] AS status,"
    f" CASE WHEN page_id % 3 = 0 THEN 9000 ELSE 100 END AS ms, page_id % 17 = 0 OR NOT (starts_with({_PATH}, '/de/') OR starts_with({_PATH}, '/fr/1')) AS allowed FROM pages))"
)


@query(
    f"SELECT page_id, valid AS is_valid, reachable AS is_reachable, allowed AS robots_allowed, auth AS requires_auth, paywall AS has_paywall, action AS suggested_action, CASE WHEN valid AND n = 4 THEN [address || '/moved'] END AS redirects,"
    " list_filter([CASE WHEN NOT valid THEN 'not a valid URL' END, CASE WHEN valid AND NOT allowed THEN 'robots.txt disallows the path' END, CASE WHEN valid AND NOT failed AND status = 403 THEN 'a login is needed' END,"
    f" CASE WHEN paywall THEN 'there may be a paywall' END, CASE WHEN valid AND failed THEN 'the request failed' END, CASE WHEN action = 'use-proxy' AND NOT paywall THEN 'limited or slow' END], lambda w: w IS NOT NULL) AS warnings FROM ({_VALID})"
)
def validate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("is_valid", "is_reachable", "robots_allowed", "requires_auth", "has_paywall", "suggested_action", "redirects", "warnings")
    return validate.validate_urls(_answers(spark, sf_dir), _robots(spark, sf_dir)).select("page_id", *names)


@query(f"SELECT action = 'scrape' AS can_scrape, count(*) AS n FROM ({_VALID}) GROUP BY 1")
def can_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.can_scrape(_answers(spark, sf_dir), _robots(spark, sf_dir)).groupBy("can_scrape").agg(F.count("*").alias("n"))


_SITES = f"(SELECT {_ORIGIN} AS site, min(page_id) AS k, count(*) AS n FROM pages GROUP BY 1)"


def _site_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each site answers at /rss.xml: a feed, one without title or items, a page, or an error, by its first page."""
    site = discover.origin(F.col("url"))
    item = F.concat(F.lit("<item><title>p</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link></item>"))
    sites = read(spark, sf_dir, "pages").groupBy(site.alias("site")).agg(F.min("page_id").alias("k"), F.array_join(F.collect_list(item), "").alias("items"))
    n = F.col("k") % _KINDS
    xml = F.concat(F.lit("<rss><channel>"), F.when(n != 1, "<title>Feed</title>").otherwise(""), F.when(n != 2, F.col("items")).otherwise(""), F.lit("</channel></rss>"))
    kind = F.when(n == 3, "text/html").otherwise("application/rss+xml")
    return sites.select("site", F.concat("site", F.lit("/rss.xml")).alias("url"), xml.alias("xml"), kind.alias("content_type"), F.when(n == 4, 404).otherwise(200).alias("status"))


@query(
    "SELECT site || '/rss.xml' AS feed, k % 5 = 0 AS is_valid, [NULL, 'no title', 'no items', 'HTML, not a feed', 'status 404'][k % 5 + 1] AS error, CASE WHEN k % 5 IN (0, 2) THEN 'Feed' END AS feed_title, CASE WHEN k % 5 = 0 THEN n END AS item_count,"
    f" CASE WHEN k % 5 = 3 THEN 'text/html' ELSE 'application/rss+xml' END AS content_type FROM {_SITES}"
)
def validate_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate_feeds(_site_feeds(spark, sf_dir))


@query(f"SELECT url AS page, site || '/rss.xml' AS feed, 'rss' AS type, CAST(0.7 AS DOUBLE) AS confidence FROM (SELECT url, {_ORIGIN} AS site FROM pages) JOIN {_SITES} USING (site) WHERE k % 5 = 0")
def common_path_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds at the usual paths of every page's site, of which only /rss.xml is held."""
    rules = robots.rules(_robots(spark, sf_dir))
    return validate.common_path_feeds(read(spark, sf_dir, "pages"), _site_feeds(spark, sf_dir), rules)


@query(f"SELECT url AS page, site || '/rss.xml' AS feed, 'rss' AS type, CAST(0.7 AS DOUBLE) AS confidence FROM (SELECT url, {_ORIGIN} AS site FROM pages) JOIN {_SITES} USING (site) WHERE k % 5 = 0")
def discover_common_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages link to no feed, so the tier of common paths is the one that finds any."""
    pages = read(spark, sf_dir, "pages")
    return discover.discover_feeds(pages, common=validate.common_path_feeds(pages, _site_feeds(spark, sf_dir)))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, source_type, body): each site as a feed, a sitemap and a listing page of its pages."""
    site, link = discover.origin(F.col("url")), F.replace("url", F.lit("&"), F.lit("&amp;"))
    item = F.concat(F.lit("<item><title>Page "), F.col("page_id"), F.lit("</title><link>"), link, F.lit("</link><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate></item>"))
    entry = F.concat(F.lit("<url><loc>"), link, F.lit("</loc></url>"))
    card = F.concat(F.lit('<div class="card"><a href="/blog/'), F.col("page_id"), F.lit('">The page with number '), F.col("page_id"), F.lit("</a></div>"))
    join = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "")
    made = read(spark, sf_dir, "pages").groupBy(site.alias("site")).agg(join(item).alias("rss"), join(entry).alias("sitemap"), join(card).alias("html"))
    wrap = {"rss": ("<rss><channel>", "</channel></rss>"), "sitemap": ("<urlset>", "</urlset>"), "html": ("<body><nav><ul><li><a href='/blog/all'>All of the articles</a></li></ul></nav>", "</body>")}
    kinds = [F.struct(F.concat("site", F.lit(f"/{k}")).alias("url"), F.lit(k).alias("source_type"), F.concat(F.lit(a), F.col(k), F.lit(b)).alias("body")) for k, (a, b) in wrap.items()]
    return made.select(F.explode(F.array(*kinds)).alias("x")).select("x.*")


@query(
    "SELECT url, source, confidence FROM (SELECT url, 'rss' AS source, CAST(0.9 AS DOUBLE) AS confidence FROM pages UNION ALL SELECT url, 'sitemap', CAST(0.6 AS DOUBLE) FROM pages"
    f" UNION ALL SELECT url, 'html', CAST(0.8 AS DOUBLE) FROM (SELECT {_ORIGIN} || '/blog/' || page_id AS url, row_number() OVER (PARTITION BY {_ORIGIN} ORDER BY CAST(page_id AS VARCHAR)) AS n FROM pages))"
)
def known_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site as each of the three types; listing pages are read as a browser renders them, without a bound."""
    bodies = _bodies(spark, sf_dir)
    how = discover.RENDERED.merged(most=1 << 30)
    found = discover.known_type(bodies.select("url", "source_type"), bodies.select("url", "body"), _now(), how, None)
    return found.select("url", "source", "confidence")


@query(
    f"WITH s AS (SELECT site, k % 3 AS kind FROM {_SITES}), c AS (SELECT url, {_HOST} AS host, 0 AS k FROM pages JOIN s ON s.site = {_ORIGIN} WHERE kind = 0 UNION ALL SELECT url, {_HOST}, 1 FROM pages JOIN s ON s.site = {_ORIGIN} WHERE kind <> 2"
    f" UNION ALL SELECT {_ORIGIN} || '/blog/' || page_id, {_HOST}, 2 FROM pages) SELECT url, ['rss', 'sitemap', 'html'][k + 1] AS source FROM (SELECT *, min(k) OVER (PARTITION BY host) AS best FROM c) WHERE k = best"
)
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with feeds, with sitemaps only, or with neither, by their first page; all have a listing page."""
    kinds = read(spark, sf_dir, "pages").groupBy(discover.origin(F.col("url")).alias("site")).agg((F.min("page_id") % 3).alias("kind"))
    bodies = _bodies(spark, sf_dir).withColumn("site", discover.origin(F.col("url"))).join(kinds, "site")
    of = lambda kind, test: bodies.where((F.col("source_type") == kind) & test)
    rss = discover.feed_candidates(discover.feed_items(of("rss", F.col("kind") == 0), _now(), body="body"))
    sitemap = discover.sitemap_candidates(discover.sitemap_entries(of("sitemap", F.col("kind") != 2), body="body"), _now())
    listing = discover.listing_candidates(discover.listing_links(of("html", F.lit(True)), html="body", how=discover.RENDERED.merged(most=1 << 30)), _now())
    return discover.cascade(rss, sitemap, listing).select("url", "source")


_WANTED = f"(SELECT DISTINCT ON (url) url, html, {_FOUND} AS found, {_HEAD} AS title FROM pages ORDER BY url, page_id)"


def _wanted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All pages' URLs and some that are none or lead nowhere; and the pages, the first of each URL."""
    pages = read(spark, sf_dir, "pages").groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    more = spark.createDataFrame([("no url",), ("https://nowhere.example/a",)], "url string")
    return pages.select("url").union(more), pages


@query(
    f"SELECT url, 'article' AS mode, found AS success, CASE WHEN NOT found THEN 'CONTENT_EXTRACTION_FAILED' END AS error, CASE WHEN found THEN 1 ELSE 0 END AS n_articles, CASE WHEN found THEN title END AS first_title FROM {_WANTED}"
    " UNION ALL SELECT 'no url', 'article', false, 'INVALID_URL', 0, NULL UNION ALL SELECT 'https://nowhere.example/a', 'article', false, 'NO_CONTENT_FOUND', 0, NULL"
)
def extract_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, pages = _wanted(spark, sf_dir)
    return batch.extract_many(wanted, pages).select("url", "mode", "success", "error", F.size("articles").alias("n_articles"), F.get("articles", F.lit(0))["title"].alias("first_title"))


@query(f"SELECT count(*) + 2 AS total, count(*) FILTER (WHERE found) AS successful, count(*) FILTER (WHERE NOT found) + 2 AS failed, count(*) FILTER (WHERE found) AS articles FROM {_WANTED}")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.batch_summary(batch.extract_many(*_wanted(spark, sf_dir)))


@query(
    f"SELECT {_ORIGIN} || '/html' AS source_url, {_ORIGIN} || '/blog/' || page_id AS url, 'The page with number ' || page_id AS title FROM (SELECT *, row_number() OVER (PARTITION BY {_ORIGIN} ORDER BY '<div class=\"card\"><a href=\"/blog/' || page_id || '\">') AS n FROM pages) WHERE n <= 1000000"
)
def discover_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles that every site's listing page links to."""
    pages = _bodies(spark, sf_dir).where("source_type = 'html'").select("url", F.col("body").alias("html"))
    return batch.batch_articles(batch.discover_sites(pages.select("url"), pages, how=discover.RENDERED.merged(most=1 << 30)))


@query(None)
def scrape_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages in smart mode."""
    return batch.scrape_urls(*_wanted(spark, sf_dir))


@query(
    f"SELECT url, CASE WHEN found THEN title END AS title, found AS has_document, CASE WHEN NOT found THEN 'CONTENT_EXTRACTION_FAILED' END AS error FROM {_WANTED} UNION ALL SELECT 'no url', NULL, false, 'INVALID_URL' UNION ALL SELECT 'https://nowhere.example/a', NULL, false, 'CONTENT_EXTRACTION_FAILED'"
)
def scrape_for_llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.scrape_for_llm(*_wanted(spark, sf_dir)).select("url", "title", F.col("document").isNotNull().alias("has_document"), "error")


@query(None)
def quick_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages whose links are the corpus's own pages."""
    site = discover.origin(F.col("url"))
    pages = read(spark, sf_dir, "pages").select(F.concat(site, F.lit("/en-us/blog/"), "page_id").alias("url"), "html")
    card = F.concat(F.lit('<div class="post"><h2><a href="'), F.col("url"), F.lit('">The page of this address</a></h2></div>'))
    lists = pages.groupBy(F.concat(site, F.lit("/")).alias("url")).agg(F.array_join(F.array_sort(F.collect_list(card)), "").alias("html"))
    return batch.quick_scrape(lists, lists.union(pages), _now()).select("url", "title", "confidence", "word_count")


@query(f"SELECT {_HOST} AS host, CAST(2 AS BIGINT) AS rules, CAST(2 AS BIGINT) AS sitemaps FROM pages GROUP BY 1")
def robots_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _robots(spark, sf_dir)
    return articles.robots_stats(robots.rules(files), robots.sitemaps(files))


@query(f"SELECT {_HOST} AS host, unnest(['https://x.org/a.xml', 'https://x.org/b.xml']) AS sitemap FROM pages GROUP BY 1")
def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.sitemaps(_robots(spark, sf_dir))


@query(
    f"WITH s AS (SELECT {_ORIGIN} AS site, {_HOST} AS host, page_id, make_timestamp(2024, 1, CAST(page_id % 31 + 1 AS BIGINT), 0, 0, 0.0) AS lastmod FROM pages), k AS (SELECT site, any_value(host) AS host, min(page_id) AS k FROM s GROUP BY 1),"
    " e AS (SELECT host, count(*) FILTER (WHERE lastmod >= TIMESTAMP '2024-01-30 00:00:00') AS recent, bool_or(page_id % 2 = 0) AS mapped FROM s WHERE page_id % 2 = 0 GROUP BY 1)"
    " SELECT site AS url, k % 7 <> 0 AS robots_compliant, k % 5 = 0 AS has_feed, mapped IS NOT NULL AS has_sitemap, CASE WHEN k % 5 = 0 THEN 'rss' WHEN mapped THEN 'sitemap' ELSE 'html' END AS detected_type, least(coalesce(recent, 0), 100) AS estimated_articles FROM k LEFT JOIN e USING (host)"
)
def site_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of which some have feeds and some sitemaps; a sitemap lists the pages of even numbers."""
    pages = read(spark, sf_dir, "pages").withColumn("site", discover.origin(F.col("url")))
    first = pages.groupBy("site").agg(F.min("page_id").alias("k")).withColumnRenamed("site", "url")
    day = F.make_timestamp(F.lit(2024), F.lit(1), (F.col("page_id") % 31 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    entries = pages.where("page_id % 2 = 0").select(F.concat("site", F.lit("/sitemap.xml")).alias("sitemap"), day.alias("lastmod"))
    feeds = first.where("k % 5 = 0").select(F.col("url").alias("page"))
    return articles.source_stats(first, first.select("url", (F.col("k") % 7 != 0).alias("allowed")), feeds, entries, _now())
