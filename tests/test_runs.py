"""Batches, validation, known sources, listing settings, error codes, presets and site statistics."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pageloom.operators import articles, discover, robots, validate
from pageloom.plans import batch, errors, pipeline
from pageloom.streaming import state

TEXT = "The mill by the river has ground corn for three hundred years, and its wheel still turns. " * 6
PAGE = f"<html><head><title>The mill by the river</title></head><body><article><h1>The mill by the river</h1><p>{TEXT}</p><p>{TEXT}</p></article></body></html>"
LIST = '<body><div class="post"><h2><a href="/blog/mill-by-the-river">The mill by the river</a></h2></div></body>'
CORPUS = [("https://x.org/article/mill1", PAGE), ("https://x.org/", LIST), ("https://x.org/article/short", "<p>x</p>"), ("https://x.org/blog/mill-by-the-river", PAGE)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "url string, html string")


@pytest.fixture(scope="module")
def wanted(spark):
    return spark.createDataFrame([(u,) for u, _ in CORPUS[:3]] + [("https://x.org/article/mill1",), ("nothing",), ("https://y.org/",)], "url string")


def by_url(df):
    rows = df.collect()
    assert len(rows) == len({r.url for r in rows})
    return {r.url: r for r in rows}


def test_batch_modes(corpus, wanted):
    got = by_url(batch.scrape_urls(wanted, corpus))
    assert {u: (r.mode, r.success, r.error, len(r.articles)) for u, r in got.items()} == {
        "https://x.org/article/mill1": ("article", True, None, 1),
        "https://x.org/": ("listing", True, None, 1),
        "https://x.org/article/short": ("listing", True, None, 0),
        "nothing": ("smart", False, "INVALID_URL", 0),
        "https://y.org/": ("smart", False, "NO_CONTENT_FOUND", 0),
    }
    single = by_url(batch.extract_many(wanted, corpus))
    assert single["https://x.org/article/short"].error == "CONTENT_EXTRACTION_FAILED" and single["https://x.org/article/mill1"].success
    found = batch.batch_articles(batch.discover_sites(wanted, corpus)).collect()
    assert [(r.source_url, r.url) for r in found] == [("https://x.org/", "https://x.org/blog/mill-by-the-river")]
    assert batch.batch_summary(batch.scrape_urls(wanted, corpus)).first().asDict() == {"total": 5, "successful": 3, "failed": 2, "articles": 2}
    assert batch.scrape_urls(wanted.where("false"), corpus).count() == 0
    with pytest.raises(errors.ConfigError):
        batch.scrape_urls(wanted, corpus, "some")


def test_scrape_for_llm(corpus, wanted):
    got = by_url(batch.scrape_for_llm(wanted, corpus))
    assert got["https://x.org/article/mill1"].document.startswith("---\ntitle:") and got["https://x.org/article/mill1"].error is None
    assert got["nothing"].error == "INVALID_URL" and got["https://y.org/"].error == got["https://x.org/article/short"].error == "CONTENT_EXTRACTION_FAILED"


def test_quick_scrape_and_makers(spark, corpus):
    sites = spark.createDataFrame([("https://x.org/",)], "url string")
    as_of = F.lit("2024-02-01").cast("timestamp")
    rows = batch.quick_scrape(sites, corpus, as_of).collect()
    assert [r.url for r in rows] == ["https://x.org/blog/mill-by-the-river"] and rows[0].word_count > 100
    candidates = discover.listing_candidates(discover.listing_links(corpus.where("url = 'https://x.org/'")), as_of)
    rules = robots.rules(spark.createDataFrame([("x.org", "User-agent: *\nDisallow: /blog/")], "host string, body string"))
    assert batch.scraper(corpus)(candidates).first().word_count > 100
    assert batch.scraper(corpus, pipeline.ScrapeConfig(threshold=0.0), robots_rules=rules)(candidates).first().word_count is None
    assert batch.batch_processor(corpus, "listing")(sites).first().mode == "listing"


def test_run(spark):
    with batch.Run(spark, "a-run") as run:
        count = run.timed("count", lambda: spark.range(10).count())
        assert count() == count() == 10 and run.phases["count"] > 0 and 0 <= run.progress() <= 1
        run.abort()
        with pytest.raises(errors.Aborted):
            count()
    assert spark.range(3).count() == 3


def test_errors():
    e = errors.RateLimited("slow down", "https://x.org", host="x.org", retry_after=100)
    assert (e.code, e.url, e.host, e.retry_after) == ("RATE_LIMIT_EXCEEDED", "https://x.org", "x.org", 100)
    assert errors.is_scrape_error(e) and not errors.is_scrape_error(ValueError()) and not errors.is_abort(e)
    assert errors.is_abort(errors.Aborted()) and errors.is_abort(KeyboardInterrupt()) and len(errors.BY_CODE) == 11


def test_error_codes(spark):
    rows = [("no", None, None, True), ("http://x.org", 429, None, True), ("http://x.org", 404, None, True), ("http://x.org", None, "Timed out", None), ("http://x.org", 200, None, False), ("http://x.org", 200, None, None), ("http://x.org", 200, None, True), (None, 200, None, True), ("http://x.org", 500, None, True), ("http://x.org", None, "was aborted", None)]
    df = spark.createDataFrame(rows, "url string, status int, message string, found boolean")
    got = [r[0] for r in df.select(errors.error_code(F.col("url"), F.col("status"), F.col("message"), F.col("found"))).collect()]
    assert got == ["INVALID_URL", "RATE_LIMIT_EXCEEDED", "INVALID_URL", "REQUEST_TIMEOUT", "CONTENT_EXTRACTION_FAILED", "NO_CONTENT_FOUND", None, "INVALID_URL", "SCRAPER_ERROR", "REQUEST_ABORTED"]


def test_validate_urls(spark):
    schema = "url string, status int, content_type string, ms long, final_url string, headers array<string>, body string, error string"
    rows = [
        ("https://x.org/a", 200, "text/html", 10, None, [], "fine", None),
        ("https://x.org/private/a", 200, "text/html", 10, None, [], "fine", None),
        ("https://x.org/b", 401, "text/html", 10, None, [], "", None),
        ("https://x.org/c", 200, "text/html", 10, "https://x.org/d", ["X-Requires-Login"], "", None),
        ("https://x.org/e", 200, "text/html", 10, None, None, "members only", None),
        ("https://x.org/f", 200, None, 9000, None, [], None, None),
        ("https://x.org/g", None, None, None, None, None, None, "refused"),
        ("none", None, None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None),
    ]
    files = spark.createDataFrame([("x.org", "User-agent: *\nDisallow: /private")], "host string, body string")
    got = {r.url: r for r in validate.validate_urls(spark.createDataFrame(rows, schema), files).collect()}
    action = {u: r.suggested_action for u, r in got.items()}
    assert action == {"https://x.org/a": "scrape", "https://x.org/private/a": "skip", "https://x.org/b": "skip", "https://x.org/c": "requires-auth", "https://x.org/e": "use-proxy", "https://x.org/f": "use-proxy", "https://x.org/g": "skip", "none": "skip", None: "skip"}
    assert got["https://x.org/b"].requires_auth and got["https://x.org/c"].redirects == ["https://x.org/d"] and got["https://x.org/e"].has_paywall
    assert got["none"].warnings == ["not a valid URL"] and not got["https://x.org/private/a"].robots_allowed
    can = validate.can_scrape(spark.createDataFrame(rows, schema)).where("can_scrape").collect()
    assert sorted(r.url for r in can) == ["https://x.org/a", "https://x.org/private/a"]


def test_validate_feeds(spark):
    atom = '<feed><title>T</title><entry><title>a</title><link href="x"/></entry><entry><title>b</title></entry></feed>'
    rows = [("a", atom, "application/atom+xml", 200), ("b", "<rss><channel><title>T</title></channel></rss>", "text/xml", 200), ("c", "<rss><channel><item><title>x</title></item></channel></rss>", "text/xml", 200), ("d", "<html></html>", "text/html", 200), ("e", None, None, 404), ("f", "not xml at all", "text/xml", 200), ("g", None, None, None)]
    got = {r.feed: r for r in validate.validate_feeds(spark.createDataFrame(rows, "url string, xml string, content_type string, status int")).collect()}
    assert (got["a"].is_valid, got["a"].feed_title, got["a"].item_count) == (True, "T", 2)
    assert {k: r.error for k, r in got.items() if k != "a"} == {"b": "no items", "c": "no title", "d": "HTML, not a feed", "e": "status 404", "f": "no title", "g": "status unknown"}
    assert got["b"].feed_title == "T" and got["b"].item_count is None


def test_common_paths_come_after_links(spark):
    pages = spark.createDataFrame([("https://x.org/a", "<p>nothing</p> https://x.org/some/rss"), ("https://x.org/b", '<link rel="alternate" type="application/rss+xml" href="/own.xml">')], "url string, html string")
    held = spark.createDataFrame([("https://x.org/feed.xml", "<rss><channel><title>T</title><item><title>x</title></item></channel></rss>", "text/xml", 200)], "url string, xml string, content_type string, status int")
    common = validate.common_path_feeds(pages, held)
    got = {(r.page, r.feed, r.confidence) for r in discover.discover_feeds(pages, common=common).collect()}
    assert got == {("https://x.org/a", "https://x.org/feed.xml", 0.7), ("https://x.org/b", "https://x.org/own.xml", 0.9)}
    rules = robots.rules(spark.createDataFrame([("x.org", "User-agent: *\nDisallow: /feed")], "host string, body string"))
    assert validate.common_path_feeds(pages, held, rules).count() == 0


def test_listing_settings(spark):
    html = '<header><h2><a href="/blog/in-the-head">Not an article at all</a></h2></header><div class="card"><a href="/blog/card-one">The first of the cards</a></div><aside class="mine"><a href="/x/special">Some special thing here</a></aside><ul><li><a href="/blog/privacy/terms">Terms of our service</a></li></ul>'
    page = spark.createDataFrame([("https://x.org/", html)], "url string, html string")
    links = lambda how: [r.url for r in discover.listing_links(page, how=how).collect()]
    assert links(discover.Listing()) == ["https://x.org/blog/in-the-head"]
    assert links(discover.RENDERED) == ["https://x.org/blog/card-one"]
    mine = discover.RENDERED.merged(links=(".mine a[href]",), included="/x/", excluded="card")
    assert links(mine) == ["https://x.org/x/special"]
    assert links(discover.RENDERED.merged(domains=("y.org",))) == [] and discover.Listing().merged(most=5).most == 5


def test_known_type(spark):
    bodies = spark.createDataFrame([("https://x.org/f", "<rss><channel><item><title>t</title><link>https://x.org/1</link><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate></item></channel></rss>"), ("https://x.org/s", "<urlset><url><loc>https://x.org/2</loc></url></urlset>"), ("https://x.org/h", LIST)], "url string, body string")
    sources = spark.createDataFrame([("https://x.org/f", "rss"), ("https://x.org/s", "sitemap"), ("https://x.org/h", "html"), ("https://x.org/s", "rss")], "url string, source_type string")
    found = discover.known_type(sources, bodies, F.lit("2024-02-01").cast("timestamp")).collect()
    assert sorted((r.source, r.url) for r in found) == [("html", "https://x.org/blog/mill-by-the-river"), ("rss", "https://x.org/1"), ("sitemap", "https://x.org/2")]


def test_cache_by_bytes(spark):
    rows = [(1, "2024-01-01 00:00:01", "k", "a", 60), (2, "2024-01-01 00:00:02", "k", "b", 60), (3, "2024-01-01 00:00:03", "k", "a", 60), (4, "2024-01-01 00:00:04", "k", "a", 60), (5, "2024-01-01 00:00:05", "k", "c", 1000), (6, "2024-01-01 00:00:06", "k", "c", 1000), (7, "2024-01-01 00:00:07", "k", "a", 60)]
    log = spark.createDataFrame(rows, "event_id long, ts string, k string, item string, bytes long").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [r.value for r in state.replay(log, lambda: state.TtlCache(10_000, 10, 100), "k").orderBy("event_id").collect()]
    assert got == [False, False, False, True, False, False, True]
    stats = articles.cache_stats(log.withColumn("hit", F.col("event_id") > 5)).first()
    assert (stats.hits, stats.misses, stats["items"], stats.hit_rate) == (2, 5, 3, 2 / 7)


def test_host_times_is_the_fold(spark):
    rows = [(i, f"2024-01-01 00:00:{(i * 7) % 50:02d}.{i:03d}", f"h{i % 3}") for i in range(60)]
    log = spark.createDataFrame(rows, "event_id long, ts string, host string").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {tuple(r) for r in state.replay(log, lambda: state.HostSchedule(0.5), "host").collect()}
    assert {tuple(r) for r in state.host_times(log, 0.5).collect()} == want


def test_priority_times(spark):
    rows = [(1, 0, 0), (2, 0, 5), (3, 100, 9), (4, 9000, 0)]
    log = spark.createDataFrame(rows, "event_id long, at long, priority int").select("event_id", "priority", F.timestamp_millis("at").alias("ts"), F.lit("h").alias("host"), F.lit(10).alias("ms"))
    got = {r.event_id: r.value for r in state.priority_times(log, "conservative").collect()}
    assert got == {2: 0, 3: 1000, 1: 2000, 4: 9000}
    slow = {r.event_id: r.value for r in state.priority_times(log.withColumn("ms", F.lit(5000)), "conservative").collect()}
    assert slow == {2: 0, 3: 1000, 1: 5000, 4: 9000}  # two at once
    assert state.breaker("scraping_test")().threshold == 3 and state.LIMITERS["aggressive"].at_once == 5


def test_site_stats(spark):
    sites = spark.createDataFrame([("https://a.org",), ("https://b.org",), ("https://c.org",)], "url string")
    allowed = spark.createDataFrame([("https://a.org", False)], "url string, allowed boolean")
    feeds = spark.createDataFrame([("https://a.org",)], "page string")
    entries = spark.createDataFrame([("https://b.org/s.xml", "2024-01-31"), ("https://b.org/s.xml", "2023-01-31")], "sitemap string, day string").withColumn("lastmod", F.col("day").cast("timestamp"))
    got = {r.url: tuple(r)[1:] for r in articles.source_stats(sites, allowed, feeds, entries, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got == {"https://a.org": (False, True, False, "rss", 0), "https://b.org": (True, False, True, "sitemap", 1), "https://c.org": (True, False, False, "html", 0)}


def test_crawl_ends_early(spark):
    page = lambda n: f'<a class="next" href="p{n}">next</a>'
    corpus = spark.createDataFrame([("p1", page(2)), ("p2", page(3)), ("p3", "<p>end</p>"), ("p9", page(1))], "url string, html string")
    start = spark.createDataFrame([("p1",)], "url string")
    assert sorted(r.url for r in discover.crawl(start, corpus, 50).collect()) == ["p1", "p2", "p3"]


@pytest.mark.parametrize("kind", ["folder", "memory"])
def test_stores(spark, tmp_path, kind):
    from pageloom.sources.store import FolderStore, MemoryStore, wrap

    store = FolderStore(spark, f"{tmp_path}/store", seconds=100) if kind == "folder" else MemoryStore(spark, seconds=100)
    at = lambda s: F.timestamp_seconds(F.lit(s))
    computed = []

    def compute(due):
        computed.append(sorted(r.url for r in due.collect()))
        return due.withColumn("v", F.length("url"))

    urls = lambda *names: spark.createDataFrame([(n,) for n in names], "url string")
    run = lambda s, *names: sorted(tuple(r) for r in wrap(store, compute, at(s))(urls(*names)).select("url", "v").collect())
    assert store.size(at(0)) == 0 and store.has(urls("a"), at(0)).first().held is False
    assert run(0, "a", "bb") == [("a", 1), ("bb", 2)]
    assert run(50, "a", "ccc") == [("a", 1), ("ccc", 3)]
    assert computed == [["a", "bb"], ["ccc"]] and store.size(at(50)) == 3
    assert {r.url: r.held for r in store.has(urls("a", "x"), at(60)).collect()} == {"a": True, "x": False}
    store.delete(urls("a"), at(60))
    assert sorted(r.url for r in store.keys(at(60)).collect()) == ["bb", "ccc"]
    assert sorted(r.url for r in store.keys(at(120)).collect()) == ["ccc"]
    assert run(120, "bb", "ccc") == [("bb", 2), ("ccc", 3)] and computed[-1] == ["bb"]
    store.clear()
    assert store.size(at(120)) == 0


def test_open_hosts(spark, corpus):
    hosts = spark.createDataFrame([("x.org",)], "host string")
    assert pipeline.extract_articles(corpus).count() == 2 and pipeline.extract_articles(corpus, open_hosts=hosts).count() == 0


def test_recent_stream(spark, tmp_path):
    rows = [("a", "2024-01-10"), ("a", "2024-01-10"), ("b", "2024-01-11"), ("c", None)]
    spark.createDataFrame(rows, "url string, day string").coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("url string, day string").json(f"{tmp_path}/in").withColumn("ts", F.col("day").cast("timestamp"))
    query = articles.recent_stream(stream, "ts", "url").writeStream.format("memory").queryName("recent").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.url for r in spark.table("recent").collect()) == ["a", "b"]
