"""Whether URLs and feeds can be scraped, from what an external fetcher met there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import text, urls
from pageloom.operators import discover, robots

#: What tells that a login is needed.
AUTH_STATUS = (401, 403)
AUTH_HEADERS = ("www-authenticate", "x-requires-login")
#: Milliseconds from which an answer is slow.
SLOW_MS = 5000


def probes(spark, path: str) -> DataFrame:
    """JSON lines of a fetcher: url, status, content_type, ms, final_url, headers (names), body and error."""
    return spark.read.schema("url string, status int, content_type string, ms long, final_url string, headers array<string>, body string, error string").json(path)


def validate_urls(probed: DataFrame, robots_files: DataFrame | None = None, url: str = "url") -> DataFrame:
    """``probed`` (url, status, content_type, ms, final_url, headers, body, error) with the verdict on each:
    is_valid, is_reachable, robots_allowed, requires_auth, has_paywall, suggested_action, redirects and warnings.

    ``robots_files`` (host, body) are joined by host: the parser that merges groups, and prefixes of paths.
    An address that isn't valid is looked at no further.
    """
    valid = urls.is_valid(F.col(url))
    allowed: Column = F.lit(True)
    found = probed
    if robots_files is not None:
        paths = robots.disallowed_paths(robots_files).select(F.col("host").alias("_host"), F.col("disallowed").alias("_disallowed"))
        found = probed.withColumn("_host", urls.domain(F.col(url))).join(paths, "_host", "left").drop("_host")
        allowed = robots.path_allowed(urls.path(F.col(url)), F.col("_disallowed"))
    no = F.lit(False)
    ok = lambda test: valid & F.coalesce(test, no)
    reachable = ok(F.col("error").isNull() & F.col("status").between(200, 299))
    denied = ok(F.col("error").isNull() & F.col("status").isin(*AUTH_STATUS))
    auth = denied | ok(F.col("error").isNull() & F.exists("headers", lambda h: F.lower(h).isin(*AUTH_HEADERS)))
    paywall = reachable & F.coalesce(F.col("content_type").contains("text/html"), no) & robots.has_paywall(F.col("body"))
    action = F.when(~valid, "skip").otherwise(robots.suggested_action(reachable, auth, allowed, paywall, F.col("status"), F.col("ms")))
    slow = (action == "use-proxy") & ~paywall
    warned = (
        (~valid, "not a valid URL"),
        (valid & ~allowed, "robots.txt disallows the path"),
        (denied, "a login is needed"),
        (paywall, "there may be a paywall"),
        (valid & F.col("error").isNotNull(), "the request failed"),
        (slow, "limited or slow"),
    )
    moved = valid & F.col("final_url").isNotNull() & (F.col("final_url") != F.col(url))
    return found.select(
        *probed.columns,
        valid.alias("is_valid"),
        reachable.alias("is_reachable"),
        (~valid | allowed).alias("robots_allowed"),
        auth.alias("requires_auth"),
        paywall.alias("has_paywall"),
        action.alias("suggested_action"),
        F.when(moved, F.array("final_url")).alias("redirects"),
        F.array_compact(F.array(*(F.when(test, F.lit(message)) for test, message in warned))).alias("warnings"),
    )


def can_scrape(probed: DataFrame, robots_files: DataFrame | None = None, url: str = "url") -> DataFrame:
    """(url, can_scrape)."""
    return validate_urls(probed, robots_files, url).select(url, (F.col("suggested_action") == "scrape").alias("can_scrape"))


def validate_feeds(fetched: DataFrame, url: str = "url", body: str = "xml", content_type: str = "content_type", status: str = "status") -> DataFrame:
    """(feed, is_valid, error, feed_title, item_count, content_type) of what was fetched from feed addresses."""
    kind = F.coalesce(F.col(content_type), F.lit(""))
    xml_like = kind.rlike("application/(rss\\+xml|atom\\+xml|xml)|text/xml")
    rss = F.from_xml(F.col(body), discover._RSS, discover._XML)["channel"]
    atom = F.from_xml(F.col(body), discover._ATOM, discover._XML)
    is_atom = F.coalesce(F.col(body).rlike("<feed\\b"), F.lit(False))
    title = F.nullif(F.trim(F.when(is_atom, atom["title"]).otherwise(rss["title"])), F.lit(""))
    items = F.coalesce(F.when(is_atom, F.size(atom["entry"])).otherwise(F.size(rss["item"])), F.lit(0))
    read = fetched.select(F.col(url).alias("feed"), F.col(content_type).alias("content_type"), F.col(status).alias("_status"), kind.contains("text/html").alias("_html"), xml_like.alias("_xml"), title.alias("_title"), F.greatest(items, F.lit(0)).cast("long").alias("_items"))
    error = (
        F.when(~F.coalesce(F.col("_status").between(200, 299), F.lit(False)), F.concat(F.lit("status "), F.coalesce(F.col("_status").cast("string"), F.lit("unknown"))))
        .when(F.col("_html") & ~F.col("_xml"), "HTML, not a feed")
        .when(F.col("_title").isNull(), "no title")
        .when(F.col("_items") == 0, "no items")
    )
    known = F.col("error").isNull()
    return read.withColumn("error", error).select("feed", known.alias("is_valid"), "error", F.when(known | (F.col("error") == "no items"), F.col("_title")).alias("feed_title"), F.when(known, F.col("_items")).alias("item_count"), "content_type")


def common_path_feeds(sites: DataFrame, fetched: DataFrame, robots_rules: DataFrame | None = None, url: str = "url") -> DataFrame:
    """(page, feed, type, confidence 0.7): feeds at the usual paths of a page's site, where ``fetched`` (url, xml,
    content_type, status) holds a valid one, and robots.txt allows to look if rules are given."""
    asked = sites.select(F.col(url).alias("page"), F.explode(discover.feed_addresses(F.col(url))).alias("feed"))
    if robots_rules is not None:
        asked = robots.check(asked, robots_rules, "feed").where("allowed").drop("allowed", "crawl_delay")
    held = fetched.join(asked.select(F.col("feed").alias("url")).distinct(), "url", "left_semi")
    good = validate_feeds(held).where("is_valid").select("feed")
    return asked.join(good, "feed").select("page", "feed", text.feed_type(urls.path(F.col("feed"))).alias("type"), F.lit(0.7).alias("confidence"))
