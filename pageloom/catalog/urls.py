"""URL queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.catalog.base import column, query, read
from pageloom.functions import urls

_R = urls.URL
_HOST = f"nullif(lower(regexp_extract(url, '{_R}', 2)), '')"
_PATH = f"CASE WHEN regexp_extract(url, '{_R}', 3) = '' THEN '/' ELSE regexp_extract(url, '{_R}', 3) END"
_FULL = f"({_PATH}) || CASE WHEN length(regexp_extract(url, '{_R}', 4)) > 1 THEN regexp_extract(url, '{_R}', 4) ELSE '' END"
#: A page's URL and ones made from it that have other shapes.
SHAPES = ("/", "/blog/", "/page/2", "/category/tech", "/2024/03/05/a-story", "/news/what-happened-to-the-market", "/p/x1", "/tag/a", "/about", "/EN-us/help", "/de-at/x", "/ja", "/press/2024", "/a_b-c.php")
_SHAPED = "(SELECT page_id, unnest([url, " + ", ".join(f"regexp_replace(url, '(//[^/]*).*$', '\\1{s}')" for s in SHAPES) + "]) AS url FROM pages)"


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", F.explode(F.array(url, *(F.regexp_replace(url, r"(//[^/]*).*$", f"$1{s}") for s in SHAPES))).alias("url"))


def _shaped(name: str, value, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shaped(spark, sf_dir).select("page_id", "url", value(F.col("url")).alias("value"))

    run.__name__ = name
    query(f"SELECT page_id, url, {sql} AS value FROM {_SHAPED}")(run)


def _any(patterns: str) -> str:
    return f"regexp_matches({_FULL}, '{patterns}')"


_LAST = f"list_filter(string_split({_FULL}, '/'), lambda s: s <> '')"
_shaped("is_valid_url", urls.is_valid, f"coalesce(regexp_matches(url, '{urls.WEB}'), false)")
_shaped("url_domain", urls.domain, _HOST)
_shaped(
    "url_type",
    urls.url_type,
    f"CASE WHEN {_any(urls.LISTING)} THEN 'listing' WHEN {_any(urls.ARTICLE)} OR (len({_LAST}) >= 2 AND length({_LAST}[-1]) > 15 AND contains({_LAST}[-1], '-') AND NOT regexp_matches({_LAST}[-1], '^\\d+$')) THEN 'article' ELSE 'unknown' END",
)
_shaped("likely_article_url", urls.likely_article, f"regexp_matches(lower(url), '{urls.LIKELY}')")
_shaped("link_filters", lambda u: urls.passes_filters(u, domains=("example.net", "m.example.com")), f"NOT regexp_matches(url, '{urls.EXCLUDED}') AND regexp_matches(url, '{urls.INCLUDED}') AND coalesce({_HOST} IN ('example.net', 'm.example.com') OR {_HOST} LIKE '%.example.net' OR {_HOST} LIKE '%.m.example.com', false)")
_DENY = ", ".join(f"'{p}'" for p in urls.DENIED)
_shaped("deny_url", urls.denied, f"len(list_filter([{_DENY}], lambda p: p = ({_PATH}) OR (ends_with(p, '/*') AND starts_with({_PATH}, p[:-3])))) > 0")
_shaped("locale_filter", lambda u: urls.foreign_locale(urls.path(u)), f"regexp_matches({_PATH}, '{urls.LOCALE}') AND NOT regexp_matches({_PATH}, '{urls.US_ENGLISH}')")
_shaped("path_match", lambda u: urls.matches(urls.path(u), "/news/*"), f"lower({_PATH}) = '/news' OR starts_with(lower({_PATH}), '/news/')")
_shaped(
    "infer_allow_paths",
    urls.inferred_allow,
    "CASE WHEN lower(" + _PATH + ") = '/' THEN NULL " + " ".join(f"WHEN starts_with(lower({_PATH}), '{s}') THEN '{s}/*'" for s in urls.SECTIONS) + f" WHEN length({_PATH}) > 3 THEN regexp_replace(lower({_PATH}), '/$', '') || '/*' END",
)
_shaped("ssrf_guard", urls.private_host, f"NOT regexp_matches(url, '{urls.WEB}') OR regexp_matches(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '{urls.PRIVATE_HOST}')")
_TITLE = f"array_to_string(list_transform(string_split(regexp_replace(regexp_replace(coalesce(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')[-1], {_HOST}), '[-_]', ' ', 'g'), '(?i)\\.(html?|php|asp|jsp)$', ''), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_shaped("title_from_url", urls.title, _TITLE)
_shaped("cache_key", urls.cache_key, "sha256(regexp_replace(lower(url), '/$', '') || ':' || md5('{}')[:8])[:24]")
_QUERY = f"list_filter(string_split(regexp_extract(url, '{_R}', 4)[2:], '&'), lambda p: p <> '' AND string_split(p, '=')[1] NOT IN {urls.TRACKING})"
_shaped(
    "normalize_url",
    urls.normalize,
    f"lower(regexp_extract(url, '{_R}', 1)) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || CASE WHEN length({_PATH}) > 1 AND ends_with({_PATH}, '/') THEN ({_PATH})[:-2] ELSE {_PATH} END"
    f" || CASE WHEN len({_QUERY}) > 0 THEN '?' || array_to_string(list_sort({_QUERY}), '&') ELSE '' END || regexp_extract(url, '{_R}', 5)",
)
column("article_guid", "events", "event_id", lambda: urls.guid(F.concat(F.lit("https://x.org/"), F.col("event_id").cast("string")), F.col("ts")), "sha256('https://x.org/' || event_id || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z')")


@query("SELECT a.page_id AS a, b.page_id AS b FROM pages a JOIN pages b ON a.page_id < b.page_id AND " + _HOST.replace("url", "a.url") + " = " + _HOST.replace("url", "b.url"))
def same_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pages of one site."""
    return urls.pairs(read(spark, sf_dir, "pages").select("page_id", urls.domain(F.col("url")).alias("host")), "host", "page_id")


@query(f"SELECT page_id, url FROM {_SHAPED} WHERE NOT (regexp_matches({_PATH}, '{urls.LOCALE}') AND NOT regexp_matches({_PATH}, '{urls.US_ENGLISH}')) AND NOT regexp_matches({_PATH}, '(?i)^/tag(/|$)') AND regexp_matches({_PATH}, '(?i)^/(blog|news|page)(/|$)')")
def path_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.apply_path_filters(shaped(spark, sf_dir), deny=["/tag/*"], allow=["/blog/*", "/news/*", "/page/*"])


@query("SELECT page_id, 'https://' || s || '.' || regexp_replace(" + _HOST + ", '^www\\.', '') AS url FROM pages, (SELECT unnest(" + repr(list(urls.SUBDOMAINS)) + ") AS s)")
def subdomain_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.explode(urls.subdomains(urls.domain(F.col("url")))).alias("url"))


_FIRST = f"'/' || lower(regexp_extract({_PATH}, '^/+([^/]+)', 1))"
_SECTIONS = f"SELECT {_FIRST} AS section, count(*) AS n FROM {_SHAPED} WHERE {_FIRST} <> '/' AND ({_FIRST} IN {urls.SECTIONS} OR regexp_matches({_FIRST}, '{urls.SECTION_LIKE}')) GROUP BY 1 HAVING count(*) >= 3"


@query(_SECTIONS)
def content_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.content_sections(shaped(spark, sf_dir))


@query(f"SELECT page_id, url FROM {_SHAPED} WHERE NOT (regexp_matches({_PATH}, '{urls.LOCALE}') AND NOT regexp_matches({_PATH}, '{urls.US_ENGLISH}')) AND '/' || regexp_extract(lower({_PATH}), '^/([^/]*)', 1) IN (SELECT section FROM ({_SECTIONS}))")
def section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shaped(spark, sf_dir)
    return urls.in_sections(df, urls.content_sections(df))


@query("SELECT DISTINCT split_part(split_part(url, '?', 1), '#', 1) AS url FROM pages")
def distinct_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^([^?#]*)", 1).alias("url")).dropDuplicates()


@query("SELECT page_id, u AS sitemap FROM (SELECT page_id, unnest([x || '/sitemap.xml', x || '/sitemap_index.xml', x || '/sitemaps.xml', x || '/news-sitemap.xml', x || '/sitemap/']) AS u FROM (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS x FROM pages))")
def sitemap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.operators.discover import sitemap_addresses

    return read(spark, sf_dir, "pages").select("page_id", F.explode(sitemap_addresses(F.col("url"))).alias("sitemap"))


