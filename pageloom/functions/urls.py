"""URL functions as column expressions: parts, tests, normal forms and path rules.

Everything is native Spark SQL.  Regular expressions stay in the subset that Java
and RE2 read alike, so the same constants serve DuckDB in tests.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: scheme, host, path, query with "?", fragment with "#"
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^@/?#]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
WEB = r"^(?i)https?://[^/?#\s]+"
TRACKING = ("ref", "source", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")

LISTING = "|".join([r"^/?$", r"(?i:/(?:article|articles|blog|news)/?\??$)", r"/page/\d+/?$", r"/(?:author|category|tag)/[^/]+/?$", r"/archive/?$", r"\?.*page="])
ARTICLE = "|".join(
    [
        r"/\d{4}(?:/\d{1,2}){0,2}/[^/]+/?$",
        r"(?i:/(?:insight|insights|stories|story|storie|post|posts|article|articles|news|blog)/[a-z0-9][a-z0-9-]{10,}[a-z0-9-]/?$)",
        r"(?i:/(?:p|post|article|story)/[a-z0-9]+/?$)",
        r"(?i:/[a-z0-9][a-z0-9-]{20,}/?$)",
    ]
)
LIKELY = r"/(?:articles?|posts?|story|stories|news|blog)/|/\d{4}/\d{2}/"
INCLUDED = r"(?i:/(?:blog|news|story|post|article)/)|/\d{4}/\d{2}/"
EXCLUDED = r"(?i:/(?:about|archive|author|category|contact|login|register|search|tag)/|\.(?:doc|gif|jpe?g|mp4|pdf|png|zip)$|javascript:|mailto:)|#"
LOCALE = r"^/[A-Za-z][A-Za-z](?:-[A-Za-z][A-Za-z])?(?:/|$)"
US_ENGLISH = r"^/[Ee][Nn]-[Uu][Ss](?:/|$)"
SECTIONS = ("/news", "/blog", "/articles", "/posts", "/stories", "/press", "/updates", "/announcements", "/insights", "/resources", "/publications", "/research", "/engineering")
SECTION_LIKE = r"(?i)^/(?:press|update|stor|article|post|blog|news)"
SUBDOMAINS = ("ai", "blog", "blogs", "developers", "engineering", "news", "newsroom", "press", "research")

_WITH_CHILDREN = "about careers contact jobs search team"
_CHILDREN_ONLY = "archive author authors categories category legal tag tags"
_ALONE = "index index.html privacy terms"
_LOCALES = "ar-ae cs-cz da-dk de-at de-ch de-de es-es es-la es-mx fi-fi fr-ca fr-fr he-il id-id it-it ja-jp ko-kr nb-no nl-nl pl-pl pt-br pt-pt ru-ru sv-se th-th tr-tr vi-vn zh-cn zh-hk zh-tw"
_LANGUAGES = "de es fr it ja ko nl pl pt ru zh"
DENIED = tuple(sorted({"/", *(f"/{p}" for p in f"{_WITH_CHILDREN} {_ALONE}".split()), *(f"/{p}/*" for p in f"{_WITH_CHILDREN} {_CHILDREN_ONLY} {_LOCALES} {_LANGUAGES}".split())}))

PRIVATE_HOST = (
    r"^(?i)(?:localhost|0\.0\.0\.0|\[?::1\]?|0\..*|10\..*|127\..*|169\.254\..*|192\.168\..*|172\.(?:1[6-9]|2\d|3[01])\..*|\[?(?:fc00:|fd00:|fe80:|::ffff:(?:0\.|10\.|127\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)).*|.*\.(?:local|internal|localhost))$"
)


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def is_valid(url: Column) -> Column:
    """Whether it is an absolute http or https URL; null is none."""
    return F.coalesce(url.rlike(WEB), F.lit(False))


def domain(url: Column) -> Column:
    """The host in lower case, or null."""
    return F.nullif(F.lower(part(url, 2)), F.lit(""))


def same_domain(a: Column, b: Column) -> Column:
    """Two URLs that can't be read are of the same (no) domain."""
    return domain(a).eqNullSafe(domain(b))


#: Members of a group that are paired at once with as many others, as two arrays.
PAIR_BLOCK = 1024
#: Pairs of blocks to a task.
_BLOCKS_PER_TASK = 16


def pairs(df: DataFrame, group: str, key: str, block: int = PAIR_BLOCK) -> DataFrame:
    """(a, b), a < b, of all keys of one group; null groups and keys have no pairs.

    A group's keys are cut in order into blocks, and each block is paired with itself and those after it.  Pairs of
    blocks are dealt to tasks by their number, which follows the pairs, so a large group is no large task.
    """
    known = df.select(F.col(group).alias("g"), F.col(key).alias("k")).where("g IS NOT NULL AND k IS NOT NULL")
    sizes = known.groupBy("g").agg(F.ceil(F.count("*") / block).alias("m"))
    n = sizes.agg(F.sum(F.col("m") * (F.col("m") + 1) / 2)).first()[0]
    place = F.row_number().over(W.partitionBy("g").orderBy("k")) - 1
    blocks = known.withColumn("i", F.floor(place / block)).groupBy("g", "i").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    first = blocks.select("g", "i", F.col("ks").alias("left"))
    later = blocks.select("g", F.col("i").alias("j"), F.col("ks").alias("right"))
    both = first.join(later, "g").where("i <= j").select("left", "right")
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, min(math.ceil((n or 0) / _BLOCKS_PER_TASK), 20_000))
    dealt = both.repartition(tasks).select(F.explode("left").alias("a"), "right")
    return dealt.select("a", F.explode("right").alias("b")).where("a < b")


def path(url: Column) -> Column:
    """The path, at least "/"; null for what is no URL."""
    return F.when(part(url, 1) != "", F.when(part(url, 3) == "", "/").otherwise(part(url, 3)))


def path_and_query(url: Column) -> Column:
    return F.concat(path(url), F.when(F.length(part(url, 4)) > 1, part(url, 4)).otherwise(""))


def normalize(url: Column) -> Column:
    """Without tracking parameters and one trailing slash, the other parameters sorted by name; the fragment stays."""
    found = F.split(F.substring(part(url, 4), F.lit(2), F.lit(2**31 - 1)), "&")
    name = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    kept = F.filter(found, lambda p: (p != "") & ~name(p).isin(*TRACKING))
    ranked = F.array_sort(F.transform(kept, lambda p, i: F.struct(name(p).alias("n"), i.alias("i"), p.alias("p"))))
    query = F.array_join(F.transform(ranked, lambda s: s["p"]), "&")
    where = path(url)
    trimmed = F.when((F.length(where) > 1) & where.endswith("/"), F.substring(where, F.lit(1), F.length(where) - 1)).otherwise(where)
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    whole = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(rest), trimmed, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), part(url, 5))
    return F.when(part(url, 1) != "", whole).otherwise(url)


def url_type(url: Column) -> Column:
    """"article", "listing" or "unknown", from path and query."""
    p = path_and_query(url)
    segments = F.filter(F.split(p, "/"), lambda s: s != "")
    last = F.element_at(segments, -1)
    slug = F.when(F.size(segments) >= 2, (F.length(last) > 15) & last.contains("-") & ~last.rlike(r"^\d+$")).otherwise(F.lit(False))
    return F.when(p.isNull(), "unknown").when(p.rlike(LISTING), "listing").when(p.rlike(ARTICLE) | slug, "article").otherwise("unknown")


def likely_article(url: Column) -> Column:
    return F.lower(url).rlike(LIKELY)


def passes_filters(url: Column, excluded: str = EXCLUDED, included: str = INCLUDED, domains: Iterable[str] = ()) -> Column:
    """Not excluded, included (an empty pattern includes all), and of one of the domains or under it, if any are named."""
    ok = ~url.rlike(excluded) if excluded else F.lit(True)
    if included:
        ok = ok & url.rlike(included)
    host = domain(url)
    tests = [(host == d.lower()) | host.endswith("." + d.lower()) for d in domains]
    for k, t in enumerate(tests):
        tests[0] = t if not k else tests[0] | t
    return F.coalesce(ok & tests[0] if tests else ok, F.lit(False))


def denied(url: Column, patterns: Iterable[str] = DENIED) -> Column:
    """Whether the path equals a pattern or begins with one that ends in ``/*``, whose slash doesn't count."""
    patterns = tuple(patterns)
    exact, prefixes = [p for p in patterns], [p[:-2] for p in patterns if p.endswith("/*")]
    p = path(url)
    test = p.isin(*exact) if exact else F.lit(False)
    if prefixes:
        test = test | p.rlike("^(?:" + "|".join(map(quote, sorted(prefixes))) + ")")
    return F.coalesce(test, F.lit(False))


def quote(text: str) -> str:
    """A literal for Java's and RE2's regular expressions."""
    return "".join(c if c.isalnum() or c in "/_-~ " else "\\" + c for c in text)


def glob(pattern: str) -> str:
    """The regular expression of a path pattern: ``X/*`` is X and all below it, another ``*`` any characters."""
    if pattern.endswith("/*"):
        return f"(?i)^{quote(pattern[:-2])}(?:/.*)?$"
    return "(?i)^" + ".*".join(map(quote, pattern.split("*"))) + "$"


def matches(p: Column, pattern: str) -> Column:
    return p.rlike(glob(pattern))


def foreign_locale(p: Column) -> Column:
    """Whether a path begins with a locale other than en-us."""
    return p.rlike(LOCALE) & ~p.rlike(US_ENGLISH)


def apply_path_filters(df: DataFrame, url: str = "url", deny: Iterable[str] = (), allow: Iterable[str] = (), skip_allow: bool = False) -> DataFrame:
    """Rows without a foreign locale and a denied path, and with an allowed one if any is named; what is no URL stays."""
    p = path(F.col(url))
    keep = ~foreign_locale(p)
    for pattern in deny:
        keep = keep & ~matches(p, pattern)
    if not skip_allow and (allow := list(allow)):
        keep = keep & p.rlike("|".join(f"(?:{glob(a)})" for a in allow))
    return df.where(F.coalesce(keep, F.lit(True)))


def inferred_allow(url: Column) -> Column:
    """The path pattern that a start URL asks for: its section, else its path if longer than 3, else null."""
    p = F.lower(path(url))
    out = F.when(p == "/", None)
    for s in SECTIONS:
        out = out.when(p.startswith(s), f"{s}/*")
    return out.when(F.length(p) > 3, F.concat(F.regexp_replace(p, r"/$", ""), F.lit("/*")))


def private_host(url: Column) -> Column:
    """Whether fetching it would reach an internal address, or it is no web URL."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.coalesce(~url.rlike(WEB) | host.rlike(PRIVATE_HOST), F.lit(True))


def title(url: Column) -> Column:
    """A title from the last part of the path, or from the host."""
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    words = F.regexp_replace(F.regexp_replace(F.coalesce(F.try_element_at(segments, F.lit(-1)), domain(url)), "[-_]", " "), r"(?i)\.(html?|php|asp|jsp)$", "")
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.lit(2**31 - 1))))
    return F.coalesce(F.array_join(F.transform(F.split(words, " "), capital), " "), F.lit("Untitled Article"))


def cache_key(url: Column, options: str = "{}") -> Column:
    bare = F.regexp_replace(F.lower(url), "/$", "")
    return F.substring(F.sha2(F.concat(bare, F.lit(":"), F.substring(F.md5(F.lit(options)), 1, 8)), 256), 1, 24)


def guid(url: Column, published: Column) -> Column:
    return F.sha2(F.concat(url, F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), 256)


def content_guid(title: Column, published: Column, source: Column) -> Column:
    """A key that the same article has in several feeds: title without case, space and marks, day (yyyy-MM-dd) and source."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), r"\s+", " "), r"[^\w\s]", "")
    return F.sha2(F.concat(flat, F.lit("|"), published, F.lit("|"), F.lower(F.trim(F.coalesce(source, F.lit("unknown"))))), 256)


def subdomains(host: Column) -> Column:
    """The addresses where a site's blog may be."""
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.transform(F.array(*map(F.lit, SUBDOMAINS)), lambda s: F.concat(F.lit("https://"), s, F.lit("."), bare))


def content_sections(df: DataFrame, url: str = "url", least: int = 3) -> DataFrame:
    """(section, n): first path segments that look like content and occur ``least`` times or more, the most frequent first."""
    first = F.lower(F.regexp_extract(path(F.col(url)), r"^/+([^/]+)", 1))
    named = df.select(F.concat(F.lit("/"), first).alias("section")).where((F.col("section") != "/") & (F.col("section").isin(*SECTIONS) | F.col("section").rlike(SECTION_LIKE)))
    return named.groupBy("section").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "section")


def in_sections(df: DataFrame, sections: DataFrame, url: str = "url") -> DataFrame:
    """Rows under one of the sections and of no foreign locale; all rows if there is no section."""
    p = F.lower(path(F.col(url)))
    first = F.concat(F.lit("/"), F.regexp_extract(p, r"^/([^/]*)", 1))
    if not sections.take(1):
        return df
    return df.where(~foreign_locale(p)).join(sections.select("section"), first == F.col("section"), "left_semi")
