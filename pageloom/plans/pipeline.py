"""Whole queries: page and article extraction, LLM documents, the scrape of a site, batches, and plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import quality, text, urls
from pageloom.operators import articles, discover, extract, robots
from pageloom.operators.chunks import chunked
from pageloom.plans.errors import ConfigError, ScrapeError, UnsupportedInput  # noqa: F401

MOST_BYTES = 10 << 20
LEAST_CHARS = 200


@dataclass
class Plugins:
    """Hooks of a scrape: of URLs, of the table of articles, of a column of each, and a test that articles must pass."""

    before: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    after: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    enhance: dict[str, Column] = field(default_factory=dict)
    keep: list[Column] = field(default_factory=list)


@dataclass(frozen=True)
class ScrapeConfig:
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = urls.DENIED
    most: int | None = 10
    threshold: float = 0.3
    weights: quality.Weights = quality.Weights()

    def __post_init__(self) -> None:
        if (self.most is not None and self.most < 1) or not 0 <= self.threshold <= 1:
            raise ConfigError("most must be positive and threshold from 0 to 1")


def size_guard(pages: DataFrame, html: str = "html", most: int = MOST_BYTES) -> DataFrame:
    return pages.where(F.length(html) <= most)


def extract_articles(pages: DataFrame, url: str = "url", html: str = "html", robots_rules: DataFrame | None = None, open_hosts: DataFrame | None = None) -> DataFrame:
    """Articles of pages (url, html): no internal addresses, none of ``open_hosts`` (host), whose circuit breaker is
    open, allowed by robots.txt if rules are given, not too large,
    by readability or else the usual elements, of 200 characters or more."""
    found = size_guard(pages, html).where(~urls.private_host(F.col(url)))
    if open_hosts is not None:
        found = found.join(open_hosts.select(F.col("host").alias("_host")), urls.domain(F.col(url)) == F.col("_host"), "left_anti")
    if robots_rules is not None:
        found = robots.check(found, robots_rules, url).where("allowed").drop("allowed", "crawl_delay")
    made = extract.extract(found, "main", "article", "published", "site_name", "language", html=html, url=url)
    best = made.withColumnRenamed("main", "c").where(F.length("c.text") >= LEAST_CHARS)
    others = [c for c in pages.columns if c not in (html,)]
    return best.select(*others, F.coalesce(F.nullif("c.title", F.lit("")), "article.title").alias("title"), "c.html", "c.text", "c.word_count", "c.reading_time", "c.confidence", "c.method", F.col("article.author").alias("byline"), F.coalesce("published", "article.published_time").alias("published_time"), F.col("article.type").alias("schema_type"), F.coalesce("site_name", "article.site_name").alias("site_name"), F.coalesce("language", "article.lang").alias("lang"), text.excerpt(F.col("c.text")).alias("excerpt"))


def llm_documents(df: DataFrame, url: str = "url", title: str = "title", body: str = "text", markdown: str | None = None, most: int | None = None, **fields: Column) -> DataFrame:
    """``df`` with ``clean``, ``tokens``, ``grade``, ``level``, ``frontmatter`` and ``document``.

    Further ``fields`` (author, date, site, language) go into the frontmatter.
    """
    made = df.withColumn("clean", text.clean_for_llm(F.coalesce(F.col(body), F.lit(""))))
    made = made.withColumns({"tokens": text.estimate_tokens(F.col("clean")), "grade": text.reading_grade(F.col("clean")), "words": text.word_count(F.col("clean"))})
    made = made.withColumn("level", text.reading_level(F.col("grade")))
    if most is not None:
        made = made.where(F.col("tokens") <= most)
    front = text.frontmatter(F.col(title), F.col(url), F.col("words"), text.reading_time(F.col("words")), F.col("tokens"), level=F.col("level"), grade=F.col("grade"), **fields)
    made = made.withColumn("frontmatter", front)
    return made.withColumn("document", F.concat("frontmatter", F.lit("\n\n"), F.col(markdown or "clean"))).drop("words")


def llm_chunks(documents: DataFrame, key: str, body: str = "clean", most: int = 4000, repeat: int = 200) -> DataFrame:
    return chunked(documents, key, body, most, repeat)


def scored(df: DataFrame, weights: quality.Weights = quality.Weights()) -> DataFrame:
    """Articles as ``extract_articles`` gives them, with ``quality_score``."""
    c = F.col
    return df.withColumn("quality_score", quality.score(c("text"), c("title"), c("html"), c("published_time"), c("byline"), c("schema_type"), c("reading_time"), weights))


def scrape(candidates: DataFrame, corpus: DataFrame, config: ScrapeConfig = ScrapeConfig(), plugins: Plugins | None = None, robots_rules: DataFrame | None = None, open_hosts: DataFrame | None = None) -> DataFrame:
    """The listing query: candidates are filtered by path, deduplicated and ranked, the best
    ``most`` of each site (None: all) looked up in the corpus (url, html), extracted, scored, and kept from the threshold on."""
    plugins = plugins or Plugins()
    found = candidates
    for hook in plugins.before:
        found = hook(found)
    found = found.where(~urls.denied(F.col("url"), config.deny))
    found = urls.apply_path_filters(found, "url", allow=config.allow, skip_allow=not config.allow)
    ranked = articles.rank_sites(articles.dedupe(found.withColumn("ord", F.col("guid"))).drop("ord"), config.most)
    bodies = extract_articles(corpus.join(ranked.select("url"), "url", "left_semi"), robots_rules=robots_rules, open_hosts=open_hosts).select("url", *(F.col(c).alias(f"x_{c}") for c in ("title", "html", "text", "word_count", "reading_time", "byline", "schema_type", "excerpt")))
    joined = ranked.join(bodies, "url", "left")
    c = F.col
    out = joined.select("url", F.when(F.coalesce(F.length("title"), F.lit(0)) < 5, F.coalesce("x_title", "title")).otherwise(c("title")).alias("title"), "published_at", F.coalesce("x_excerpt", "excerpt").alias("excerpt"), F.coalesce("x_html", "content").alias("content"), c("x_text").alias("text"), F.when(c("x_html").isNotNull(), F.least(c("confidence") + 0.1, F.lit(1.0))).otherwise(c("confidence")).alias("confidence"), "source", "guid", c("x_word_count").alias("word_count"), c("x_reading_time").alias("reading_time"), c("x_byline").alias("byline"), c("x_schema_type").alias("schema_type"))
    out = out.withColumn("quality_score", quality.score(F.coalesce("text", "content"), c("title"), c("content"), c("published_at"), c("byline"), c("schema_type"), c("reading_time"), config.weights)).where(c("quality_score") >= config.threshold)
    if plugins.enhance:
        out = out.withColumns(plugins.enhance)
    for test in plugins.keep:
        out = out.where(test)
    for hook in plugins.after:
        out = hook(out)
    return out


def smart_scrape(pages: DataFrame, url: str = "url", html: str = "html", mode: str | None = None, how: discover.Listing = discover.Listing()) -> DataFrame:
    """(url, mode, title, items): articles of article pages, links of listing pages; an article page that gives no
    article is read as a listing."""
    if mode not in (None, "article", "listing"):
        raise ConfigError(f"mode {mode!r}")
    asked = F.lit(mode) if mode else F.when(urls.url_type(F.col(url)) == "article", "article").otherwise("listing")
    kept = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).withColumn("mode", asked)
    found = extract_articles(kept.where("mode = 'article'")).select("url", "title")
    missed = kept.join(found.select("url"), "url", "left_anti")
    listed = discover.listing_links(missed, how=how).groupBy("page").agg(F.count("*").alias("items"))
    a = found.select("url", F.lit("article").alias("mode"), "title", F.lit(1).cast("long").alias("items"))
    return a.union(missed.join(listed, F.col("url") == F.col("page"), "left").select("url", F.lit("listing"), F.lit(None).cast("string"), F.coalesce("items", F.lit(0)).cast("long")))


def parse(inputs: DataFrame, corpus: DataFrame, key: str = "id", value: str = "input") -> DataFrame:
    """(key, input_type, title, text, word_count, tokens, error) of URLs, which are looked up, HTML strings, and others."""
    kind = text.input_type(F.col(value))
    typed = inputs.select(key, F.col(value).alias("input"), kind.alias("input_type"))
    pages = typed.where("input_type = 'url'").join(corpus.select("url", "html"), F.trim("input") == F.col("url"), "left").select(key, "input_type", "url", "html")
    strings = typed.where("input_type = 'html-string'").select(key, "input_type", F.lit("").alias("url"), F.col("input").alias("html"))
    made = extract.extract(pages.union(strings), "fast")
    body = F.col("fast.text")
    none = F.lit(None)
    ok = made.select(key, "input_type", F.col("fast.title").alias("title"), body.alias("text"), F.col("fast.word_count").alias("word_count"), text.simple_tokens(body).alias("tokens"), F.when(F.col("fast").isNull(), "no content").alias("error"))
    bad = typed.where("input_type = 'unsupported'").select(key, "input_type", none.cast("string"), none.cast("string"), none.cast("long"), F.lit(0).cast("long"), F.lit(UnsupportedInput.code))
    return ok.union(bad)


def flatten(frames: Iterable[DataFrame]) -> DataFrame:
    """One table of several batches."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if out is None:
        raise ConfigError("no batch")
    return out
