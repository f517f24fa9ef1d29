"""Batches: many URLs scraped in one mode, their statistics and articles; LLM documents of URLs; whole runs."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.operators import discover
from pageloom.plans import pipeline
from pageloom.plans.errors import Aborted, ConfigError, ExtractionFailed, InvalidUrl, NothingFound

MODES = ("smart", "article", "listing")
_ARTICLES = "array<struct<url:string,title:string>>"


def scrape_urls(wanted: DataFrame, corpus: DataFrame, mode: str = "smart", url: str = "url", how: discover.Listing = discover.Listing()) -> DataFrame:
    """(url, mode, success, error, articles): what each wanted URL gives of the corpus (url, html), once for each URL.

    In mode "article" a page must give its article; in "listing" its links are the
    articles, and none are no failure; "smart" takes pages whose address or content
    isn't an article's for listings.  ``error`` is a code of ``errors``.
    """
    if mode not in MODES:
        raise ConfigError(f"mode {mode!r}")
    asked = wanted.select(F.col(url).alias("url")).distinct()
    pages = corpus.select("url", "html").join(asked.where(urls.is_valid(F.col("url"))), "url", "left_semi")
    single = pages if mode == "article" else pages.where(urls.url_type(F.col("url")) == "article") if mode == "smart" else None
    made = asked.select("url", F.lit(None).cast("string").alias("found_as"), F.lit(None).cast(_ARTICLES).alias("articles")).where("false")
    if single is not None:
        one = F.array(F.struct("url", F.col("title").cast("string").alias("title")))
        made = pipeline.extract_articles(single).select("url", F.lit("article").alias("found_as"), one.cast(_ARTICLES).alias("articles"))
    if mode != "article":
        rest = pages.join(made.select("url"), "url", "left_anti") if single is not None else pages
        links = discover.listing_links(rest, how=how).groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "url", "title"))), lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"))).alias("articles"))
        listed = rest.select("url").join(links, F.col("url") == F.col("page"), "left").select("url", F.lit("listing").alias("found_as"), F.coalesce("articles", F.array().cast(_ARTICLES)).alias("articles"))
        made = made.union(listed)
    joined = asked.join(made.dropDuplicates(["url"]), "url", "left").join(pages.select("url", F.lit(True).alias("held")).distinct(), "url", "left")
    success = F.col("found_as").isNotNull()
    error = F.when(~urls.is_valid(F.col("url")), InvalidUrl.code).when(F.col("held").isNull(), NothingFound.code).when(~success, ExtractionFailed.code)
    return joined.select("url", F.coalesce("found_as", F.lit(mode)).alias("mode"), success.alias("success"), error.alias("error"), F.coalesce("articles", F.array().cast(_ARTICLES)).alias("articles"))


def extract_many(wanted: DataFrame, corpus: DataFrame, url: str = "url") -> DataFrame:
    return scrape_urls(wanted, corpus, "article", url)


def discover_sites(wanted: DataFrame, corpus: DataFrame, url: str = "url", how: discover.Listing = discover.Listing()) -> DataFrame:
    return scrape_urls(wanted, corpus, "listing", url, how)


def batch_articles(results: DataFrame) -> DataFrame:
    """(source_url, url, title) of all articles of a batch."""
    return results.where("success").select(F.col("url").alias("source_url"), F.explode("articles").alias("a")).select("source_url", "a.url", "a.title")


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum(F.size("articles")), F.lit(0)).alias("articles"))


def scrape_for_llm(wanted: DataFrame, corpus: DataFrame, url: str = "url", most: int | None = None, **fields: Column) -> DataFrame:
    """(url, title, tokens, grade, level, document, error) of wanted URLs: a document of each article, or the code of what is wrong."""
    asked = wanted.select(F.col(url).alias("url")).distinct()
    pages = corpus.select("url", "html").join(asked, "url", "left_semi")
    made = pipeline.llm_documents(pipeline.extract_articles(pages), most=most, **fields).select("url", "title", "tokens", "grade", "level", "document").dropDuplicates(["url"])
    error = F.when(~urls.is_valid(F.col("url")), InvalidUrl.code).when(F.col("document").isNull(), ExtractionFailed.code)
    return asked.join(made, "url", "left").withColumn("error", error)


@dataclass
class Run:
    """The jobs started within it: their progress, their end if asked for, and how long named phases took.

    Jobs are told apart by a tag, so other work of the session isn't touched.
    """

    spark: SparkSession
    name: str
    phases: dict[str, float] = field(default_factory=dict)
    aborted: bool = False

    def __enter__(self) -> Run:
        self.spark.addTag(self.name)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.removeTag(self.name)

    def timed(self, name: str, call: Callable) -> Callable:
        """``call``, whose seconds are added to a phase."""

        def wrapped(*args: object, **more: object) -> object:
            if self.aborted:
                raise Aborted(f"{self.name} was aborted")
            began = time.monotonic()
            try:
                return call(*args, **more)
            finally:
                self.phases[name] = self.phases.get(name, 0.0) + time.monotonic() - began

        return wrapped

    def progress(self) -> float:
        """The share of the tasks of active stages that have ended; 1 if none is active."""
        tracker = self.spark.sparkContext.statusTracker()
        infos = [i for i in map(tracker.getStageInfo, tracker.getActiveStageIds()) if i]
        return sum(i.numCompletedTasks for i in infos) / max(1, sum(i.numTasks for i in infos)) if infos else 1.0

    def abort(self) -> None:
        self.aborted = True
        self.spark.interruptTag(self.name)


def scraper(corpus: DataFrame, config: pipeline.ScrapeConfig = pipeline.ScrapeConfig(), plugins: pipeline.Plugins | None = None, robots_rules: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """A listing query with its settings, to be called with candidates."""
    return lambda candidates: pipeline.scrape(candidates, corpus, config, plugins, robots_rules)


def batch_processor(corpus: DataFrame, mode: str = "smart", how: discover.Listing = discover.Listing()) -> Callable[[DataFrame], DataFrame]:
    """A batch with its settings, to be called with wanted URLs."""
    return lambda wanted: scrape_urls(wanted, corpus, mode, how=how)


def quick_scrape(sites: DataFrame, corpus: DataFrame, as_of: Column, most: int = 10) -> DataFrame:
    """The best ``most`` articles that each site's own page links to, with the usual settings."""
    pages = corpus.join(sites.select("url").distinct(), "url", "left_semi")
    found = discover.listing_candidates(discover.listing_links(pages), as_of)
    return pipeline.scrape(found, corpus, pipeline.ScrapeConfig(most=most))
