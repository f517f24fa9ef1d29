"""robots.txt: parsed natively into a table of rules, and joined to URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.functions import urls

AGENT = "pageloom/1.0"


def directives(robots: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """(host, ord, key, value): every line that is a directive, in lower case and order."""
    lines = robots.select(F.col(host).alias("host"), F.posexplode(F.split(body, r"\r?\n")).alias("ord", "line"))
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    return lines.where(line.rlike("^[^#:]+:")).select("host", "ord", F.lower(F.trim(F.regexp_extract(line, r"^([^:]+):", 1))).alias("key"), F.trim(F.regexp_extract(line, r"^[^:]+:(.*)$", 1)).alias("value"))


def rules(robots: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """(host, grp, agent, ord, kind, value): every User-agent line begins a group, even right after another one."""
    lines = directives(robots, host, body)
    start = (F.col("key") == "user-agent").cast("int")
    order = W.partitionBy("host").orderBy("ord")
    grouped = lines.withColumn("grp", F.sum(start).over(order)).withColumn("agent", F.lower(F.last(F.when(start == 1, F.col("value")), ignorenulls=True).over(order)))
    kept = grouped.where("grp > 0 AND key IN ('user-agent', 'allow', 'disallow', 'crawl-delay') AND (key = 'user-agent' OR value <> '')")
    return kept.select("host", "grp", F.when(F.col("agent") == "", "*").otherwise(F.col("agent")).alias("agent"), "ord", F.col("key").alias("kind"), "value")


def best_group(found: DataFrame, agent: str = AGENT) -> DataFrame:
    """The rules of each host's first group for the agent, else of its first for "*"."""
    mine = found.where(F.col("agent").isin(agent.lower(), "*"))
    first = mine.groupBy("host").agg(F.min(F.struct((F.col("agent") != agent.lower()).alias("general"), "grp")).alias("best"))
    return mine.join(first, "host").where(F.col("grp") == F.col("best.grp")).drop("best")


def pattern_regex(value: Column) -> Column:
    """A rule's path as a regular expression that matches from the beginning; * is any characters."""
    literal = F.regexp_replace(value, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(literal, F.lit("*"), F.lit(".*")))


def check(pages: DataFrame, found: DataFrame, url: str = "url", agent: str = AGENT) -> DataFrame:
    """``pages`` with ``allowed`` and ``crawl_delay`` (ms): any Allow that matches wins, then any Disallow."""
    group = best_group(found, agent)
    own = group.groupBy("host").agg(
        F.collect_list(F.when(F.col("kind") == "allow", pattern_regex(F.col("value")))).alias("_allow"),
        F.collect_list(F.when(F.col("kind") == "disallow", pattern_regex(F.col("value")))).alias("_deny"),
        F.max_by(F.when(F.col("kind") == "crawl-delay", F.col("value").try_cast("double") * 1000), F.when(F.col("kind") == "crawl-delay", F.col("ord"))).alias("crawl_delay"),
    )
    host = urls.domain(F.col(url))
    joined = pages.withColumn("_host", host).join(own.withColumnRenamed("host", "_host"), "_host", "left")
    path = urls.path(F.col(url))
    any_of = lambda c: F.coalesce(F.exists(c, lambda r: F.rlike(path, r)), F.lit(False))
    return joined.withColumn("allowed", any_of(F.col("_allow")) | ~any_of(F.col("_deny"))).drop("_host", "_allow", "_deny")


def sitemaps(robots: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    return directives(robots, host, body).where("key = 'sitemap' AND value <> ''").select("host", F.col("value").alias("sitemap"))


def disallowed_paths(robots: DataFrame, agent: str = "*", host: str = "host", body: str = "body") -> DataFrame:
    """(host, disallowed): the second parser, which merges all groups for "*" and for the agent."""
    found = rules(robots, host, body).where(F.col("agent").isin("*", agent.lower()) & (F.col("kind") == "disallow"))
    return found.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda s: s["value"]).alias("disallowed"))


def path_allowed(path: Column, disallowed: Column) -> Column:
    """Disallowed prefixes only; a rule with * is used as a regular expression as it stands."""
    hit = F.exists(disallowed, lambda d: F.when(d.contains("*"), F.rlike(path, F.concat(F.lit("^"), F.replace(d, F.lit("*"), F.lit(".*"))))).otherwise(path.startswith(d)))
    return ~F.coalesce(hit, F.lit(False))


PAYWALL = r"(?i)paywall|subscribe.*to.*continue|subscription.*required|members.*only|premium.*content|unlock.*article|sign.*up.*to.*read|register.*to.*continue"


def has_paywall(body: Column) -> Column:
    return F.coalesce(body.rlike(PAYWALL), F.lit(False))


def suggested_action(reachable: Column, auth: Column, robots_allowed: Column, paywall: Column, status: Column, ms: Column) -> Column:
    slow = (status == 429) | (ms > 5000)
    return F.when(~reachable, "skip").when(auth, "requires-auth").when(~robots_allowed, "skip").when(paywall | F.coalesce(slow, F.lit(False)), "use-proxy").otherwise("scrape")
