"""URL filter that sees through aliases.

Redirects, canonical links and refresh targets are edges between URLs, and so is a
URL and its normal form.  Distributed connected components over these edges make
the aliases of a page one component.  A block rule that a URL of the component
matches blocks all of it.  An explicit allow rule takes precedence: a URL that
matches one is allowed, whatever blocks it or its aliases, and a block rule that it
matches as well is not passed on to its aliases.  Allowing isn't passed on, so a
redirect to an allowed site launders nothing.

Targets in a page may be relative, and character references in them are decoded.

Rules are rows (kind, value, action): kind "domain" matches a host and all hosts
under it, kind "url" a URL by its normal form; action is "block" or "allow".

Defined results: rows with a null or empty URL are kept, without a component; a URL
without alias is its own component; repeated rows and edges have one result each;
edges with a null end don't matter; rules of other kinds or with nulls match nothing;
an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import shared
from pageloom.llm.components import components

RULES = "kind string, value string, action string"
_SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_BASE = r"(?is)<base\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")
#: What comes before the target in a refresh.
_DELAY = re.compile(r"\s*(?:[\d.]+\s*(?:[;,]|\s|$)\s*(?:url\s*=\s*)?|url\s*=\s*)", re.I)


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), _SPLIT, 2)), r"^.*@", ""), r":\d*$", "")


def normal_form(url: Column) -> Column:
    """One scheme, no ``www.`` or ``m.``, fragment, tracking parameters, trailing slash or ``.html``."""
    path = F.regexp_replace(F.regexp_extract(F.trim(url), _SPLIT, 3), r"(/index)?(\.html?|/)?$", "")
    query = F.regexp_replace(F.regexp_extract(F.trim(url), _SPLIT, 4), r"([?&])(utm_[a-z]+|ref|source)=[^&]*", "$1")
    query = F.regexp_replace(F.regexp_replace(query, r"([?&])&+", "$1"), r"[?&]+$", "")
    return F.concat(F.lit("http://"), F.regexp_replace(host(url), r"^(www|m)\.", ""), path, query)


def _attribute(tag: str, name: str) -> Column:
    """The value of an attribute of the page's first such tag, as written, without quotes."""
    value = F.regexp_extract(F.regexp_extract("html", tag, 0), rf"(?is)[\s\"']{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)", 1)
    return F.regexp_replace(value, "(?s)^([\"'])(.*)\\1$", "$2")


def resolve(url: str, base: str, target: str) -> str | None:
    """Where ``target`` leads from a page; ``base`` is what its ``base`` element has, or empty."""
    if not (target := re.sub(r"[\t\r\n]", "", target).strip()):
        return None
    url = url.strip()
    try:
        return urljoin(urljoin(url if _SCHEME.match(url) else f"http://{url}", base.strip()), target)
    except ValueError:
        return None


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for url, base, canonical, refresh in zip(*(c.to_pylist() for c in batch.columns)):
            base = html.unescape(base)
            refresh = html.unescape(refresh)
            after = refresh[delay.end() :] if (delay := _DELAY.match(refresh)) else ""
            after = after[1:].split(after[0])[0] if after[:1] in ("'", '"') else after
            rows += [(url, to) for to in (resolve(url, base, html.unescape(canonical)), resolve(url, base, after)) if to]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["src", "dst"])


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): canonical links and refresh targets of pages (url, html), resolved against the page's URL or its base element."""
    low = F.lower("html")
    some = pages.where("url IS NOT NULL").where(low.contains("canonical") | low.contains("http-equiv"))
    written = some.select("url", _attribute(_BASE, "href").alias("base"), _attribute(_LINK, "href").alias("canonical"), _attribute(_REFRESH, "content").alias("refresh"))
    return written.where("canonical <> '' OR refresh <> ''").mapInArrow(_edges, "src string, dst string").where(F.col("dst").rlike("(?i)^https?://[^/?#]"))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULES)


def decide(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """(page_id, url, component, decision, reason): decision is "block", "allow" or "keep"; reason is "rule"
    if a rule matches the URL itself, "alias" if it is blocked for an alias, else null.

    ``component`` is the least URL of the component.  ``edges`` (src, dst) holds known redirects.
    """
    pages = pages.select(F.col(key), "url", "html")
    real = pages.where("url IS NOT NULL AND trim(url) <> ''")
    links = page_edges(real)
    if edges is not None:
        links = links.union(edges.select("src", "dst"))
    links = shared.store(links.where("src IS NOT NULL AND dst IS NOT NULL"), "links")
    ends = real.select("url").union(links.select("src")).union(links.select("dst")).where("trim(url) <> ''").distinct()
    ends = shared.store(ends.select("url", normal_form(F.col("url")).alias("normal")), "ends")
    found = components(links.union(ends))
    nodes = ends.select("url").union(ends.select("normal")).distinct().join(found, F.col("url") == F.col("node"), "left")
    nodes = shared.store(nodes.select("url", F.coalesce("component", "url").alias("component")), "urls")
    shared.discard(links, ends)
    labels = F.split(host(F.col("url")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = rules.where("kind IN ('domain', 'url') AND value IS NOT NULL AND action IN ('block', 'allow')").select("kind", F.when(F.col("kind") == "domain", F.lower("value")).otherwise(normal_form(F.col("value"))).alias("value"), "action").distinct()
    asked = nodes.select("url", "component", F.explode(F.concat(F.transform(suffixes, lambda s: F.struct(F.lit("domain").alias("kind"), s.alias("value"))), F.array(F.struct(F.lit("url").alias("kind"), normal_form(F.col("url")).alias("value"))))).alias("ask"))
    hits = asked.join(known, (F.col("ask.kind") == known["kind"]) & (F.col("ask.value") == known["value"])).groupBy("url", "component").agg(F.bool_or(F.col("action") == "allow").alias("allowed"), F.bool_or(F.col("action") == "block").alias("hit"))
    hits = shared.store(hits, "hits")
    blocked = hits.where("hit AND NOT allowed").select("component").distinct().withColumn("blocked", F.lit(True))
    of_url = nodes.join(hits.drop("component"), "url", "left").join(blocked, "component", "left")
    decision = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("keep")
    reason = F.when(F.col("allowed") | (F.col("hit") & F.col("blocked")), "rule").when(F.col("blocked"), "alias")
    of_url = of_url.select(F.col("url").alias("of"), "component", decision.alias("decision"), reason.alias("reason"))
    return pages.drop("html").join(of_url, F.col("url") == F.col("of"), "left").select(key, "url", "component", F.coalesce("decision", F.lit("keep")).alias("decision"), "reason")
