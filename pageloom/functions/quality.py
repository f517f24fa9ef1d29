"""Quality of extracted content, from the columns of an article, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import bound, strip_space

ARTICLE_TYPES = ("Article", "BlogPosting", "NewsArticle", "ScholarlyArticle", "TechArticle")


@dataclass(frozen=True)
class Weights:
    content: float = 0.60
    date: float = 0.12
    author: float = 0.08
    schema: float = 0.08
    reading_time: float = 0.12
    threshold: float = 0.50


def _given(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def _issues(text: Column, title: Column, html: Column | None) -> tuple[Column, Column, Column]:
    short = F.coalesce(F.length(text), F.lit(0)) < 200
    titled = ~F.coalesce(F.length(title), F.lit(0)).between(10, 200)
    thin = F.lit(False) if html is None else F.coalesce(_given(html) & _given(text) & (F.length(text) / F.length(html) < 0.1), F.lit(False))
    return short, titled, thin


def content_score(text: Column, title: Column, html: Column | None = None) -> Column:
    """1 less penalties for short text, a title of odd length and much markup."""
    score = F.lit(1.0)
    for issue, penalty in zip(_issues(text, title, html), (0.5, 0.2, 0.2)):
        score = score - F.when(issue, F.lit(penalty)).otherwise(F.lit(0.0))
    return score


def validate(text: Column, title: Column, html: Column | None = None) -> Column:
    """struct(is_valid, score, reasons)."""
    score = content_score(text, title, html)
    names = ("Content too short (< 200 characters)", "Title length invalid (must be 10-200 characters)", "Low text-to-HTML ratio (< 10%)")
    reasons = F.array_compact(F.array(*(F.when(i, F.lit(n)) for i, n in zip(_issues(text, title, html), names))))
    return F.struct((score >= 0.5).alias("is_valid"), F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)).alias("score"), reasons.alias("reasons"))


def breakdown(text: Column, title: Column, html: Column | None = None, published: Column | None = None, byline: Column | None = None, schema_type: Column | None = None, minutes: Column | None = None, weights: Weights = Weights()) -> Column:
    """struct of the five parts, the uncapped total and whether it passes."""
    part = lambda test, w: (F.lit(0.0) if test is None else F.when(F.coalesce(test, F.lit(False)), F.lit(w)).otherwise(F.lit(0.0)))
    clamped = F.greatest(F.least(content_score(text, title, html), F.lit(1.0)), F.lit(0.0))
    parts = {
        "content": clamped * F.lit(weights.content),
        "date": part(None if published is None else _given(published), weights.date),
        "author": part(None if byline is None else _given(byline), weights.author),
        "schema": part(None if schema_type is None else F.lower(schema_type).isin(*map(str.lower, ARTICLE_TYPES)), weights.schema),
        "reading_time": part(None if minutes is None else minutes >= 2, weights.reading_time),
    }
    total = parts["content"] + parts["date"] + parts["author"] + parts["schema"] + parts["reading_time"]
    return F.struct(*(c.alias(n) for n, c in parts.items()), total.alias("total"), (total >= weights.threshold).alias("passes_threshold"))


def score(*args, **kwargs) -> Column:
    """The total of ``breakdown``, at most 1."""
    return F.least(breakdown(*args, **kwargs)["total"], F.lit(1.0))


def duplicate_ratio(text: Column) -> Column:
    """The share of sentences of over 10 characters that repeat another one."""
    sentences = F.filter(F.split(text, r"\."), lambda s: (F.length(s) > 10) & (F.length(strip_space(s)) > 10))
    return bound(sentences, lambda s: F.when(F.size(s) > 0, (F.size(s) - F.size(F.array_distinct(s))) / F.size(s)).otherwise(F.lit(0.0)))


_EXTRACTED = ((0.5, "short content"), (0.2, "short title"), (0.1, "long title"), (0.2, "much markup"), (0.3, "repeated sentences"))


def validate_extracted(text: Column, title: Column, html: Column) -> Column:
    """struct(is_valid, score, issues): stricter, any issue makes it invalid."""
    length = F.coalesce(F.length(title), F.lit(0))

    def found(t: Column) -> Column:
        much = F.coalesce(F.length(t) / F.length(html) < 0.1, F.lit(False))
        return F.array(F.coalesce(F.length(t), F.lit(0)) < 200, length < 10, length > 200, much, F.coalesce(duplicate_ratio(t) > 0.3, F.lit(False)))

    def judged(flags: Column) -> Column:
        total = F.lit(1.0)
        for i, (penalty, _) in enumerate(_EXTRACTED):
            total = total - F.when(flags[i], F.lit(penalty)).otherwise(F.lit(0.0))
        issues = F.array_compact(F.array(*(F.when(flags[i], F.lit(name)) for i, (_, name) in enumerate(_EXTRACTED))))
        return F.struct((~F.exists(flags, lambda x: x)).alias("is_valid"), F.greatest(total, F.lit(0.0)).alias("score"), issues.alias("issues"))

    return bound(bound(text, found), judged)
