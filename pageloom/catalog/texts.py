"""Text, token and quality queries over ``documents``, ``pages`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.catalog.base import column, query, read
from pageloom.functions import quality, text
from pageloom.functions.text import ATTRIBUTES, ENTITIES, INTERFACE, NON_ARTICLE, TEASERS, WS

_C = F.col


def _re(c: str, pattern: str, to: str = "") -> str:
    pattern = pattern.replace("'", "''")
    return f"regexp_replace({c}, '{pattern}', '{to}', 'g')"


def _strip(c: str) -> str:
    return _re(c, rf"^{WS}+|{WS}+$")


def _lines(c: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, chr(10)), lambda x: {_strip('x')}), chr(10))"


def _flat(c: str) -> str:
    return _strip(_re(c, rf"{WS}+", " "))


def _count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def _norm(c: str) -> str:
    return _re(_lines(_re(f"replace({c}, chr(9), ' ')", " {2,}", " ")), r"\n{3,}", "\n\n")


def _decoded(c: str) -> str:
    for name, char in ENTITIES:
        c = f"replace({c}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return c


_HTML_TEXT = _flat(_re(_re(_re("html", r"(?is)<script\b.*?</script>"), r"(?is)<style\b.*?</style>"), r"<[^>]+>"))
_WORDS = f"list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')"
_TOKENS = (
    "CASE WHEN text = '' OR text IS NULL THEN 0 ELSE CAST((SELECT ceil(length(f) / 4.0) + 5 * "
    + _count("f", r"https?://[^ ]+")
    + " + 10 * "
    + _count("f", r"(?s)```.*?```")
    + " + floor(0.5 * "
    + _count("f", r"\d+")
    + ") + "
    + _count("f", r"[^\x00-\x7F]")
    + f" FROM (SELECT {_flat('text')} AS f)) AS BIGINT) END"
)
_SENTENCES = f"greatest({_count('text', '[.!?]+')}, 1)"
_SYLLABLE = (
    "CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(greatest(len(regexp_extract_all(w, '[aeiouy]+')), 1)"
    " - CASE WHEN ends_with(w, 'e') AND greatest(len(regexp_extract_all(w, '[aeiouy]+')), 1) > 1 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(w, '[^aeiouy]le$') THEN 1 ELSE 0 END, 1) END"
)
_SYLLABLES = f"coalesce(list_sum(list_transform(list_transform(regexp_split_to_array(lower(text), '{WS}+'), lambda v: regexp_replace(v, '[^a-z]', '', 'g')), lambda w: {_SYLLABLE})), 0)"
_RAW = f"(CAST(0.39 AS DOUBLE) * (len({_WORDS}) / CAST({_SENTENCES} AS DOUBLE)) + CAST(11.8 AS DOUBLE) * (CAST({_SYLLABLES} AS DOUBLE) / len({_WORDS})) - CAST(15.59 AS DOUBLE))"
_GRADE = f"CASE WHEN len({_WORDS}) > 0 THEN greatest(floor({_RAW} * 10 + 0.5) / 10, CAST(0 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END"
_LEVEL = "CASE WHEN g <= 5 THEN 'elementary' WHEN g <= 8 THEN 'intermediate' WHEN g <= 12 THEN 'advanced' ELSE 'expert' END"
_LLM = _strip(_lines(_re(_re(_re(_re("replace(text, chr(13) || chr(10), chr(10))", r"\n{3,}", "\n\n"), rf"(?im)^({INTERFACE}).*$"), rf"(?i)\[?({TEASERS})\.?\]?"), "[ \\t]+", " ")))
_PARAGRAPHS = (
    "(SELECT array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN regexp_matches(l[i], '[.!?]$') AND regexp_matches(coalesce(l[i + 1], ''), '^[A-Z0-9]')"
    " AND length(l[i]) > 40 AND length(coalesce(l[i + 1], '')) > 20 THEN l[i] || chr(10) ELSE l[i] END), chr(10)) FROM (SELECT list_filter(string_split({c}, chr(10)), lambda x: length(" + _strip("x") + ") > 0) AS l))"
)

column("strip_html", "pages", "page_id", lambda: text.strip_html(_C("html")), _HTML_TEXT)
column("decode_entities", "pages", "page_id", lambda: text.decode_entities(F.concat(_C("url"), F.lit(" &amp;lt;&nbsp;&ldquo;&#039;&hellip;&rsquo;"))), _decoded("(url || ' &amp;lt;&nbsp;&ldquo;&#039;&hellip;&rsquo;')"))
column("normalize_ws", "pages", "page_id", lambda: text.normalize_whitespace(_C("html")), _norm("html"))
column("detect_paragraphs", "documents", "doc_id", lambda: text.detect_paragraphs(_C("text")), _PARAGRAPHS.replace("{c}", "text"))
column("clean_text", "documents", "doc_id", lambda: text.clean_text(_C("text")), _strip(_PARAGRAPHS.replace("{c}", _norm(_decoded("text")))))
column("remove_urls", "pages", "page_id", lambda: text.remove_urls(F.concat(F.lit("see "), _C("url"), F.lit(" or http://x.y/z\tend"))), _re("('see ' || url || ' or http://x.y/z' || chr(9) || 'end')", rf"https?://[^{WS[1:]}+"))
column("truncate_text", "documents", "doc_id", lambda: text.truncate(_C("text"), 100), r"CASE WHEN length(text) <= 100 THEN text ELSE coalesce(nullif(regexp_extract(text[:100], '(?s)^(.+) ', 1), ''), text[:100]) || '…' END")
_STRIPPED = "html"
for _p in (*NON_ARTICLE, *ATTRIBUTES):
    _STRIPPED = _re(_STRIPPED, _p)
column("strip_non_article", "pages", "page_id", lambda: text.strip_non_article(_C("html")), _STRIPPED)
column("word_count", "documents", "doc_id", lambda: text.word_count(_C("text")), f"len({_WORDS})")
column("reading_time", "documents", "doc_id", lambda: text.reading_time(text.word_count(_C("text"))), f"CAST(ceil(len({_WORDS}) / 200.0) AS BIGINT)")
column("excerpt", "documents", "doc_id", lambda: text.excerpt(_C("text")), "CASE WHEN length(text) > 200 THEN text[:200] || '...' ELSE text END")
column("estimate_tokens", "documents", "doc_id", lambda: text.estimate_tokens(_C("text")), _TOKENS)
column("simple_tokens", "documents", "doc_id", lambda: text.simple_tokens(_C("text")), "CAST(ceil(length(text) / 4.0) AS BIGINT)")
column("fk_grade", "documents", "doc_id", lambda: text.reading_grade(_C("text")), _GRADE)
column("reading_level", "documents", "doc_id", lambda: text.reading_level(text.reading_grade(_C("text"))), f"(SELECT {_LEVEL} FROM (SELECT {_GRADE} AS g))")
column("clean_text_llm", "documents", "doc_id", lambda: text.clean_for_llm(_C("text")), _LLM)
column("input_type", "pages", "page_id", lambda: {"of_url": text.input_type(_C("url")), "of_html": text.input_type(_C("html"))}, "CASE WHEN regexp_matches(url, '(?i)^https?://') THEN 'url' ELSE 'unsupported' END AS of_url, CASE WHEN regexp_matches(html, '(?s)</?[A-Za-z].*>') THEN 'html-string' ELSE 'unsupported' END AS of_html")
column("format_bytes", "documents", "doc_id", lambda: text.format_bytes(F.col("n_chars") * 97), "CASE WHEN n_chars * 97 < 1024 THEN n_chars * 97 || 'B' WHEN n_chars * 97 < 1048576 THEN ((n_chars * 970 + 512) // 1024) // 10 || '.' || ((n_chars * 970 + 512) // 1024) % 10 || 'KB' ELSE ((n_chars * 970 + 524288) // 1048576) // 10 || '.' || ((n_chars * 970 + 524288) // 1048576) % 10 || 'MB' END")
column("format_duration", "documents", "doc_id", lambda: text.format_duration(_C("n_chars") * 7), "CASE WHEN n_chars * 7 < 1000 THEN n_chars * 7 || 'ms' WHEN n_chars * 7 < 60000 THEN ((n_chars * 70 + 500) // 1000) // 10 || '.' || ((n_chars * 70 + 500) // 1000) % 10 || 's' ELSE (n_chars * 7) // 60000 || 'm ' || CAST(floor((n_chars * 7) % 60000 / CAST(1000 AS DOUBLE) + 0.5) AS BIGINT) || 's' END")
column("parse_date", "events", "event_id", lambda: text.parse_date(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "date_trunc('second', ts)")
column("feed_type", "events", "event_id", lambda: text.feed_type(F.concat(F.lit("application/"), F.when(_C("event_id") % 3 == 0, "Atom+xml").when(_C("event_id") % 3 == 1, "rdf+xml").otherwise("rss+xml"))), "CASE event_id % 3 WHEN 0 THEN 'atom' WHEN 1 THEN 'rdf' ELSE 'rss' END")
column("feed_like_link", "pages", "page_id", lambda: text.feed_like(_C("url"), F.lit("News")), "regexp_matches(lower(url || ' News'), 'rss|feed|atom|xml|syndication')")
column("dup_ratio", "documents", "doc_id", lambda: quality.duplicate_ratio(_C("text")), "(SELECT CASE WHEN len(s) > 0 THEN (len(s) - len(list_distinct(s))) / CAST(len(s) AS DOUBLE) ELSE 0.0 END FROM (SELECT list_filter(string_split(text, '.'), lambda x: length(" + _strip("x") + ") > 10) AS s))")
_TITLE = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"


def _article() -> tuple:
    return text.strip_html(_C("html")), F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1), _C("html")


_SCORE = "CAST(1 AS DOUBLE) - CASE WHEN length(t) < 200 THEN CAST(0.5 AS DOUBLE) ELSE 0 END - CASE WHEN length(h) NOT BETWEEN 10 AND 200 THEN CAST(0.2 AS DOUBLE) ELSE 0 END - CASE WHEN t <> '' AND length(t) / CAST(length(html) AS DOUBLE) < 0.1 THEN CAST(0.2 AS DOUBLE) ELSE 0 END"
_ARTICLES = f"(SELECT page_id, html, {_HTML_TEXT} AS t, {_TITLE} AS h FROM pages)"
column("validate_content", "pages", "page_id", lambda: {"valid": (v := quality.validate(*_article()))["is_valid"], "score": v["score"], "n_reasons": F.size(v["reasons"]).cast("long")}, f"{_SCORE} >= 0.5 AS valid, {_SCORE} AS score, CAST((length(t) < 200) AS BIGINT) + CAST((length(h) NOT BETWEEN 10 AND 200) AS BIGINT) + CAST((t <> '' AND length(t) / CAST(length(html) AS DOUBLE) < 0.1) AS BIGINT) AS n_reasons", _ARTICLES)
_BY = "CASE WHEN page_id % 3 = 0 THEN 'A. Writer' END"
_MINUTES = f"CAST(ceil(len(list_filter(regexp_split_to_array(t, '{WS}+'), lambda w: w <> '')) / 200.0) AS BIGINT)"
_QS = f"({_SCORE}) * CAST(0.6 AS DOUBLE) + CAST(0.12 AS DOUBLE) + CASE WHEN page_id % 3 = 0 THEN CAST(0.08 AS DOUBLE) ELSE 0 END + CASE WHEN page_id % 2 = 0 THEN CAST(0.08 AS DOUBLE) ELSE 0 END + CASE WHEN {_MINUTES} >= 2 THEN CAST(0.12 AS DOUBLE) ELSE 0 END"


def _judged():
    t, h, html = _article()
    return dict(text=t, title=h, html=html, published=F.lit("2024-01-15"), byline=F.when(_C("page_id") % 3 == 0, "A. Writer"), schema_type=F.when(_C("page_id") % 2 == 0, "NewsArticle").otherwise("WebPage"), minutes=text.reading_time(text.word_count(t)))


column("quality_score", "pages", "page_id", lambda: F.round(quality.score(**_judged()), 9), f"round(least({_QS}, CAST(1 AS DOUBLE)), 9)", _ARTICLES)
column("quality_breakdown", "pages", "page_id", lambda: {"total": F.round((b := quality.breakdown(**_judged()))["total"], 9), "author": b["author"], "schema": b["schema"], "reading_time": b["reading_time"], "passes": F.round(b["total"], 9) >= 0.5}, f"round({_QS}, 9) AS total, CASE WHEN page_id % 3 = 0 THEN CAST(0.08 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS author, CASE WHEN page_id % 2 = 0 THEN CAST(0.08 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS schema, CASE WHEN {_MINUTES} >= 2 THEN CAST(0.12 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS reading_time, round({_QS}, 9) >= 0.5 AS passes", _ARTICLES)


@query(f"SELECT page_id, round(least({_QS}, CAST(1 AS DOUBLE)), 9) AS score FROM {_ARTICLES} WHERE round(least({_QS}, CAST(1 AS DOUBLE)), 9) >= 0.8")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = read(spark, sf_dir, "pages").select("page_id", F.round(quality.score(**_judged()), 9).alias("score"))
    return scored.where("score >= 0.8")


_DUP = "(SELECT CASE WHEN len(s) > 0 THEN (len(s) - len(list_distinct(s))) / CAST(len(s) AS DOUBLE) ELSE 0.0 END FROM (SELECT list_filter(string_split(t, '.'), lambda x: length(" + _strip("x") + ") > 10) AS s))"
_FAULTS = f"[length(t) < 200, length(h) < 10, length(h) > 200, length(t) / CAST(length(html) AS DOUBLE) < 0.1, {_DUP} > 0.3]"
column("validate_extracted", "pages", "page_id", lambda: (quality.validate_extracted(*_article()), "v.is_valid AS valid", "CAST(size(v.issues) AS BIGINT) AS n_issues"), f"len(list_filter({_FAULTS}, lambda x: x)) = 0 AS valid, len(list_filter({_FAULTS}, lambda x: x)) AS n_issues", _ARTICLES)


@query(f"SELECT doc_id, {_TOKENS} AS tokens FROM documents WHERE {_TOKENS} <= 500")
def token_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.where(text.within_token_limit(_C("text"), 500)).select("doc_id", text.estimate_tokens(_C("text")).alias("tokens"))


@query(
    f"SELECT lang, {_LEVEL} AS level, count(*) AS n, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(w) AS BIGINT) AS words, round(avg(g), 6) AS grade FROM (SELECT lang, {_TOKENS} AS t, len({_WORDS}) AS w, {_GRADE} AS g FROM (SELECT lang, {_LLM} AS text FROM documents)) GROUP BY 1, 2"
)
def llm_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned documents by language and reading level: tokens, words, mean grade."""
    clean = read(spark, sf_dir, "documents").select("lang", text.clean_for_llm(_C("text")).alias("text"))
    measured = clean.select("lang", text.estimate_tokens(_C("text")).alias("t"), text.word_count(_C("text")).alias("w"), text.reading_grade(_C("text")).alias("g"))
    return measured.groupBy("lang", text.reading_level(_C("g")).alias("level")).agg(F.count("*").alias("n"), F.sum("t").alias("tokens"), F.sum("w").alias("words"), F.round(F.avg("g"), 6).alias("grade"))


_NL = "chr(10)"
_FM = (
    f"'---' || {_NL} || 'title: \"' || replace(replace(text, chr(34), ''), chr(10), ' ') || '\"' || {_NL} || 'url: https://x.org/' || doc_id || {_NL} || CASE WHEN doc_id % 2 = 0 THEN 'author: \"J. \\\"Q\\\" Doe\"' || {_NL} ELSE '' END"
    f" || 'source: \"' || source || '\"' || {_NL} || 'language: ' || lang || {_NL} || 'word_count: ' || len({_WORDS}) || {_NL} || 'reading_time: ' || CAST(ceil(len({_WORDS}) / 200.0) AS BIGINT) || {_NL} || 'tokens: ' || {_TOKENS} || {_NL} || '---' || {_NL}"
)


def _frontmatter():
    n = text.word_count(_C("text"))
    return text.frontmatter(F.replace("text", F.lit('"'), F.lit("")), F.concat(F.lit("https://x.org/"), _C("doc_id")), n, text.reading_time(n), text.estimate_tokens(_C("text")), author=F.when(_C("doc_id") % 2 == 0, 'J. "Q" Doe'), site=_C("source"), language=_C("lang"))


column("frontmatter", "documents", "doc_id", _frontmatter, _FM)
