"""The queries opN_<name>, each over its whole table, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import capture_index, decontamination, jaccard_join, line_dedup, media, packing, quality, shared, substring_dedup, token_output, url_filter
from pageloom.llm.wordhash import PLAIN_SEPARATOR

Query = Callable[[SparkSession, str], DataFrame]

#: A text's "plain" words in DuckDB.
_WORDS = f"list_filter(regexp_split_to_array(lower(text), '{PLAIN_SEPARATOR}'), lambda x: x <> '')"


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' sequences into the shared folder and gives their index."""
    return token_output.write_tokens(shared.table(sf_dir, "documents", spark), shared.new_path(spark, "tokens"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_spans(shared.table(sf_dir, "documents", spark), shared.table(sf_dir, "benchmark", spark))


OP2_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, n, array_to_string(w[j + 1 : j + n], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(len(w) - least(len(w), 13) + 1)) AS j FROM b WHERE len(w) >= 5)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dg AS (SELECT doc_id, n, len(w) AS total, unnest(range(len(w) - n + 1)) AS j, w FROM d, (SELECT DISTINCT n FROM bg)),
h AS (SELECT doc_id, total, j, j + n AS e, item_id FROM (SELECT *, array_to_string(w[j + 1 : j + n], ' ') AS g FROM dg) AS x JOIN bg USING (n, g)),
s AS (SELECT *, CASE WHEN j < max(e) OVER (PARTITION BY doc_id ORDER BY j, e, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM h),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY j, e, item_id) AS island FROM s),
t AS (SELECT doc_id, any_value(total) AS total, min(j) AS first_word, max(e) AS end_word, list_sort(list(DISTINCT item_id)) AS items FROM i GROUP BY doc_id, island)
SELECT doc_id, first_word, end_word, items, CASE WHEN sum(end_word - first_word) OVER (PARTITION BY doc_id) >= 0.5 * total THEN 'remove_document' ELSE 'remove_span' END AS action FROM t
"""


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that is similar to another one, with its class and its number of links."""
    return jaccard_join.similar(shared.table(sf_dir, "documents", spark))


OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(len(w) - 2), lambda j: array_to_string(w[j + 1 : j + 3], ' '))
  ELSE [array_to_string(w, ' ')] END)) AS s FROM w WHERE len(w) > 0),
g AS (SELECT min(doc_id) AS id, list(doc_id) AS ids, s FROM s GROUP BY s),
e AS (SELECT id, len(s) AS n, unnest(s) AS x FROM g),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) / CAST(a.n + b.n - count(*) AS DOUBLE) >= 0.5),
r(node, seen) AS (SELECT id, id FROM g UNION SELECT p.b, r.seen FROM r JOIN p ON p.a = r.node),
c AS (SELECT node, min(seen) AS class_id FROM r GROUP BY node),
l AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT unnest(ids) AS doc_id, class_id, id AS set_id, coalesce(n_links, 0) AS n_links, len(ids) AS n_copies
FROM g JOIN c ON c.node = g.id LEFT JOIN l ON l.a = g.id WHERE n_links > 0 OR len(ids) > 1
"""


#: Sites to block, with all hosts under them; the site allowed is so whatever its aliases are.
SITE_RULES = [("domain", f"{name}.example.{end}", "block") for name in ("cheap-pills", "free-bets", "spam-farm", "adult-x", "ads-track", "casino-win") for end in ("com", "net", "org")]
SITE_RULES += [("domain", "tionsh.example.net", "allow")]


def redirects(pages: DataFrame) -> DataFrame:
    """(src, dst): the tables hold no redirects, so every page's URL leads to its site's short form of it, and that to
    a short form that all sites share."""
    number = F.regexp_extract("url", r"^[a-z]+://[^/?#]*/[^/?#]*/(\d+)", 1)
    site = F.regexp_extract(url_filter.host(F.col("url")), r"([^.]+\.[^.]+\.[^.]+)$", 1)
    hops = pages.select("url", F.concat(F.lit("http://"), site, F.lit("/n/"), number).alias("short"), F.concat(F.lit("http://short.example/n/"), number).alias("all")).where(number != "")
    return hops.select(F.col("url").alias("src"), F.col("short").alias("dst")).union(hops.select("short", "all"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shared.table(sf_dir, "pages", spark)
    return url_filter.decide(pages, url_filter.rules_frame(spark, SITE_RULES), redirects(pages))


def _sql_host(url: str) -> str:
    return f"regexp_replace(lower(regexp_extract({url}, '^[a-z]+://([^/?#]*)', 1)), ':[0-9]*$', '')"


def _sql_normal(url: str) -> str:
    path = f"regexp_replace(regexp_extract({url}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(/index)?(\\.html?|/)?$', '')"
    query = f"regexp_replace(regexp_extract({url}, '(\\?[^#]*)', 1), '([?&])(utm_[a-z]+|ref|source)=[^&]*', '\\1', 'g')"
    return f"'http://' || regexp_replace({_sql_host(url)}, '^(www|m)\\.', '') || {path} || regexp_replace(regexp_replace({query}, '([?&])&+', '\\1', 'g'), '[?&]+$', '')"


_DOMAINS = ", ".join(f"'{value}'" for _, value, action in SITE_RULES if action == "block")
OP4_SQL = f"""
WITH RECURSIVE p AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*/[^/?#]*/([0-9]+)', 1) AS number FROM pages),
q AS (SELECT url, 'http://' || regexp_extract({_sql_host("url")}, '([^.]+\\.[^.]+\\.[^.]+)$', 1) || '/n/' || number AS short, 'http://short.example/n/' || number AS every FROM p WHERE number <> ''),
l AS (SELECT url AS a, short AS b FROM q UNION SELECT short, every FROM q),
u AS (SELECT url FROM pages UNION SELECT a FROM l UNION SELECT b FROM l),
n AS (SELECT url, {_sql_normal("url")} AS normal FROM u),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT url, normal FROM n UNION SELECT normal, url FROM n),
v AS (SELECT url FROM n UNION SELECT normal FROM n),
r(node, seen) AS (SELECT url, url FROM v UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(seen) AS component, {_sql_host("node")} AS host FROM r GROUP BY node),
h AS (SELECT node, component, host = 'tionsh.example.net' OR host LIKE '%.tionsh.example.net' AS allowed, len(list_filter([{_DOMAINS}], lambda d: host = d OR host LIKE '%.' || d)) > 0 AS hit FROM m),
k AS (SELECT *, bool_or(hit AND NOT allowed) OVER (PARTITION BY component) AS blocked FROM h)
SELECT page_id, url, component, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'keep' END AS decision,
  CASE WHEN allowed OR (hit AND blocked) THEN 'rule' WHEN blocked THEN 'alias' END AS reason FROM pages JOIN k ON k.node = pages.url
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_intervals(shared.table(sf_dir, "documents", spark))


OP5_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, j, array_to_string(w[j + 1 : j + 50], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS j FROM w)),
o AS (SELECT doc_id, j, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id, j) AS nth FROM g),
m AS (SELECT doc_id, CASE WHEN nth = 1 THEN 'source' ELSE 'remove' END AS kind, j FROM o WHERE n > 1),
s AS (SELECT *, CASE WHEN j > lag(j) OVER (PARTITION BY doc_id, kind ORDER BY j) + 50 THEN 1 ELSE 0 END AS fresh FROM m),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, kind ORDER BY j) AS island FROM s)
SELECT doc_id, kind, min(j) AS first_word, max(j) + 50 AS end_word, max(j) + 50 - min(j) AS n_words FROM i GROUP BY doc_id, kind, island
"""


def op6_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media, so every row of ``embeddings`` is drawn as a video first."""
    return media.clips(media.drawn(shared.table(sf_dir, "embeddings", spark), "vec_id", "embedding"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(sf_dir, "documents", spark).select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


OP7_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
r AS (SELECT *, trim(line) = '' OR row_number() OVER (PARTITION BY line ORDER BY doc_id, no) = 1 AS stays FROM l)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE stays), '') AS text,
  CAST(count(*) FILTER (WHERE NOT stays) AS INTEGER) AS lines_removed FROM r GROUP BY doc_id
"""

def op8_capture_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no time of capture, so one within a year is made from page_id."""
    ts = F.lit(1_704_067_200) + F.pmod(F.col("page_id") * 7919, F.lit(31_536_000))
    return capture_index.merged_index(capture_index.captures(shared.table(sf_dir, "pages", spark), ts=ts))


OP8_SQL = """
WITH r AS (SELECT page_id AS id, 1704067200 + (page_id * 7919) % 31536000 AS ts, html, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages WHERE url IS NOT NULL),
h AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?#]*)', 1)), '^www\\.|:(80|443)$', '', 'g') AS host, regexp_replace(regexp_replace(rest, '^[^/?#]*', ''), '#.*$', '') AS path FROM r),
k AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END AS url_key FROM h)
SELECT row_number() OVER (ORDER BY url_key, ts, id) AS position, url_key, ts, row_number() OVER (PARTITION BY url_key ORDER BY ts, id) AS capture, id,
  CAST(strlen(html) AS BIGINT) AS length, md5(html) AS digest FROM k
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept documents with their scores."""
    out = quality.scored(shared.table(sf_dir, "documents", spark).select("doc_id", "text"))
    return out.where(out["quality_score"] >= quality.THRESHOLD).select("doc_id", "weak_label", "quality_score")


def op10_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters are the groups of near copies, exact ones included."""
    docs = shared.table(sf_dir, "documents", spark)
    return packing.pack(docs, groups=jaccard_join.groups(docs))


QUERIES: dict[str, Query] = {"op1_token_output": op1_token_output, "op2_decontamination": op2_decontamination, "op3_ngram_jaccard": op3_ngram_jaccard, "op4_url_filter": op4_url_filter, "op5_substring_dedup": op5_substring_dedup, "op6_avi_clips": op6_avi_clips, "op7_line_dedup": op7_line_dedup, "op8_capture_merge": op8_capture_merge, "op9_quality": op9_quality, "op10_bestfit_packing": op10_bestfit_packing}
ORACLE_SQL: dict[str, str] = {"op2_decontamination": OP2_SQL, "op3_ngram_jaccard": OP3_SQL, "op4_url_filter": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op7_line_dedup": OP7_SQL, "op8_capture_merge": OP8_SQL}
