"""URL, text and quality functions, with the reference's known assertions and quirks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pageloom.functions import quality, text, urls
from pageloom.operators import chunks, cleaning


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(fn(F.col("v")).alias("r")).first()[0]


def many(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_url_types(spark):
    cases = {
        "https://x.org/2024/12/30/some-title": "article",
        "https://x.org/blog/a-rather-long-article-slug": "article",
        "https://x.org/p/abc123": "article",
        "https://x.org/": "listing",
        "https://x.org": "listing",
        "https://x.org/blog/": "listing",
        "https://x.org/page/2": "listing",
        "https://x.org/category/tech": "listing",
        "https://x.org/a?page=3": "listing",
        "https://x.org/about": "unknown",
        "https://x.org/a/one-two-three-four": "article",
        "https://x.org/a/12345678901234567": "unknown",
        "no url": "unknown",
        None: "unknown",
    }
    assert many(spark, cases, urls.url_type) == list(cases.values())


def test_normalize(spark):
    cases = {
        "https://X.org/a/?utm_source=1&real=2": "https://x.org/a?real=2",
        "https://x.org/?b=2&a=1&ref=q": "https://x.org/?a=1&b=2",
        "https://x.org/a/#top": "https://x.org/a#top",
        "https://x.org/?source=1": "https://x.org/",
        "https://x.org": "https://x.org/",
        "not a url": "not a url",
        None: None,
    }
    assert many(spark, cases, urls.normalize) == list(cases.values())


def test_domains(spark):
    assert many(spark, ["https://sub.Example.com/path", "http://u:p@h.org:80/", "nothing", None], urls.domain) == ["sub.example.com", "h.org", None, None]
    assert many(spark, ["http://a", "HTTPS://b/c", "ftp://x", "", None], urls.is_valid) == [True, True, False, False, False]


def test_deny_has_no_slash(spark):
    """A pattern with /* denies what only begins alike."""
    cases = {"https://x.org/developers": True, "https://x.org/de/a": True, "https://x.org/news/a": False, "https://x.org/": True, "https://x.org/privacy": True, "https://x.org/privacy/x": False, "bad": False, None: False}
    assert many(spark, cases, urls.denied) == list(cases.values())
    assert len(urls.DENIED) == 66


def test_locales(spark):
    cases = {"/en/a": True, "/ai": True, "/en-gb": True, "/en-us/x": False, "/EN-US": False, "/blog/x": False, "/fr-be/": True}
    assert many(spark, cases, urls.foreign_locale) == list(cases.values())


def test_path_filters(spark):
    df = spark.createDataFrame([(u,) for u in ("https://x.org/news/a", "https://x.org/news", "https://x.org/newsroom", "https://x.org/de/news/a", "https://x.org/tag/x", "junk")], "url string")
    kept = lambda **k: sorted(r.url for r in urls.apply_path_filters(df, **k).collect())
    assert kept(allow=["/news/*"]) == ["https://x.org/news", "https://x.org/news/a", "junk"]
    assert kept(deny=["/news*"]) == ["https://x.org/tag/x", "junk"]
    assert len(kept(allow=["/news/*"], skip_allow=True)) == 5


def test_guards_and_titles(spark):
    bad = ["http://localhost/", "http://127.0.0.1", "http://10.1.1.1/x", "http://192.168.0.1", "http://172.20.1.1", "http://[::1]/", "http://[fe80::1]/", "http://a.internal/", "ftp://x.org", None]
    assert many(spark, bad, urls.private_host) == [True] * len(bad)
    assert many(spark, ["https://x.org/a", "http://172.32.1.1/", "http://11.0.0.1"], urls.private_host) == [False] * 3
    assert many(spark, ["https://x.org/my-first_page.html", "https://x.org/", None], urls.title) == ["My First Page", "X.org", "Untitled Article"]
    assert many(spark, ["https://x.org/NEWS/today", "https://x.org/shop/", "https://x.org/", "https://x.org/ab"], urls.inferred_allow) == ["/news/*", "/shop/*", None, None]


def test_sections(spark):
    df = spark.createDataFrame([(f"https://x.org/{s}/{k}",) for s, n in (("blog", 5), ("press", 3), ("post", 2), ("shop", 9)) for k in range(n)], "url string")
    found = urls.content_sections(df)
    assert [tuple(r) for r in found.collect()] == [("/blog", 5), ("/press", 3)]
    assert urls.in_sections(df, found).count() == 8
    assert urls.in_sections(df, found.where("false")).count() == df.count()


def test_entities(spark):
    given = "a&nbsp;b &amp;lt; &ldquo;q&rdquo; &#65;&#x42;&#X43; &#8212; &unknown;"
    want = 'a b < "q" ABC — &unknown;'
    assert one(spark, given, text.decode_entities) == want == cleaning.decode_entities(given)


def test_strip_html_glues(spark):
    html = "<p>one</p><p>two</p><script>var a='<b>';</script> <STYLE>x{}</STYLE>three"
    assert one(spark, html, text.strip_html) == "onetwo three" == cleaning.strip_html(html)


def test_cleaning_agrees(spark):
    samples = ["", "  a \t b  ", "This is a line of more than forty characters.\nNext line is long enough too.\n\n\n\nx", "&#039;x&#039; y", "a\n\n\nb\n \nc"]
    assert many(spark, samples, text.clean_text) == [cleaning.clean_text(s) for s in samples]


def test_truncate_and_excerpt(spark):
    assert one(spark, "one two three", lambda c: text.truncate(c, 9)) == "one two…"
    assert one(spark, "abcdefghij", lambda c: text.truncate(c, 4)) == "abcd…"
    assert one(spark, "short", lambda c: text.truncate(c, 9)) == "short"
    assert one(spark, "x" * 201, text.excerpt) == "x" * 200 + "..."
    assert one(spark, "x", lambda c: text.excerpt(c, 300, True)) == "x..."


def test_tokens_and_grade(spark):
    samples = ["", None, "see https://x.org now 123 456 é", "```code``` and text", "abcd" * 10, "a 😀 b"]
    got = many(spark, samples, text.estimate_tokens)
    assert got == [chunks.estimate_tokens(s or "") for s in samples] and got[0] == got[1] == 0
    assert one(spark, "", text.reading_grade) == 0.0 and one(spark, "Cat sat.", text.reading_grade) >= 0
    levels = many(spark, ["5", "5.1", "8", "12", "13"], lambda c: text.reading_level(c.cast("double")))
    assert levels == ["elementary", "intermediate", "intermediate", "advanced", "expert"]
    assert many(spark, ["table", "the", "", "a  b", "queue"], text.syllable_count) == [2, 1, 1, 2, 1]
    assert one(spark, " a  b ", text.word_count) == 2


def test_formats(spark):
    n = lambda fn: lambda c: fn(c.cast("long"))
    assert many(spark, ["500", "1536", "1572864"], n(text.format_bytes)) == ["500B", "1.5KB", "1.5MB"]
    assert many(spark, ["500", "2500", "125000"], n(text.format_duration)) == ["500ms", "2.5s", "2m 5s"]


def test_clean_for_llm(spark):
    given = "Menu items\r\nReal text here. Read more.\n\n\n\nShare this\nEnd [Click here]"
    assert one(spark, given, text.clean_for_llm) == "Real text here.\n\n\nEnd"


def test_dates(spark):
    good = ["2024-01-15", "2024-01-15T10:20:30Z", "Mon, 15 Jan 2024 10:20:30 GMT", "15 Jan 2024 10:20:30 +0000", "January 5, 2024", "1/5/2024"]
    got = many(spark, good, text.parse_date)
    assert all(got) and {str(d)[:10] for d in got} == {"2024-01-15", "2024-01-05"}
    assert many(spark, ["soon", "", None, "2024-13-45"], text.parse_date) == [None] * 4


def test_kinds(spark):
    assert many(spark, ["http://x", "<p>a</p>", "plain < text >", "words"], text.input_type) == ["url", "html-string", "unsupported", "unsupported"]
    assert many(spark, ["application/atom+xml", "application/rdf+xml", "text/xml"], text.feed_type) == ["atom", "rdf", "rss"]


def test_frontmatter(spark):
    got = one(spark, 'A "b"\nc', lambda c: text.frontmatter(c, F.lit("u"), F.lit(3), F.lit(1), F.lit(4), author=F.lit(""), site=F.lit("S")))
    assert got == '---\ntitle: "A \\"b\\" c"\nurl: u\nsource: "S"\nword_count: 3\nreading_time: 1\ntokens: 4\n---\n'


@pytest.mark.parametrize(("body", "title", "html", "valid", "score", "n"), [("x" * 300, "A fine title", "x" * 400, True, 1.0, 0), ("x", "A fine title", "x", True, 0.5, 1), ("x", "t", "x", False, 0.3, 2), ("x" * 300, "t", "x" * 9000, True, 0.6, 2), (None, None, None, False, 0.3, 2)])
def test_validate(spark, body, title, html, valid, score, n):
    df = spark.createDataFrame([(body, title, html)], "b string, t string, h string")
    r = df.select(quality.validate(F.col("b"), F.col("t"), F.col("h")).alias("r")).first()[0]
    assert (r.is_valid, round(r.score, 9), len(r.reasons)) == (valid, score, n)


def test_score(spark):
    df = spark.createDataFrame([("x" * 300, "A fine title", "x" * 400)], "b string, t string, h string")
    args = (F.col("b"), F.col("t"), F.col("h"))
    assert df.select(quality.score(*args)).first()[0] == 0.6
    full = df.select(quality.score(*args, published=F.lit("d"), byline=F.lit("b"), schema_type=F.lit("Article"), minutes=F.lit(2))).first()[0]
    assert round(full, 9) == 1.0
    least = spark.createDataFrame([("x", "t", "x")], "b string, t string, h string").select(quality.score(*args, published=F.lit("d"))).first()[0]
    assert least >= 0.3 - 1e-12


def test_duplicates(spark):
    assert one(spark, "Other words here. The same sentence here. The same sentence here. ", quality.duplicate_ratio) > 0
    assert one(spark, "", quality.duplicate_ratio) == 0


def test_values_are_computed_once(spark):
    """What a text is made of stands once in the plan, or a lambda or branch computes it again for each use."""
    row = spark.createDataFrame([("a &amp; b. The table is a queue.", "Title of it")], "t string, h string")
    made = F.regexp_replace("t", "MARKER", "")
    for name, c in {
        "clean_text": text.clean_text(made),
        "decode_entities": text.decode_entities(made),
        "reading_level": text.reading_level(text.reading_grade(made)),
        "estimate_tokens": text.estimate_tokens(made),
        "word_count": text.word_count(made),
        "validate_extracted": quality.validate_extracted(made, F.col("h"), F.col("t")),
    }.items():
        plan = row.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MARKER") == 1, name


def test_grade_of_whole_texts_is_that_of_words(spark):
    """Counting over a whole text gives what counting word by word gives."""
    import random
    import re

    space = re.compile("[\\s﻿]+")

    def syllables(word):
        w = re.sub("[^a-z]", "", word)
        if len(w) <= 3:
            return 1
        n = max(len(re.findall("[aeiouy]+", w)), 1)
        return max(n - (w.endswith("e") and n > 1) + bool(re.search("[^aeiouy]le$", w)), 1)

    r = random.Random(9)
    bits = ["table", "tree", "queue", "ylie", "Trie", "Mmmh", "stle", "aisle", "hole", "e", "le", "a-b", "dont", "22", "été", "Kelle", " ", " ", "\n\n", "\t ", ".", "?!"]
    given = ["", " ", "\n a  "] + ["".join(r.choice(bits) + " " * r.randint(0, 1) for _ in range(r.randint(0, 30))) for _ in range(300)]
    assert many(spark, given, text.syllable_count) == [sum(map(syllables, space.split(s.lower()))) for s in given]
    assert many(spark, given, text.word_count) == [len([w for w in space.split(s) if w]) for s in given]


def test_pairs_of_large_groups(spark):
    """Pairs of a group larger than its blocks are all there, once, and no task has a group of many blocks to itself."""
    rows = [("g", k) for k in range(50)] + [("h", 1), ("h", 3), ("h", 3), (None, 7), (None, 8), ("g", None), ("i", 9)]
    df = spark.createDataFrame(rows, "g string, k long")
    made = urls.pairs(df, "g", "k", block=4)
    assert sorted(map(tuple, made.collect())) == sorted([(a, b) for a in range(50) for b in range(a + 1, 50)] + [(1, 3), (1, 3)])
    sizes = [n for n in made.rdd.glom().map(len).collect()]
    assert len(sizes) >= 4 and max(sizes) < sum(sizes) * 0.6
    assert urls.pairs(df.where("false"), "g", "k").count() == 0
