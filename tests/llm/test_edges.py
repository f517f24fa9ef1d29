"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pageloom.llm import capture_index, decontamination, jaccard_join, line_dedup, media, packing, quality, substring_dedup, token_output, url_filter
from pageloom.llm.shared import new_path

from tests.llm.data import LINE, LONG, PASSAGE, SCHEMA, hard, hard_rows, nothing

BENCHMARK = [(1, PASSAGE), (2, None), (None, "a b c d e f g h"), (3, "two words"), (4, ""), (1, PASSAGE)]


@pytest.fixture(scope="module")
def docs(spark):
    return hard(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return nothing(spark)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")


def test_line_dedup(spark, docs, empty):
    for limit in (1 << 20, 0):
        out = line_dedup.dedup_lines(docs, broadcast_limit=limit)
        assert out.columns == [*docs.columns, "_lines_removed"]
        rows = out.collect()
        by = Counter((r.doc_id, r.text) for r in rows)
        assert by[2, f"Second own line, with more.\n"] == 2  # its passage and first line are document 1's
        assert by[None, f"{LINE}\nNobody's line."] == 1
        assert by[4, None] == by[5, ""] == by[6, " \n\t \n"] == by[7, LONG] == by[8, "one"] == by[9, ""] == 1
        assert by[12, ""] == 1
        assert {r.kept_lines for r in rows} == {"k", None} and {r.Lines_Removed for r in rows} == {"L", None}
        assert line_dedup.dedup_lines(empty, broadcast_limit=limit).count() == 0


def test_substring_dedup(spark, docs, empty):
    found = {(r.doc_id, r.kind): (r.first_word, r.end_word) for r in substring_dedup.repeated_intervals(docs).where("doc_id <> 7").collect()}
    assert found[1, "source"] == (19, 79)
    assert found[2, "remove"] == (20, 80)
    assert (11, "remove") in found and (12, "remove") not in found
    out = substring_dedup.remove_repeats(docs.where("doc_id IS NULL OR doc_id <> 7"))
    assert out.columns == docs.columns
    rows = {r.doc_id: r.text for r in out.collect()}
    assert rows[2] == f"{LINE}\nSecond own line, with more.\n\n" and rows[4] is None and rows[None].endswith("line.")
    assert substring_dedup.repeated_intervals(empty).count() == substring_dedup.remove_repeats(empty).count() == 0


def test_jaccard_join(spark, docs, empty):
    rows = {r.doc_id: tuple(r)[1:] for r in jaccard_join.similar(docs).collect()}
    assert rows[8] == rows[9] == (8, 8, 0, 2)
    assert rows[1][0] == rows[2][0] == 1 and rows[1][2] > 0 and rows[1][3] == rows[2][3] == 1
    assert not {4, 5, 6, 7, None} & set(rows)
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[8] == 1 and ids[9] == 0 and ids[None] == 1 and ids[4] == ids[5] == ids[6] == ids[7] == 1
    assert jaccard_join.similar(empty).count() == jaccard_join.drop_near_copies(empty).count() == 0


def test_decontamination(spark, docs, empty, benchmark):
    rows = decontamination.contaminated_spans(docs, benchmark).collect()
    assert Counter(r.doc_id for r in rows) == {1: 1, 2: 2, 11: 2}
    assert {tuple(r["items"]) for r in rows} == {(1,)}
    out = decontamination.decontaminate(docs, benchmark, drop_share=0.9)
    assert out.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in out.collect()]
    assert (2, f"{LINE}\nSecond own line, with more.\n\n") in texts and (7, LONG) in texts and (4, None) in texts
    assert 11 not in dict(texts) and any(i is None for i, _ in texts)
    for d, b in ((empty, benchmark), (docs, benchmark.where("false")), (empty, benchmark.where("false"))):
        assert decontamination.contaminated_spans(d, b).count() == 0
        assert decontamination.decontaminate(d, b).count() == d.count()


def test_quality(spark, docs, empty):
    out = quality.scored(docs)
    assert out.columns == [*docs.columns, "_weak_label", "_quality_score"]
    rows = out.collect()
    assert len(rows) == len(hard_rows())
    scores = {r.doc_id: r["_quality_score"] for r in rows}
    assert scores[4] == scores[5] == scores[6] == 0 and all(0 <= s <= 1 for s in scores.values())
    assert len({r["_quality_score"] for r in rows if r.doc_id == 2}) == 1
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.scored(empty).count() == quality.keep_good(empty).count() == 0
    assert quality.keep_good(docs.where("doc_id IS NULL")).count() in (0, 1)


def test_packing(spark, docs, empty):
    rows = packing.pack(docs).collect()
    tokens = Counter()
    for r in rows:
        tokens[r.doc_id] += r.n_tokens
    assert not {4, 5, None} & set(tokens) and tokens[7] > 600_000
    bins = Counter()
    for r in rows:
        bins[r.bin] += r.n_tokens
        assert r.n_tokens <= packing.CAPACITY
    assert max(bins.values()) <= packing.CAPACITY
    assert len({r.bin for r in rows if r.doc_id == 2}) == 2  # repeated rows, never together
    assert packing.pack(empty).count() == 0
    assert packing.pack(docs, source=None, cluster="n_chars").count() > 0


def test_token_output(spark, docs, empty):
    path = new_path(spark, "tokens")
    rows = token_output.write_tokens(docs, path, length=64, batch=4).collect()
    assert len(rows) == len(hard_rows())
    by = {r.doc_id: r.n_tokens for r in rows}
    assert by[4] == by[5] == 0 and by[7] > 600_000 and by[None] > 0
    assert token_output.write_tokens(empty, new_path(spark, "tokens")).count() == 0


PAGES = [(1, "http://a.org/x", "<p>1</p>"), (2, "http://a.org/x", None), (None, "http://www.a.org/x/", ""), (4, None, "x"), (5, "", "x"), (6, " ", "x"), (1, "http://a.org/x", "<p>1</p>"), (8, "no url at all", "x"), (9, "http://b.org/" + "y" * 100_000, "z" * 3_000_000)]
PAGE_SCHEMA = "page_id long, url string, html string, node string, component string, ts int, id string, `range` int, position int"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "n", None, 1, "i", 2, 3) for p in PAGES], PAGE_SCHEMA)


def test_url_filter(spark, pages):
    rules = url_filter.rules_frame(spark, [("domain", "a.org", "block"), ("url", "http://b.org/z", "block"), (None, "b.org", "block"), ("domain", None, "block"), ("other", "b.org", "block")])
    edges = spark.createDataFrame([("http://a.org/x", None), (None, "q"), ("http://a.org/x", "http://a.org/x"), ("no url at all", "http://a.org/x")], "src string, dst string")
    rows = url_filter.decide(pages, rules, edges).collect()
    assert len(rows) == len(PAGES)
    decisions = Counter((r.page_id, r.decision, r.reason) for r in rows)
    assert decisions[1, "block", "rule"] == 2 and decisions[None, "block", "rule"] == 1 and decisions[8, "block", "alias"] == 1
    assert decisions[4, "keep", None] == decisions[5, "keep", None] == decisions[6, "keep", None] == decisions[9, "keep", None] == 1
    assert {r.component for r in rows if r.page_id in (4, 5, 6)} == {None}
    assert url_filter.decide(pages.where("false"), rules).count() == 0
    assert url_filter.decide(pages, rules.where("false")).where("decision <> 'keep'").count() == 0


def test_capture_index(spark, pages):
    found = capture_index.captures(pages, ts=F.when(F.col("page_id") != 2, F.col("page_id")))
    rows = capture_index.merged_index(found, run_rows=2, range_rows=2, least_rows=1).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, len(PAGES)))
    mine = [r for r in rows if r.url_key == "org,a)/x"]
    assert [r.id for r in mine] == [2, 1, 1] and [r.capture for r in mine] == [1, 2, 3] and mine[0].digest is None and mine[0].length == 0
    assert capture_index.merged_index(found.where("false")).count() == 0


def test_media(spark):
    good, begins = media.draw(1, [0.1, -0.4, 0.3])
    table = spark.createDataFrame([(1, good, "a"), (1, good, "a"), (None, good, "b"), (3, None, None), (4, b"", "c"), (5, b"RIFF", "d"), (6, good[:200], "e"), (7, b"\xff" * 2_000_000, "f")], "media_id long, content binary, clip string")
    rows = media.clips(table).collect()
    n = Counter(r.media_id for r in rows)
    assert n[1] == 2 * len(begins) and n[None] == len(begins)
    assert all(r.error and r.clip is None for r in rows if r.media_id in (3, 4, 5, 6, 7))
    assert media.clips(table.where("false")).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage(spark, docs, empty, benchmark, tmp_path, k):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    for given in (docs, empty):
        out = stage(spark, given, str(tmp_path))
        rows = out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == given.columns and out.dtypes == given.dtypes
            assert all(r.n_chars is None or r.n_chars == len(r.text) for r in rows if r.text is not None and k in (1, 3))
        assert rows or given is empty or k == 0


def test_schema_clashes_on_purpose():
    assert "Lines_Removed" in SCHEMA
