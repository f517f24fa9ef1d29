"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.sources import tables


def test_bodies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<p>one\ntwo</p>")
    (tmp_path / "in" / "robots.txt").write_text("User-agent: *\nDisallow: /x")
    got = {r.url.rsplit("/", 1)[1]: r.body for r in tables.bodies(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.html": "<p>one\ntwo</p>", "robots.txt": "User-agent: *\nDisallow: /x"}


def test_json_and_text(spark, tmp_path):
    df = spark.createDataFrame([("u1", "<p>1</p>", 200, "text/html", 5, None), ("u2", None, 500, None, 7, "bad")], "url string, html string, status int, content_type string, ms long, error string")
    tables.write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, tables.fetch_results(spark, str(tmp_path / "j")).collect())) == sorted(map(tuple, df.collect()))
    tables.write_text(df.withColumn("document", F.concat(F.lit("# "), "url")), str(tmp_path / "t"), "document", "status")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["# u1", "# u2"]


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    at = lambda s: F.timestamp_seconds(F.lit(s))
    df = spark.createDataFrame([("a", 1), ("b", 2)], "url string, v int")
    tables.remember(df, path, "url", at(100))
    tables.remember(df.where("url = 'a'").withColumn("v", F.lit(9)), path, "url", at(200))
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    held, due = tables.recall(wanted, path, "url", at(50))
    assert {tuple(r) for r in held.collect()} == {("a", 9), ("b", 2)} and [r.url for r in due.collect()] == ["c"]
    held, due = tables.recall(wanted, path, "url", at(150))
    assert [r.v for r in held.collect()] == [9] and due.count() == 2


def test_store_is_written_anew(spark, tmp_path):
    path, to = str(tmp_path / "store"), str(tmp_path / "new")
    at = lambda s: F.timestamp_seconds(F.lit(s))
    df = spark.createDataFrame([("a", 1), ("b", 2)], "url string, v int")
    for k in (100, 200, 300):
        tables.remember(df.where(f"url = 'a' OR {k} = 100").withColumn("v", F.col("v") + k), path, "url", at(k))
    tables.forget(spark, path, to, "url", at(150))
    assert [(r.url, r.v) for r in spark.read.parquet(to).collect()] == [("a", 301)]
    held, due = tables.recall(df, to, "url", at(150))
    assert [(r.url, r.v) for r in held.collect()] == [("a", 301)] and [r.url for r in due.collect()] == ["b"]


def test_spread(spark):
    df = tables.table(spark, "/root/testdata/sf0.001", "documents")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert tables.table(spark, "/root/testdata/sf0.001", "events").rdd.getNumPartitions() == 1
