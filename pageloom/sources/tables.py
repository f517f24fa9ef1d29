"""Sources and sinks: tables, files of fetched bodies, JSON, Markdown, and a keyed store of results.

A live fetch is left to the ingest; here a body is a row.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tables whose rows are wide and whose queries compute much for each.
WIDE = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in WIDE else df


def spread(df: DataFrame) -> DataFrame:
    """A table of files, dealt to all cores if it has fewer splits than the session has cores.  With as many splits as
    cores, as on a cluster, nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _splits(df) < cores else df


def _splits(df: DataFrame) -> int:
    """At least the splits that a table's files have: one each, more for large ones."""
    plan = df._jdf.queryExecution().optimizedPlan()
    most = int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(len(df.inputFiles()), int(str(plan.stats().sizeInBytes())) // most)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the folder that all executors share, the session's ``spark.checkpoint.dir``.

    Only a local session may be without that setting; it gets a temporary folder.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pageloom-"))
    return df.checkpoint()


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """(url, body) of files: HTML pages, robots.txt, sitemaps or feeds, one each; ``url`` is the file's address."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("body"))


def fetch_results(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of an external fetcher: url, html, status, content type, milliseconds and error."""
    return spark.read.schema("url string, html string, status int, content_type string, ms long, error string").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, column: str = "document", *by: str) -> None:
    """One column's texts, such as Markdown documents, by the values of other columns."""
    writer = df.select(column, *by).withColumnRenamed(column, "value").write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def file_key(key: Column | str) -> Column:
    """The name under which a result is kept: 16 digits of a hash of its key."""
    return F.substring(F.sha2(F.col(key) if isinstance(key, str) else key, 256), 1, 16)


def _shard(key: Column | str) -> Column:
    """The folder of a store that a key is in, of 256."""
    return F.concat(F.lit("k"), F.substring(file_key(key), 1, 2))


def remember(df: DataFrame, path: str, key: str, until: Column) -> None:
    """Adds results to a store of results that end at a time; the store has a folder for each of 256 parts of the keys."""
    kept = df.withColumns({"_key": file_key(key), "_until": until, "_shard": _shard(key)})
    kept.repartition("_shard").write.mode("append").partitionBy("_shard").parquet(path)


def forget(spark: SparkSession, path: str, to: str, key: str, now: Column) -> None:
    """Writes a store anew at ``to``: of each key the latest result, if it holds still."""
    kept = spark.read.parquet(path).where(F.col("_until") > now)
    best = W.partitionBy(key).orderBy(F.desc("_until"))
    kept = kept.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    kept.repartition("_shard").write.partitionBy("_shard").parquet(to)


def recall(wanted: DataFrame, path: str, key: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """What the store still holds of the wanted keys, the latest of each, and the keys that must be computed."""
    spark = wanted.sparkSession
    asked = wanted.select(key, _shard(key).alias("_shard")).distinct()
    kept = spark.read.parquet(path).where(F.col("_until") > now)
    # only the folders that are asked for are read, and of them only the rows of wanted keys go further
    mine = kept.join(asked.select(key, "_shard"), [key, "_shard"], "left_semi")
    best = W.partitionBy(key).orderBy(F.desc("_until"))
    held = mine.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_key", "_until", "_shard")
    return held, wanted.join(held.select(key), key, "left_anti")
