"""Nested documents: odds and score JSON, and XML feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ODDS = "id string, commence_time string, home_team string, away_team string, bookmakers array<struct<key:string, last_update:string, markets:array<struct<key:string, outcomes:array<struct<name:string, price:double, point:double>>>>>>"
SCORES = "id string, completed boolean, home_team string, away_team string, scores array<struct<name:string, score:string>>"


def flatten_odds(payload: DataFrame, column: str = "payload") -> DataFrame:
    """One row an outcome from event, bookmaker, market and outcome arrays."""
    x = payload.select(F.from_json(column, ODDS).alias("e")).select("e.*")
    x = x.select("id", "commence_time", "home_team", "away_team", F.explode("bookmakers").alias("b"))
    x = x.select("id", "commence_time", "home_team", "away_team", F.col("b.key").alias("book"), "b.last_update", F.explode("b.markets").alias("m"))
    return x.select("id", "commence_time", "home_team", "away_team", "book", "last_update", F.col("m.key").alias("market"), F.explode("m.outcomes").alias("o")).select("id", "commence_time", "home_team", "away_team", "book", "last_update", "market", F.col("o.name").alias("outcome"), F.col("o.price").alias("price"), F.col("o.point").alias("point"))


def parse_scores(payload: DataFrame, column: str = "payload") -> DataFrame:
    """(id, status, home_goals, away_goals): scores are found by the team's name, never by place. Status is open,
    settled, or no_score for a finished event without both scores."""
    x = payload.select(F.from_json(column, SCORES).alias("e")).select("e.*")

    def score(team: Column) -> Column:
        return F.get(F.filter("scores", lambda s: s["name"] == team), 0)["score"].try_cast("int")

    h, a = score(F.col("home_team")), score(F.col("away_team"))
    status = F.when(~F.coalesce("completed", F.lit(False)), "open").when(h.isNull() | a.isNull(), "no_score").otherwise("settled")
    return x.select("id", status.alias("status"), F.when(status == "settled", h).alias("home_goals"), F.when(status == "settled", a).alias("away_goals"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(link, title, claimed, is_source_provided) of RSS items. Items without a date have no claim."""
    schema = "title string, link string, guid string, pubDate string, description string"
    x = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    claimed = F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))
    return x.select("link", "title", claimed.alias("claimed"), claimed.isNotNull().alias("is_source_provided"))


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of ``url`` rows. An index of sitemaps, a file without rows and a row without a date are errors."""
    if not spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path).isEmpty():
        raise ValueError("an index of sitemaps isn't a sitemap")
    x = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    bad = x.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lastmod").isNull()).alias("undated")).first()
    if not bad["n"] or bad["undated"]:
        raise ValueError(f"{bad['n']} rows, {bad['undated']} without a date")
    return x.select("loc", F.try_to_timestamp("lastmod").alias("lastmod"))


def scan_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """(file, urls, undated, verdict) of every file below a folder: ``index`` for an index of sitemaps, ``empty`` without
    rows, ``undated`` if a row has no date, else ``ok``; so a faulty file is a row and doesn't stop the others."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", True).schema(schema).load(path).withColumn("file", F.col("_metadata.file_path"))
    rows = read("url", "loc string, lastmod string").groupBy("file").agg(F.count(F.lit(1)).alias("urls"), F.count_if(F.col("lastmod").isNull()).alias("undated"))
    index = read("sitemap", "loc string").select("file").distinct().withColumn("index", F.lit(True))
    # Only names are read here, no contents.
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("file"))
    x = every.join(rows, "file", "left").join(index, "file", "left").withColumns({"urls": F.coalesce("urls", F.lit(0).cast("long")), "undated": F.coalesce("undated", F.lit(0).cast("long"))})
    verdict = F.when(F.col("index"), "index").when(F.col("urls") == 0, "empty").when(F.col("undated") > 0, "undated").otherwise("ok")
    return x.select("file", "urls", "undated", verdict.alias("verdict"))
