"""Evaluation files as tables: sample lists, judgements, parser output that is cached by hash."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JUDGEMENT = "map<string,struct<excerpt:string,page:int,parser:string,score:int,first_pos:int,last_pos:int,anchor_label:string,verdict:string,boundaries:string,source:string,note:string,at:string>>"


def read_judgements(spark: SparkSession, *paths: str) -> DataFrame:
    """(key, file, ...) of JSON files that map keys to judgements; of equal keys the last file (by name) wins."""
    raw = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", JUDGEMENT, {"mode": "FAILFAST"}).alias("m"))
    rows = raw.select("file", F.explode("m").alias("key", "j"))
    last = rows.groupBy("key").agg(F.max_by(F.struct("file", "j"), "file").alias("r"))
    return last.select("key", "r.file", "r.j.*")


def read_sample(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sources, excerpts) of a TOML list. An excerpt must name a source and lie within its pages."""
    found = tomllib.loads(spark.read.text(path, wholetext=True).first()[0])
    sources = [(s["name"], s["sha256"], int(s["pages"]), s.get("license"), s.get("url")) for s in found.get("source", [])]
    pages = {s[0]: s[2] for s in sources}
    excerpts = [(e["name"], e["source"], int(e["first_page"]), int(e["last_page"]), e.get("stresses")) for e in found.get("excerpt", [])]
    for name, source, first, last, _ in excerpts:
        if source not in pages or not 1 <= first <= last <= pages[source]:
            raise ValueError(f"excerpt {name}: pages {first}-{last} of {source}")
    return (
        spark.createDataFrame(sources, "name string, sha256 string, pages int, license string, url string"),
        spark.createDataFrame(excerpts, "name string, source string, first_page int, last_page int, stresses string"),
    )


def cached_output(wanted: DataFrame, cache: DataFrame, parser: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of files in the store of parser output, which is keyed by parser, version and hash."""
    own = cache.where((F.col("parser") == parser) & (F.col("parser_version") == version)).select("sha256", "raw")
    return wanted.join(own, "sha256"), wanted.join(own.select("sha256"), "sha256", "left_anti")
