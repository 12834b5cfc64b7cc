"""Files as a source: size limit, hash, a structural check, and import without repeats."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 100 * 1024 * 1024
_PAGES = re.compile(rb"/Type\s*/Pages?\b")


def looks_like_pdf(content: bytes) -> bool:
    """Header, page tree and end mark are there. Page trees inside compressed object streams are taken on trust."""
    if not content[:1024].lstrip().startswith(b"%PDF-") or b"%%EOF" not in content[-2048:]:
        return False
    return bool(_PAGES.search(content)) or b"/ObjStm" in content


def read_uploads(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, name, bytes, sha256, error) of every file. The length is filtered before content is read; a file that is
    too large or no document has an error and no hash. Empty files are not listed by the file source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = files.where(F.col("length") > most_bytes).select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("sha256"), F.lit("too large").alias("error"))

    def check(batches):
        for b in batches:
            good = [looks_like_pdf(c) for c in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([None if g else "not a document" for g in good], pa.string())], names=["path", "bytes", "sha256", "error"])

    fit = files.where(F.col("length") <= most_bytes).select("path", F.col("length").alias("bytes"), "content", F.sha2("content", 256).alias("sha256"))
    checked = fit.mapInArrow(check, "path string, bytes long, sha256 string, error string")
    both = checked.withColumn("sha256", F.when(F.col("error").isNull(), F.col("sha256"))).unionByName(large)
    return both.select("path", upload_name(F.element_at(F.split("path", "/"), -1)).alias("name"), "bytes", "sha256", "error")


def upload_name(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"(?i)\.pdf$", "")


def import_new(uploads: DataFrame, revisions: DataFrame) -> DataFrame:
    """Uploads to store: without error, each hash once (the smallest path), none that a revision has."""
    good = uploads.where("error IS NULL").groupBy("sha256").agg(F.min_by(F.struct("path", "name", "bytes"), "path").alias("u")).select("sha256", "u.*")
    return good.join(revisions.select(F.col("pdf_sha256").alias("sha256")), "sha256", "left_anti")
