"""Catalogues of files, local or in an object store, as DataFrames.

The binary file source lists and reads in parallel; what a catalogue needs
(extension, size limit, checksum, order) is column expressions over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("txt", "md", "html", "htm")


def extension(path: str = "path"):
    """The extension of a path in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def catalogue(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, max_bytes: int = 50_000_000, recursive: bool = True) -> DataFrame:
    """(external_ref, path, modified, size, ext, checksum, content) of the files that may be ingested, one row for a path.

    Files of other kinds and files above the limit are left out before their
    content is read; links out of the root aren't followed by the source.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
        .where((F.col("length") <= max_bytes) & extension().isin(*extensions))
        .dropDuplicates(["path"])
    )
    base = root.rstrip("/")
    ref = F.regexp_replace("path", r"^.*?\Q" + base + r"\E/", "")
    return files.select(
        ref.alias("external_ref"), "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), extension().alias("ext"),
        F.sha2("content", 256).alias("checksum"), "content",
    )


def scan_summary(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, max_bytes: int = 50_000_000) -> DataFrame:
    """(scanned, accepted, skipped, bytes) of a tree; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    ok = (F.col("length") <= max_bytes) & extension().isin(*extensions)
    return files.agg(
        F.count("*").alias("scanned"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("skipped"),
        F.coalesce(F.sum(F.when(ok, F.col("length"))), F.lit(0)).alias("bytes"),
    )


def as_markdown(files: DataFrame) -> DataFrame:
    """(external_ref, checksum, markdown): decoded text; bytes that aren't UTF-8 are left out; HTML is converted."""
    from loomspark.sources.html import to_markdown

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [bytes(c).decode("utf-8", "ignore") for c in pdf["content"]]
            md = [to_markdown(t) if e in ("html", "htm") else t for t, e in zip(text, pdf["ext"], strict=True)]
            yield pd.DataFrame({"external_ref": pdf["external_ref"], "checksum": pdf["checksum"], "markdown": md})

    return files.select("external_ref", "checksum", "ext", "content").mapInPandas(decode, "external_ref string, checksum string, markdown string")
