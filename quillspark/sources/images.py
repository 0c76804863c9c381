"""Image links of Markdown texts and their files as data URLs: one join by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.sources import filetype

TARGET = r"!\[[^\]]*\]\((?:<([^>]+)>|([^)]+))\)"


def targets(text: Column) -> Column:
    """Distinct link targets in order, without titles and angle brackets."""
    whole = F.regexp_extract_all(text, F.lit(T.IMAGE), 0)
    one = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, TARGET, 1), F.lit("")), F.regexp_replace(T.strip(F.regexp_extract(x, TARGET, 2)), r"""\s+["'].*$""", ""))
    return F.array_distinct(F.transform(whole, one))


def is_local(target: Column) -> Column:
    return ~target.rlike(r"(?i)^(?:[a-z][a-z0-9+.-]+:|//|#)")


def resolved(target: Column, document: Column) -> Column:
    """The address of a local target, from its document's address; null for others."""
    folder = F.regexp_extract(document, r"^(.*/)[^/]*$", 1)
    path = F.when(target.startswith("/"), target).otherwise(F.concat(folder, F.regexp_replace(target, r"^(?:\./)+", "")))
    for _ in range(8):  # so many steps up at most
        path = F.regexp_replace(path, r"[^/]+/\.\./", "")
    return F.when(is_local(target), path)


def data_url(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), filetype.media_type(path), F.lit(";base64,"), F.base64(content))


def data_urls(texts: DataFrame, files: DataFrame, keys: list[str], text: str, document: str) -> DataFrame:
    """keys, target, url for each link whose file is there; url of data links is the target itself.

    files: path, content (as binaryFile gives them).
    """
    links = texts.select(*keys, F.explode(targets(F.col(text))).alias("target"), F.col(document).alias("_document"))
    links = links.withColumn("path", resolved(F.col("target"), F.col("_document"))).drop("_document")
    joined = links.join(files.select("path", data_url(F.col("path"), F.col("content")).alias("found")), "path", "left")
    url = F.when(F.col("target").startswith("data:"), F.col("target")).otherwise(F.col("found"))
    return joined.select(*keys, "target", url.alias("url")).filter("url IS NOT NULL")
