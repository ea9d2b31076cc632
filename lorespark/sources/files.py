"""Items from a directory of text files, and inline items."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators.access import EVERYONE

ITEM = "seq long, source string, source_id string, workspace string, text string, allowed_principals array<string>, occurred_at timestamp"


def read_dir(spark: SparkSession, path: str, workspace: str, principals: list[str] | None = None) -> DataFrame:
    """An item for each .md and .txt file below path (any case), read whole, its time that of the file.

    On a local folder links and whatever resolves outside it are refused; other stores have no links.
    """
    if "://" not in path or path.startswith("file://"):
        root = os.path.realpath(path.removeprefix("file://"))
        for folder, names, files in os.walk(root):
            for name in names + files:
                full = os.path.join(folder, name)
                if os.path.islink(full) or not os.path.realpath(full).startswith(root + os.sep):
                    raise ValueError(f"{full} is a link or lies outside {root}")
        path = f"file://{root}"
    read = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt,MD,TXT,Md,Txt}").load(path)
    name = F.substring(F.col("_metadata.file_path"), F.length(F.lit(path.replace("file://", "file:"))) + 1, F.lit(1 << 20))
    listed = read.select(F.xxhash64("_metadata.file_path").alias("seq"), F.lit("local").alias("source"), F.regexp_replace(name, "^/+", "").alias("source_id"), F.lit(workspace).alias("workspace"), F.col("value").alias("text"), F.array(*map(F.lit, principals or [EVERYONE])).alias("allowed_principals"), F.col("_metadata.file_modification_time").alias("occurred_at"))
    return listed


def inline_items(spark: SparkSession, items: list[dict], workspace: str, as_of) -> DataFrame:
    """Items given as dicts with source, source_id, text and optional allowed_principals."""
    rows = [(n, x["source"], x["source_id"], workspace, x["text"], x.get("allowed_principals") or [EVERYONE], as_of) for n, x in enumerate(items)]
    return spark.createDataFrame(rows, ITEM)
