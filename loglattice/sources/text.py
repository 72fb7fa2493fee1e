"""Lines of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.state import By, State


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(_raw, _ord): each line, cut at \\n only, with what isn't UTF-8 replaced; and its place.

    The place is the file's name, then a number that grows within the file: files are read in the order of their
    names. Large files are split, and read by many tasks.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.make_valid_utf8("value").alias("_raw"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("_ord"))


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of files as they arrive in a folder."""
    return spark.readStream.option("lineSep", "\n").text(folder).select(F.make_valid_utf8("value").alias("_raw"))


def state(rows: DataFrame, options) -> State:
    order = (By(F.col("_ord")),) if "_ord" in rows.columns else ()
    return State(rows, {}, "_raw", order, options=options)
