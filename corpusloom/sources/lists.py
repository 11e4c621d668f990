"""Lists kept as text: links, links with a register, prompts, locks and numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import strip


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines of a text file or folder."""
    return spark.read.text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``n, line``: the lines of one small file with their numbers from 0; the file is read whole."""
    d = spark.read.text(path, wholetext=True)
    return d.select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))


def links(lines: DataFrame) -> DataFrame:
    """``url``: what stands before a number sign, if anything."""
    return lines.select(strip(F.substring_index("value", "#", 1)).alias("url")).filter("url <> ''")


def registered_links(lines: DataFrame) -> DataFrame:
    """``url, register``: whole lines that begin with a number sign are left out; the register is unknown if not given."""
    kept = lines.filter((strip(F.col("value")) != "") & ~strip(F.col("value")).startswith("#"))
    cols = F.split("value", "\t")
    given = strip(F.coalesce(F.get(cols, F.lit(1)), F.lit("")))
    return kept.select(strip(cols[0]).alias("url"), F.when(given == "", "unknown").otherwise(given).alias("register"))


def prompts(lines: DataFrame) -> DataFrame:
    """``transcript, roman``: parted at the first tab; comments and empty prompts are left out."""
    cols = F.split("value", "\t", 2)
    d = lines.filter(~F.col("value").startswith("#")).select(strip(cols[0]).alias("transcript"), strip(F.coalesce(F.get(cols, F.lit(1)), F.lit(""))).alias("roman"))
    return d.filter("transcript <> ''")


def lock(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """The names in a lock file. A missing file is an error: no lock must not mean nothing is locked."""
    return read_lines(spark, path).select(strip(F.col("value")).alias(name)).filter(F.col(name) != "")
