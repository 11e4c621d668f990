"""Reproducible sample that only gains members as data grows: randomised block selection.

Every unit has a persistent sequence number. Numbers fall into fixed blocks, and the hash of the
block's number alone decides which of its positions are chosen, whether they are filled yet or
not. So membership is a function of the unit's number: partitioning, order and other rows play no
part. A whole-number column is its own sequence; keys such as ids and sources get theirs from a
register to which new keys are only ever appended, so blocks fill up one after the other and
every full block gives its quota.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import key

BLOCK = 128
#: New keys that are numbered together at a time.
BUCKET = 4096


def _hex_number(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def chosen(number: Column, take: int, block: int = BLOCK, seed: str = "sample-1") -> Column:
    """Whether the number's position is one of the ``take`` chosen in its block of ``block``.

    The block's hash gives an odd factor and an offset, which permute the positions (``block`` is a
    power of two); the first ``take`` of the permutation are chosen. A larger ``take`` keeps all
    members of a smaller one.
    """
    if block & (block - 1) or not 0 <= take <= block:
        raise ValueError("block must be a power of two that is not less than take")
    number_of_block = F.floor(number / block)
    digest = F.md5(F.concat_ws(":", F.lit(seed), number_of_block.cast("string")).cast("binary"))
    factor, offset = _hex_number(digest, 1, 6) * 2 + 1, _hex_number(digest, 8, 6)
    return (F.pmod(number, F.lit(block)) * F.pmod(factor, F.lit(block)) + offset) % block < take


def registered(df: DataFrame, unit: str, order: str = "row_no", register: DataFrame | None = None) -> DataFrame:
    """``unit_key, sample_number``: ``register`` with the keys of ``df`` that it lacks appended.

    Keys are compared without blanks and case; null and blank ones have no number. New keys are
    numbered on from the register's last number in the order in which ``df`` has them first (by
    ``order``, whole numbers, nulls last; then by key). Without a register numbers begin at 0, and as long as later rows have a
    greater ``order`` the result is the same as that of a register kept from load to load; where
    rows may come late, write the result and pass it to the next load. One row per key is moved
    and numbered in buckets of ``order``, so that neither a hot key nor the number of keys is one
    task's work. An empty table adds nothing.
    """
    first = df.select(key(F.col(unit)).alias("unit_key"), F.col(order).cast("long").alias("o")).filter("unit_key IS NOT NULL").groupBy("unit_key").agg(F.coalesce(F.min("o"), F.lit((1 << 63) - 1)).alias("o"))
    if register is None:
        return _numbered(first)
    known = register.select("unit_key", F.col("sample_number").cast("long").alias("sample_number"))
    last = known.agg((F.coalesce(F.max("sample_number"), F.lit(-1)) + 1).alias("next"))
    new = _numbered(first.join(known, "unit_key", "left_anti")).crossJoin(F.broadcast(last))
    return known.unionByName(new.select("unit_key", (F.col("sample_number") + F.col("next")).alias("sample_number")))


def _numbered(first: DataFrame) -> DataFrame:
    """``unit_key, sample_number``: keys ``unit_key, o`` numbered in the order of ``o``, in two levels."""
    d = first.withColumn("b", F.floor(F.col("o") / BUCKET))
    before = d.groupBy("b").agg(F.count("*").alias("n")).withColumn("page", F.floor(F.col("b") / BUCKET))
    pages = before.groupBy("page").agg(F.sum("n").alias("n")).select("page", F.coalesce(F.sum("n").over(Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("page").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = before.withColumn("s", inner).join(pages, "page").select("b", (F.col("s") + F.col("p")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("b").orderBy("o", "unit_key")) - 1
    return d.withColumn("k", inside).join(starts, "b").select("unit_key", (F.col("start") + F.col("k")).cast("long").alias("sample_number"))


def sample(df: DataFrame, unit: str, take: int = 13, block: int = BLOCK, seed: str = "sample-1", order: str = "row_no", register: DataFrame | None = None) -> DataFrame:
    """The rows of the chosen units with ``sample_number`` and ``sample_block``; all columns are kept.

    ``unit`` is a whole-number column, whose values are the persistent numbers, or a text column
    such as ``id`` or ``source_id``, whose keys are numbered by :func:`registered`: all rows of a
    unit are chosen together. Each full block gives exactly ``take`` units. Null or blank units
    and negative numbers are never chosen; repeated rows are chosen alike; an empty table stays
    empty. Columns of the two added names are replaced.
    """
    if dict(df.dtypes)[unit] in ("int", "bigint", "smallint", "tinyint"):
        kept = df.withColumns({"sample_number": F.col(unit).cast("long")})
        kept = kept.filter(F.coalesce((F.col("sample_number") >= 0) & chosen(F.col("sample_number"), take, block, seed), F.lit(False)))
    else:
        units = registered(df, unit, order, register).filter(chosen(F.col("sample_number"), take, block, seed))
        plain = df.drop("sample_number", "sample_block").withColumn("__unit", key(F.col(unit)))
        kept = plain.join(units.withColumnRenamed("unit_key", "__unit"), "__unit").drop("__unit")
    return kept.withColumns({"sample_block": F.floor(F.col("sample_number") / block)})
