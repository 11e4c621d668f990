"""Running sums over a whole table without a window that holds the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets of whole numbers that are summed together.
PAGE = 2048


def running_sum(df: DataFrame, bucket: Column, order: list[str], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """``df`` with the running sum of ``value`` in the order of ``bucket``, then ``order``.

    A window inside each bucket and one over the buckets' totals; buckets that are whole numbers
    have pages between, so that many of them, as with sparse numbers, are no single window. Buckets
    must follow the order (a hash's first digits, a number divided by a constant).
    """
    d = df.withColumns({"__b": bucket, "__v": value})
    totals = d.groupBy("__b").agg(F.sum("__v").alias("__t"))
    until = lambda w: F.coalesce(F.sum("__t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if dict(totals.dtypes)["__b"] in ("bigint", "int"):
        totals = totals.withColumn("__p", F.floor(F.col("__b") / PAGE))
        pages = totals.groupBy("__p").agg(F.sum("__t").alias("__t"))
        pages = pages.select("__p", until(Window.orderBy("__p")).alias("__s"))
        inner = totals.select("__p", "__b", until(Window.partitionBy("__p").orderBy("__b")).alias("__i"))
        starts = inner.join(pages, "__p").select("__b", (F.col("__s") + F.col("__i")).alias("__s"))
    else:
        starts = totals.select("__b", until(Window.orderBy("__b")).alias("__s"))
    within = F.sum("__v").over(Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    total = F.col("__s") + F.col("__w") - (F.lit(0) if inclusive else F.coalesce(F.col("__v"), F.lit(0)))
    return d.withColumn("__w", F.coalesce(within, F.lit(0))).join(starts, "__b").withColumn(name, total).drop("__b", "__v", "__w", "__s")
