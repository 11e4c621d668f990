"""Line-delimited JSON: strict and lenient reading, appending, and replacing what is being read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_strict(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """All rows of the files that exist; a malformed line fails the read, blank lines don't count."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(there)


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that can be read; malformed lines are left out, a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    d = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return d.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def done_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The distinct filled keys of a file that may hold broken lines."""
    return read_lenient(spark, path, f"{key} string").filter(F.coalesce(F.col(key), F.lit("")) != "").distinct()


def append(df: DataFrame, path: str) -> None:
    """Files are added to the folder; readers see whole files only."""
    df.write.mode("append").json(path)


def replace(df: DataFrame, path: str, dry_run: bool = False) -> int:
    """The folder is replaced after all rows were written beside it, so it may be what ``df`` reads.

    Returns the number of rows; a dry run only counts them.
    """
    spark = df.sparkSession
    if dry_run:
        return df.count()
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").json(new)
    (p, fs), (n, _), (o, _) = _path(spark, path), _path(spark, new), _path(spark, old)
    if fs.exists(o):
        fs.delete(o, True)
    if fs.exists(p):
        fs.rename(p, o)
    fs.rename(n, p)
    if fs.exists(o):
        fs.delete(o, True)
    return spark.read.schema(df.schema).json(path).count()


def by_source(df: DataFrame, source: str = "source_id", order: tuple[str, ...] = ("start", "id")) -> DataFrame:
    """The rows of each source side by side and in order; a source may be any part of the table, so none is collected."""
    return df.repartitionByRange(source, *order).sortWithinPartitions(source, *order)


def _files(spark: SparkSession, path: str, ending: str) -> list[str]:
    p, fs = _path(spark, path)
    return sorted(str(f.getPath()) for f in fs.listStatus(p) if f.getPath().getName().endswith(ending)) if fs.exists(p) else []


def write_batches(df: DataFrame, path: str, batch: str = "batch") -> None:
    """One JSON array per batch in a file ``batch_000.json``, as adjudicators take them; files of an earlier run are dropped.

    A batch is a handful of rows and their number is what people work off, so naming the files one
    by one is no work that grows with the corpus.
    """
    spark = df.sparkSession
    rows = df.groupBy(batch).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != batch])))).alias("value"))
    rows.repartition(batch).write.mode("overwrite").partitionBy(batch).text(f"{path}.new")
    (p, fs), (new, _) = _path(spark, path), _path(spark, f"{path}.new")
    if fs.exists(p):
        fs.delete(p, True)
    fs.mkdirs(p)
    for folder in fs.listStatus(new):
        name = folder.getPath().getName()
        if name.startswith(f"{batch}="):
            part = next(f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            fs.rename(part, _path(spark, f"{path}/batch_{int(name.split('=')[1]):03d}.json")[0])
    fs.delete(new, True)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of files that each hold one JSON array; a missing folder is empty, a file that is no array fails."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One column as text lines, sorted: a lock file."""
    df.select(F.col(column).alias("value")).sort("value").write.mode("overwrite").text(path)


def write_corpus(df: DataFrame, column: str, order: list[str], path: str) -> None:
    """One column as text lines in the order of other columns, the files' names in the same order."""
    df.sort(*order).select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``file, line``: the lines of a corpus with the name of their file, which sorts as the corpus does."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, kept as parquet: made and written once, read after that."""
    if not _files(spark, path, "_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def extended(keys: DataFrame, path: str, on: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The kept rows of all ``keys``; what isn't kept yet is made by ``make`` from the missing keys and appended first."""
    spark = keys.sparkSession
    wanted = keys.select(*on).distinct()
    missing = wanted.join(spark.read.parquet(path).select(*on).distinct(), on, "left_anti") if exists(spark, path) else wanted
    make(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted, on, "left_semi")
