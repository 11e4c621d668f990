"""Resumable ingest and keyed state as Structured Streaming jobs over files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from corpusloom.operators.consensus import last_state
from corpusloom.operators.desk import SAVED, overlay
from corpusloom.operators.segments import CHANGE

#: Folders into which the keys of a state are hashed.
PARTS = 64


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as they come; the checkpoint of the query keeps what was read."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def ingest(stream: DataFrame, out: str, checkpoint_dir: str, key: str = "id"):
    """Start a query that appends each key's first row to ``out`` and ends when the files there are were read.

    A restarted query goes on where it was; a key met in an earlier run isn't added again.
    """
    fresh = stream.filter(F.col(key).isNotNull()).dropDuplicates([key])
    return fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint_dir).outputMode("append").trigger(availableNow=True).start()


def upsert_state(stream: DataFrame, folder: str, checkpoint_dir: str, key: str = "id", order: str = "seq", parts: int = PARTS):
    """Start a query that keeps the last row of each key under ``folder``.

    Keys are hashed into ``parts`` folders. A micro-batch rewrites the parts that its keys fall into
    and no others, each as a new version named by the batch, from the version before it; so a batch
    that is repeated after a failure writes the same again. Versions older than the one that a
    repeated batch would start from are removed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        rows = batch.withColumn("part", part).persist()
        touched = sorted(r["part"] for r in rows.select("part").distinct().collect())
        before = {p: v for p, v in _versions(spark, folder, number).items() if p in touched}
        every = rows
        if before:
            every = rows.unionByName(spark.read.option("basePath", folder).parquet(*[f"{folder}/part={p}/v={v}" for p, v in before.items()]).drop("v"), allowMissingColumns=True)
        last = last_state(every, key, order)
        for p in touched:
            _drop(spark, f"{folder}/part={p}/v={number}")
        last.withColumn("v", F.lit(number)).write.mode("append").partitionBy("part", "v").parquet(folder)
        for p, v in before.items():
            for old in _numbers(spark, f"{folder}/part={p}", "v="):
                if old < v:
                    _drop(spark, f"{folder}/part={p}/v={old}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, mark: str) -> list[int]:
    p, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return [int(n[len(mark) :]) for n in names if n.startswith(mark) and n[len(mark) :].isdigit()]


def _drop(spark: SparkSession, path: str) -> None:
    p, fs = _folder(spark, path)
    fs.delete(p, True)


def _versions(spark: SparkSession, folder: str, below: int | None = None) -> dict[int, int]:
    """The latest version of each part, of those below a number."""
    found = {}
    for part in _numbers(spark, folder, "part="):
        versions = [v for v in _numbers(spark, f"{folder}/part={part}", "v=") if below is None or v < below]
        if versions:
            found[part] = max(versions)
    return found


def current_state(spark: SparkSession, folder: str, schema: str | StructType | None = None) -> DataFrame:
    """The latest versions of all parts that :func:`upsert_state` wrote; if it wrote none yet, an empty table of ``schema``, without which that is an error."""
    if schema is not None and not _versions(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/part={p}/v={v}" for p, v in _versions(spark, folder).items()]).drop("part", "v")


def corrected(stream: DataFrame, manifest: DataFrame, folder: str, checkpoint_dir: str, order: str = "seq"):
    """Start a query that keeps late corrections by id; lay them over the manifest with :func:`laid_over`."""
    known = manifest.select("id").filter("id IS NOT NULL").distinct()
    return upsert_state(stream.join(known, "id", "left_semi"), folder, checkpoint_dir, "id", order)


def laid_over(manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest with the latest corrections kept by :func:`corrected`."""
    none = "id STRING, " + ", ".join(f"{c} STRING" for c in SAVED)
    return overlay(manifest, current_state(manifest.sparkSession, folder, none))


_POINTS = "group string, seg long, seg_start double, seg_end double, n_samples long"


def change_points(stream: DataFrame, threshold: float = CHANGE) -> DataFrame:
    """The segments of :func:`corpusloom.operators.segments.change_points` as a stream: ``group, seg, seg_start, seg_end, n_samples``.

    ``stream`` is ``group, t, n, u, v``: samples that come in order from batch to batch (within one they are sorted by ``t, n``).
    Each group keeps its last sample and its open segment. Every batch gives the segments that it
    touched as they are then, so of a segment given more than once the last, with most samples, counts.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(batches).sort_values(["t", "n"])
        seg, start, end, n, u, v = state.get if state.exists else (0, None, None, 0, None, None)
        out: dict[int, tuple] = {}
        for t, x, y in zip(pdf["t"], pdf["u"], pdf["v"]):
            if u is not None and abs(x - u) + abs(y - v) > threshold:
                seg, start, n = seg + 1, None, 0
            start, end, n, u, v = float(t if start is None else start), float(t), n + 1, float(x), float(y)
            out[seg] = (key[0], seg, start, end, n)
        state.update((seg, start, end, n, u, v))
        yield pd.DataFrame(list(out.values()), columns=[c.split()[0] for c in _POINTS.split(", ")])

    kept = "seg long, start double, end double, n long, u double, v double"
    return stream.groupBy("group").applyInPandasWithState(step, _POINTS, kept, "update", GroupStateTimeout.NoTimeout)
