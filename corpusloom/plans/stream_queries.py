"""Queries that run as streams over the files and end when all were read."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import desk
from corpusloom.session import shared_folder, table
from corpusloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of manifest, ingested once each by a stream."""
    # A pattern, as a stream takes folders or patterns and a table may be one file.
    work = f"{shared_folder(spark)}/ingest-{uuid4().hex}"
    files = table(spark, sf_dir, "manifest")
    stream = incremental.file_stream(spark, f"{sf_dir}/manifest.parque[t]", files.schema, "parquet")
    incremental.ingest(stream.select("id", "source_id"), f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/out").select("id")


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each id, kept by a stream."""
    work = f"{shared_folder(spark)}/state-{uuid4().hex}"
    files = table(spark, sf_dir, "machine_verify_state")
    stream = incremental.file_stream(spark, f"{sf_dir}/machine_verify_state.parque[t]", files.schema, "parquet")
    incremental.upsert_state(stream.select("id", "seq", "mv_verdict"), f"{work}/state", f"{work}/checkpoint").awaitTermination()
    return incremental.current_state(spark, f"{work}/state").filter(F.col("id").isNotNull()).select("id", "seq", "mv_verdict")


def _in_batches(spark: SparkSession, df: DataFrame, work: str, batch: Column, n: int) -> DataFrame:
    """``df`` as a stream of ``n`` batches, one file each."""
    for k in range(n):
        df.filter(batch == k).coalesce(1).write.mode("append").parquet(f"{work}/in")
    return incremental.file_stream(spark, f"{work}/in", df.schema, "parquet", 1)


def stream_state_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from four batches, stopped after the first file and started again."""
    work = f"{shared_folder(spark)}/states-{uuid4().hex}"
    rows = table(spark, sf_dir, "machine_verify_state").filter("id IS NOT NULL").select("id", "seq", "mv_verdict")
    batch = F.pmod(F.xxhash64("seq"), F.lit(4))
    rows.filter(batch == 3).coalesce(1).write.parquet(f"{work}/in")
    incremental.upsert_state(incremental.file_stream(spark, f"{work}/in", rows.schema, "parquet"), f"{work}/state", f"{work}/checkpoint").awaitTermination()
    incremental.upsert_state(_in_batches(spark, rows, work, batch, 3), f"{work}/state", f"{work}/checkpoint").awaitTermination()
    return incremental.current_state(spark, f"{work}/state").select("id", "seq", "mv_verdict")


def stream_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per status of manifest's clips once corrections that came in two batches are laid over them."""
    work = f"{shared_folder(spark)}/overlay-{uuid4().hex}"
    state = table(spark, sf_dir, "machine_verify_state").filter("id IS NOT NULL")
    saved = state.select("seq", "id", "transcript", F.lit("").alias("roman"), F.col("mv_verdict").alias("status"), F.lit("").alias("notes"))
    clips = table(spark, sf_dir, "manifest").groupBy("id").agg(*[F.min(c).alias(c) for c in desk.SAVED])
    incremental.corrected(_in_batches(spark, saved, work, F.col("seq") % 2, 2), clips, f"{work}/state", f"{work}/checkpoint").awaitTermination()
    return incremental.laid_over(clips, f"{work}/state").groupBy("status").agg(F.count("*").alias("n_rows"))


def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change points of each user's event values, found by a stream in three batches of time."""
    work = f"{shared_folder(spark)}/segments-{uuid4().hex}"
    ev = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("group"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"), F.col("event_id").alias("n"), F.col("value").alias("u"), F.lit(0.0).alias("v"))
    edges = ev.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    third = F.least(F.lit(2), F.floor((F.col("t") - edges["a"]) / ((edges["b"] - edges["a"]) / 3)))
    found = incremental.change_points(_in_batches(spark, ev, work, third, 3), 100.0)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("b", F.lit(number)).write.mode("overwrite").parquet(f"{work}/out/b{number}")

    found.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    by = spark.read.parquet(f"{work}/out/b*").groupBy("group", "seg").agg(F.max_by(F.struct("seg_start", "seg_end", "n_samples"), "n_samples").alias("s"))
    return by.select(F.col("group").cast("long").alias("user_id"), "seg", F.col("s.seg_start").cast("long").alias("start_us"), F.col("s.seg_end").cast("long").alias("end_us"), F.col("s.n_samples").alias("n_samples"))


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (stream_ingest, stream_state, stream_state_batches, stream_overlay, stream_segments)}


def oracle_sql() -> dict[str, str]:
    from corpusloom.plans.curation_queries import _SEGMENTS

    last = "SELECT id, seq, mv_verdict FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM machine_verify_state WHERE id IS NOT NULL) WHERE n = 1"
    return {
        "stream_state_batches": last,
        "stream_overlay": """
WITH clips AS (SELECT id, min(status) AS status FROM manifest GROUP BY id), saved AS (SELECT id, arg_max(coalesce(mv_verdict, ''), seq) AS status FROM machine_verify_state WHERE id IS NOT NULL GROUP BY id)
SELECT coalesce(nullif(s.status, ''), nullif(c.status, ''), 'pending') AS status, count(*) AS n_rows FROM clips c LEFT JOIN saved s ON c.id = s.id GROUP BY 1""",
        "stream_segments": _SEGMENTS + " SELECT user_id, seg, epoch_us(seg_start) AS start_us, epoch_us(seg_end) AS end_us, n_samples FROM segs",
        "stream_ingest": "SELECT DISTINCT id FROM manifest WHERE id IS NOT NULL",
        "stream_state": "SELECT id, seq, mv_verdict FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM machine_verify_state WHERE id IS NOT NULL) WHERE n = 1",
    }
