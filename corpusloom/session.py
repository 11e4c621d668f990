"""Session factory, table access and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "corpusloom", cpus: int | None = None, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitted session is used as it is."""
    master = f"local[{cpus}]" if cpus else "local[*]"
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that Python workers can import it wherever they start."""
    context = spark.sparkContext
    if getattr(context, "_corpusloom_sent", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom_sources.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, Path(root.name) / file.relative_to(root))
    context.addPyFile(str(archive))
    context._corpusloom_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a session that runs in one process on one machine may do without that setting; it then
    gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not getattr(context, "_corpusloom_folder", None):
            context._corpusloom_folder = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")
        folder = context._corpusloom_folder
    return folder


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage by writing to the folder shared by all executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)
