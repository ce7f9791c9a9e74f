"""Session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("statloom")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where that is unset and all run on this machine."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="statloom-"))
        told = spark.sparkContext.getCheckpointDir()
    return told.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, outlives executors, is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


TEXTS_PER_BATCH = 1000
COMPRESSED = 16  # times that rows in memory may exceed their Parquet files
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once per application, so that functions sent by name are found there.

    Also lowers Spark's default of 10,000 rows an Arrow batch, unless another number is set: rows here hold whole texts.
    And has files' sizes multiplied where a join's sides are judged by them, unless a factor is set: a few megabytes of
    compressed rows that would be broadcast fill the driver.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.sources.fileCompressionFactor") == "1.0":
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(float(COMPRESSED)))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_PER_BATCH))
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="statloom-")) / "statloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"statloom/{p.relative_to(root)}")
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
