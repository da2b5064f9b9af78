"""Session defaults, the shared work folder, and written (lineage-cutting) intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Rows of an Arrow batch where the session keeps Spark's own number: bounds what a Python worker holds at once.
BATCH_ROWS, SPARK_BATCH_ROWS = 2000, 10_000


def get_session(app: str = "anvilgrid", master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC, AQE and small local shuffles; keyword options override (underscores stand for dots)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ANVILGRID_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed but its folder is visible to them, and read small
    batches unless the session sets their size."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) == SPARK_BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join(x for x in [ROOT, *have] if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session (tests) gets an own one where it is unset."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='anvilgrid-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


class Workspace:
    """Written tables of one operator call. A table is read back, so a lost executor costs a re-read, not a re-run. Results
    are read from it when they are asked for, so it goes with the session."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        ship(spark)
        fs, path = self.fs()
        fs.mkdirs(path(self.path))
        fs.deleteOnExit(path(self.path))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table; what that shuffled goes at once, as the table takes its place."""
        clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(clean, None)
        self.spark.conf.set(clean, "true")
        try:
            df.write.parquet(f"{self.path}/{name}")
        finally:
            self.spark.conf.unset(clean) if before is None else self.spark.conf.set(clean, before)
        return self.load(name, df.schema)

    def load(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def inner(self, name: str) -> Workspace:
        """A workspace within this one."""
        out = Workspace(self.spark, name)
        out.path = f"{self.path}/{name}"
        return out

    def fs(self):
        jvm, path = self.spark.sparkContext._jvm, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def drop(self, name: str) -> None:
        """Deletes a table that nothing will read again."""
        fs, path = self.fs()
        fs.delete(path(f"{self.path}/{name}"), True)

    def put(self, name: str, data: bytes) -> str:
        """Writes one file for all executors and returns its path."""
        fs, path = self.fs()
        out = fs.create(path(f"{self.path}/{name}"), True)
        out.write(bytearray(data))
        out.close()
        return f"{self.path}/{name}"
