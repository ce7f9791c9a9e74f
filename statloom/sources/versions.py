"""Versions of a table, one of which readers see.

A refresh is requested, which gives it a number; its rows are written to a folder of their own; then it is published or
fails. Publishing moves a pointer from the version that the refresh began with: it is compared and set, so a refresh
that is overtaken by a later one is late and never seen, and neither is a failed one. Every step writes a folder that
must not exist before, which is as exact as the file system's own check.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STEP = "version long, status string, reason string, size long, seen long"


class Versions:
    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home
        for folder in ("steps", "pointers"):
            spark.createDataFrame([], f"{_STEP}, n long").write.mode("ignore").parquet(f"{home}/{folder}/n=-1")

    def _add(self, folder: str, n: int, *row) -> bool:
        """Whether step n of the folder could be written: another writer may have been first."""
        try:
            self.spark.createDataFrame([row], _STEP).coalesce(1).write.mode("errorifexists").parquet(f"{self.home}/{folder}/n={n}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            return False
        return True

    def _rows(self, folder: str) -> DataFrame:
        return self.spark.read.schema(f"{_STEP}, n long").parquet(f"{self.home}/{folder}").where("n >= 0")

    def request(self, reason: str | None = None) -> int:
        """A new version's number."""
        while True:
            last = self._rows("steps").where("status = 'refreshing'").agg(F.max("version")).first()[0] or 0
            if self._add("steps", 10 * (last + 1), last + 1, "refreshing", reason, None, self.current() or 0):
                return last + 1

    def fail(self, version: int, reason: str) -> None:
        self._add("steps", 10 * version + 1, version, "failed", reason, None, None)

    def complete(self, version: int, rows: DataFrame, reason: str | None = None) -> bool:
        """Writes the rows and has readers see them, unless the version was overtaken or has ended."""
        path = f"{self.home}/rows/version={version}"
        begun = self._rows("steps").where(F.col("version") == version).select("status", "seen").collect()
        if len(begun) != 1:
            return False
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        size = self.spark.read.schema(rows.schema).parquet(path).count()
        moves = self._rows("pointers").agg(F.max("n")).first()[0]
        current = self.current() or 0
        moved = current == begun[0].seen and self._add("pointers", 0 if moves is None else moves + 1, version, "ready", reason, size, current)
        self._add("steps", 10 * version + 1, version, "ready" if moved else "late", reason, size, current)
        return moved

    def current(self) -> int | None:
        last = self._rows("pointers").orderBy(F.desc("n")).select("version").first()
        return last and last.version

    def read(self, schema) -> DataFrame:
        """The rows that readers see: none before the first version."""
        version = self.current()
        return self.spark.createDataFrame([], schema) if version is None else self.spark.read.schema(schema).parquet(f"{self.home}/rows/version={version}")

    def history(self) -> DataFrame:
        """Each version's last step: version, status, reason, size, served."""
        last = self._rows("steps").groupBy("version").agg(F.max_by(F.struct("status", "reason", "size"), "n").alias("s"))
        return last.select("version", "s.*", (F.col("version") == F.lit(self.current() or 0)).alias("served"))
