"""The memory as a table of snapshots in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "id long, hash string, source_lang string, target_lang string, source_text string, previous_source_text string, translated_text string, status string, provider string, updated_at timestamp_ntz"


class MemoryStore:
    """Snapshots ``n=0``, ``n=1``, ... below ``path``; the last complete one is the table.

    A snapshot counts once its success mark is there, so a writer that is lost changes nothing, and
    a reader keeps the snapshot that it opened.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self):  # noqa: ANN202
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self) -> list[int]:
        files, at = self._folder()
        if not files.exists(at):
            return []
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(x.getPath().getName()[2:]) for x in files.listStatus(at) if x.getPath().getName().startswith("n=") and files.exists(mark(x.getPath(), "_SUCCESS")))

    def create(self) -> None:
        """An empty table where there is none."""
        if not self._numbers():
            self.write(self.spark.createDataFrame([], SCHEMA))

    def read(self) -> DataFrame:
        """The last snapshot; columns that an older one lacks are null."""
        numbers = self._numbers()
        if not numbers:
            raise ValueError(f"{self.path} holds no table")
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/n={numbers[-1]}")

    def write(self, memory: DataFrame, keep: int = 2) -> None:
        """A new snapshot, of which the last ``keep`` stay."""
        numbers = self._numbers()
        number = numbers[-1] + 1 if numbers else 0
        memory.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/n={number}")
        files, at = self._folder()
        for old in [*numbers, number][:-keep]:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(at, f"n={old}"), True)

    def drop(self) -> None:
        files, at = self._folder()
        files.delete(at, True)
