"""The work queue as a stream: items are drained in micro-batches and counted as they are done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "type string, id long, lang string, text string"
TICK = "60 seconds"


def read_queue(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Queue items as they arrive in a folder, ``files`` of them a batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def drain(queue: DataFrame, work: Callable[[DataFrame], DataFrame], results: str, status: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs ``work`` on each batch of items that aren't blank, writes its results and one status row per batch.

    Blank items count as done. Where the results have a column ``error``, its values are counted; such
    items are done too and not tried again. A batch that is run again after a failure overwrites its
    own folder, so nothing is done twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        blank = F.trim(F.coalesce("text", F.lit(""))) == ""
        work(rows.filter(~blank)).write.mode("overwrite").parquet(f"{results}/batch={number}")
        done = rows.sparkSession.read.parquet(f"{results}/batch={number}")
        failed = done.agg((F.count("error") if "error" in done.columns else F.lit(0).cast("long")).alias("errors"))
        counts = rows.agg(F.count(F.lit(1)).alias("items"), F.count(F.when(blank, 1)).alias("blank")).join(F.broadcast(failed))
        counts.write.mode("overwrite").parquet(f"{status}/batch={number}")

    writer = queue.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TICK)).start()


def progress(spark: SparkSession, status: str, total: int) -> DataFrame:
    """``done``, ``blank``, ``errors``, ``total``, ``state`` over all batches; the total is never less than what is done."""
    by = spark.read.parquet(status).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(to) for c, to in (("items", "done"), ("blank", "blank"), ("errors", "errors"))])
    whole = F.greatest(F.lit(total), F.col("done"))
    return by.select("done", "blank", "errors", whole.alias("total"), F.when(F.col("done") >= whole, "done").otherwise("running").alias("state"))
