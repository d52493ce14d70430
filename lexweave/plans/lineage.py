"""Where intermediate results are kept and how stages are spread."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder that all executors share, its lineage cut.

    The folder is the cluster's ``spark.checkpoint.dir``. Where that is unset, one machine takes a
    folder of its own, as in tests; a cluster has no other folder that all executors share, so there
    it is an error.
    """
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession) -> str:
    """The checkpoint folder, named where it isn't yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexweave-"))
    return spark.sparkContext.getCheckpointDir()


def keep_table(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the checkpoint folder, for wide rows that are read again by some columns."""
    path = f"{folder(df.sparkSession)}/lexweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that are sent to the executors for a join, at most.
MOST_KEYS = 1_000_000


def sent_if_few(keys: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """A kept table of keys, to be joined to a large one: sent where it is small, so that the large one isn't shuffled."""
    return F.broadcast(keys) if keys.count() <= most else keys


def width(spark: SparkSession) -> int:
    """Partitions for a stage whose work is per row: the shuffle setting, at least one for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least one partition per core, so that one large file doesn't become one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(width(df.sparkSession))


def shared(spark: SparkSession, value: object) -> Callable[[], Any]:
    """``value`` broadcast once; the result returns it on an executor, where this package needn't be installed."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def built(spark: SparkSession, value: object, build: Callable[[Any], Any]) -> Callable[[], Any]:
    """``value`` broadcast once; the result returns ``build`` of it, made once in each worker process and kept for its later tasks."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get() -> Any:
        # A worker keeps what it received as long as the broadcast lives, so what is built stays with it.
        if not hasattr(sent, "built"):
            sent.built = build(pickle.loads(sent.value))
        return sent.built

    return get


def with_row_numbers(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``row_number`` from 1 in the order of a column, without bringing all rows to one task.

    The ranges are written once, so that their sizes and their rows are of the same bounds.
    """
    ranged = df.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    inner = keep(ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(order))))
    # As many rows as there are ranges.
    sizes = inner.groupBy("_p").agg(F.count(F.lit(1)).alias("_s"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("row_number", F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")
