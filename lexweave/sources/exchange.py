"""Export and import of the memory as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.memory import export_items
from lexweave.plans.lineage import with_row_numbers

FIELDS = ("hash", "source_lang", "target_lang", "source_text", "translated_text", "status", "provider")
ITEM = "struct<" + ",".join(f"{c}:string" for c in FIELDS) + ">"


def export_lines(memory: DataFrame) -> DataFrame:
    """``id``, ``value``: one JSON object per row, written side by side; a file per task holds many rows."""
    return export_items(memory).select("id", F.to_json(F.struct(*FIELDS)).alias("value"))


def export_document(memory: DataFrame, source_lang: str, at: Column) -> DataFrame:
    """``line``, ``value``: the lines of one JSON document: version, time, source language and all items by id.

    The lines are numbered over ranges of ids, so any number of items makes a document; written in
    their order and put together they are the file.
    """
    head = F.concat(F.lit('{"version":1,"exported_at":"'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","source_lang":'), F.to_json(F.array(F.lit(source_lang))), F.lit(',"items":['))
    head = F.regexp_replace(head, r':\["(.*)"\],"items"', r':"$1","items"')
    rows = with_row_numbers(export_lines(memory), "id")
    count = rows.agg(F.max("row_number").alias("n"))
    items = rows.join(F.broadcast(count)).select(F.col("row_number").alias("line"), F.concat("value", F.when(F.col("row_number") < F.col("n"), ",").otherwise("")).alias("value"))
    ends = count.select(F.inline(F.array(F.struct(F.lit(0).cast("long").alias("line"), head.alias("value")), F.struct((F.coalesce("n", F.lit(0)) + 1).cast("long").alias("line"), F.lit("]}").alias("value")))))
    return items.unionByName(ends)


def write_document(memory: DataFrame, path: str, source_lang: str, at: Column) -> None:
    """``export_document`` as text files whose names are in the order of the lines."""
    export_document(memory, source_lang, at).repartitionByRange("line").sortWithinPartitions("line").select("value").write.mode("errorifexists").text(path)


def write_export(memory: DataFrame, path: str) -> None:
    """Items as JSON lines, in ranges of their id, so that no task holds them all."""
    export_lines(memory).repartitionByRange("id").sortWithinPartitions("id").select("value").write.mode("errorifexists").text(path)


def read_import(spark: SparkSession, path: str) -> DataFrame:
    """Items of an exported document (an object with ``items``) or of JSON lines; other shapes raise an error."""
    raw = spark.read.text(path, wholetext=False).select("value")
    lines = raw.select(F.from_json("value", ITEM).alias("i")).select("i.*").filter("source_text is not null")
    whole = spark.read.schema(f"version int, exported_at string, source_lang string, items array<{ITEM}>").json(path, multiLine=True).filter("items is not null").select(F.inline("items"))
    first = raw.filter(F.trim("value") != "").limit(1).collect()
    if not first:
        raise ValueError(f"{path} holds no items")
    found = whole if first[0].value.lstrip().startswith("{") and not whole.isEmpty() else lines
    if found.isEmpty():
        raise ValueError(f"{path} holds no items")
    return found
