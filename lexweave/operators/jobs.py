"""The work queue: what is to be translated, in what order, and what changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.plans.lineage import with_row_numbers

BATCH = 15
# Fields of a change event and the item type of each.
EVENT_FIELDS = {"title": "post_title", "excerpt": "post_excerpt", "content": "post_content"}


def site_queue(items: DataFrame, langs: Sequence[str]) -> DataFrame:
    """``type``, ``id``, ``lang``, ``text``: each content item that isn't blank, once for each target language."""
    rows = items.filter(F.trim("text") != "").select("type", "id", "text").distinct()
    return rows.select("type", "id", F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang"), "text")


def batches(queue: DataFrame, size: int = BATCH) -> DataFrame:
    """The queue with ``seq`` and ``batch``: batches of ``size`` items in the order of the item key."""
    order = F.struct(F.coalesce("type", F.lit("")), F.coalesce("id", F.lit(0)), F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit("")))
    rows = with_row_numbers(queue.withColumn("_o", order), "_o").drop("_o").withColumnRenamed("row_number", "seq")
    return rows.withColumn("batch", F.floor((F.col("seq") - 1) / size).cast("long"))


def progress(batched: DataFrame) -> DataFrame:
    """``batch``, ``items``, ``blank``, ``done``: what each batch does and how many items are done after it."""
    by = batched.groupBy("batch").agg(F.count(F.lit(1)).alias("items"), F.count(F.when(F.trim(F.coalesce("text", F.lit(""))) == "", 1)).alias("blank"), F.max("seq").alias("done"))
    return by


def percent_done(done: int, total: int) -> int:
    return 100 if total <= 0 else round(100 * done / total)


def replaced(items: DataFrame, started: Column) -> tuple[DataFrame, DataFrame]:
    """A new queue in place of the old one, and its status: running, nothing done."""
    status = items.agg(F.count(F.lit(1)).alias("total")).select(F.lit("running").alias("state"), "total", F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("errors"), started.alias("started"))
    return items, status


def appended(queue: DataFrame, texts: DataFrame, langs: Sequence[str], status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queue with each text that isn't blank put in once for each language, and the status after it.

    ``texts``: ``text``. Added texts are ``auto`` items without an id. The total grows by them and is
    never less than what is done and what waits.
    """
    rows = texts.filter(F.trim("text") != "").select("text").distinct().select(F.lit("auto").alias("type"), F.lit(0).cast("long").alias("id"), F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang"), "text")
    whole = queue.select("type", "id", "lang", "text").unionByName(rows)
    added, waiting = rows.agg(F.count(F.lit(1)).alias("added")), whole.agg(F.count(F.lit(1)).alias("waiting"))
    j = status.join(F.broadcast(added)).join(F.broadcast(waiting))
    total = F.greatest(F.col("total") + F.col("added"), F.col("done") + F.col("waiting"))
    return whole, j.select(F.lit("running").alias("state"), total.alias("total"), "done", "errors", "started")


def changed_texts(events: DataFrame, docs: DataFrame, types: Sequence[str] = ("post", "page")) -> DataFrame:
    """``text``: what saves put into the queue: the fields they changed and, whatever changed, both search texts of the document."""
    fields = changed_fields(events, docs, ["-"], types).select("text")
    live = docs.filter((F.col("post_status") == "publish") & F.col("post_type").isin(*types)).join(events.select("doc_id").distinct(), "doc_id", "left_semi")
    seo = live.select(F.explode(F.array("seo_title", "seo_description")).alias("text")).filter(F.trim("text") != "")
    return fields.unionByName(seo).distinct()


def menu_texts(items: DataFrame) -> DataFrame:
    """``text``: the labels of changed menu items that aren't blank."""
    return items.filter((F.col("type") == "menu_item") & (F.trim("text") != "")).select("text").distinct()


def changed_fields(events: DataFrame, docs: DataFrame, langs: Sequence[str], types: Sequence[str] = ("post", "page")) -> DataFrame:
    """``type``, ``id``, ``lang``, ``text``: queue items for the fields that a save changed.

    New documents and saves without an old state give every field that isn't blank. Only published
    documents of the given types count.
    """
    live = docs.filter((F.col("post_status") == "publish") & F.col("post_type").isin(*types)).select("doc_id").distinct()
    one = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.col(f"old.{f}").alias("was"), F.col(f"new.{f}").alias("text")) for f, t in EVENT_FIELDS.items()])).alias("f")
    rows = events.join(live, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), (F.col("is_update") & F.col("old").isNotNull()).alias("compare"), one)
    fresh = rows.filter((F.trim("f.text") != "") & (~F.coalesce("compare", F.lit(False)) | ~F.col("f.was").eqNullSafe(F.col("f.text"))))
    items = fresh.select("f.type", "id", "f.text").distinct()
    return items.select("type", "id", F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang"), "text")
