"""Whole pipelines: documents translated, rows translated again, gaps filled, the review list and its focus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import hygiene, memory as M, resolve, review
from lexweave.plans.lineage import keep
from lexweave.sources import html

Transform = Callable[[str, str, str], str]
NAMES = ["segment", "lang", "target_lang"]


def extracted(docs: DataFrame, content: str = "content") -> DataFrame:
    """``doc_id``, ``lang``, ``target_lang``, ``pos``, ``segment``: the distinct texts of an HTML document in their order."""
    return docs.select("doc_id", "lang", "target_lang", F.posexplode(html.segments(F.col(content))).alias("pos", "segment"))


def to_translate(segs: DataFrame) -> DataFrame:
    """The distinct segments of all documents whose languages differ, in their normal form beside the text as found."""
    return segs.filter(F.col("lang") != F.col("target_lang")).select(F.col("segment").alias("found"), T.normalize(F.col("segment")).alias("segment"), "lang", "target_lang").distinct()


def applied(docs: DataFrame, segs: DataFrame, results: DataFrame, content: str = "content") -> DataFrame:
    """``docs`` with ``translated``: ``content`` with the texts of ``results`` (``found``, languages, ``result``) in place of its own.

    What is gathered are the distinct texts of one document. A document without any is left as it is.
    """
    pairs = segs.withColumnRenamed("segment", "found").join(results.filter(F.col("result").isNotNull()), ["found", "lang", "target_lang"])
    by = pairs.groupBy("doc_id", "target_lang").agg(F.collect_list(F.struct("found", "result")).alias("p"))
    j = docs.join(by, ["doc_id", "target_lang"], "left")
    none = F.array().cast("array<string>")
    return j.withColumn("translated", html.replaced(F.col(content), F.coalesce(F.col("p.found"), none), F.coalesce(F.col("p.result"), none))).drop("p")


def translated(docs: DataFrame, memory: DataFrame, glossary: DataFrame, phrases: DataFrame, transform: Transform | None = None, content: str = "content") -> DataFrame:
    """``docs`` (``doc_id``, ``lang``, ``target_lang``, ``content``) with ``translated``: extract, resolve, apply.

    Misses go to ``transform`` if there is one and stay as they are otherwise. Documents in their
    target language and blank ones are left unchanged.
    """
    segs = keep(extracted(docs, content))
    wanted = to_translate(segs)
    ladder = resolve.resolve(wanted.select(*NAMES).distinct(), memory, glossary, phrases)
    if transform is not None:
        ladder = keep(ladder)
        got = resolve.fetched(ladder.filter("rule = 'fetch'").select(*NAMES), transform, glossary, phrases).select(*NAMES, F.col("result").alias("fetched"))
        ladder = ladder.join(got, NAMES, "left").withColumn("result", F.coalesce("result", "fetched"))
    return applied(docs, segs, wanted.join(ladder.select(*NAMES, "result"), NAMES).select("found", "lang", "target_lang", "result"), content)


def retranslated(memory: DataFrame, ids: DataFrame, transform: Transform, now: Column, collation: str = M.COLLATION, glossary: DataFrame | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """The memory with the rows of ``ids.id`` translated again, as automatic ones; confirmed rows and failed calls change nothing."""
    todo = memory.join(ids.select("id").distinct(), "id", "left_semi").filter(~F.coalesce(F.col("status") == "confirmed", F.lit(False)))
    rows = todo.select(F.col("source_text").alias("segment"), F.col("source_lang").alias("lang"), "target_lang").filter("segment is not null and lang is not null and target_lang is not null").distinct()
    got = resolve.fetched(rows, transform, glossary, phrases).filter(F.col("error").isNull() & F.col("result").isNotNull())
    changes = got.select(F.col("lang").alias("source_lang"), "target_lang", F.col("segment").alias("source_text"), F.col("result").alias("translated_text"), F.lit("auto").alias("status"), F.lit("provider").alias("provider"), F.lit(True).alias("force"))
    return M.upsert(memory, changes, now, collation)


def filled(segs: DataFrame, memory: DataFrame, glossary: DataFrame, phrases: DataFrame, transform: Transform, now: Column, collation: str = M.COLLATION) -> tuple[DataFrame, DataFrame]:
    """The memory with what documents miss, and ``doc_id``, ``translated``, ``remaining``, ``error`` of each document.

    ``segs``: ``doc_id``, ``segment``, ``lang``, ``target_lang``, ``hash``. Each missing segment is
    resolved once however many documents hold it; calls that fail are made once more. ``error`` is
    the least message of those that failed again.
    """
    absent = lambda of: segs.join(of.filter(F.col("hash").isNotNull()).select("hash"), "hash", "left_anti")
    before = keep(absent(memory))
    ladder = keep(resolve.resolve(before.select(*NAMES).distinct(), memory, glossary, phrases))
    first = keep(resolve.fetched(ladder.filter("rule = 'fetch'").select(*NAMES), transform, glossary, phrases))
    again = keep(resolve.fetched(first.filter(F.col("error").isNotNull()).select(*NAMES), transform, glossary, phrases))
    known = ladder.filter("write").select(F.col("lang").alias("source_lang"), "target_lang", F.col("segment").alias("source_text"), F.col("result").alias("translated_text"), "status", "provider", (F.col("status") != "auto").alias("force"))
    changes = known.unionByName(resolve.answered(first)).unionByName(resolve.answered(again))
    after = keep(M.upsert(memory, changes, now, collation))
    left = absent(after).join(again.select(*NAMES, "error"), NAMES, "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("remaining"), F.min("error").alias("error"))
    had = before.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    docs = segs.select("doc_id").distinct().join(had, "doc_id", "left").join(left, "doc_id", "left").na.fill(0, ["n", "remaining"])
    return after, docs.select("doc_id", F.greatest(F.col("n") - F.col("remaining"), F.lit(0)).alias("translated"), "remaining", "error")


def review_list(memory: DataFrame, status: str = "pending", target_lang: str = "", search: str = "", sort: str = "newest", number: int = 1, per: int = 20, collation: str = M.COLLATION) -> DataFrame:
    """One page of the cleaned memory, its automatic rows polished and its near-duplicates left out."""
    shown = review.page(review.listed(hygiene.cleaned(memory, collation), status, target_lang, search, collation), sort, number, per)
    return hygiene.review_rows(hygiene.healed(shown))


def focus(memory: DataFrame, wanted: int = 0, target_lang: str = "", collation: str = M.COLLATION) -> DataFrame:
    """``id``, ``translated_text``, ``status``, ``pending``, ``prev_id``, ``next_id``: one row of the cleaned memory to work on.

    It is the wanted row, unless that is gone, or of another language and not confirmed; then the first
    pending one of the language. Without any the id is null.
    """
    clean = keep(hygiene.cleaned(memory, collation))
    pending = review.listed(clean, "pending", target_lang)
    good = (F.col("id") == wanted) & (F.lit(not target_lang) | (F.col("target_lang") == target_lang) | (F.col("status") == "confirmed"))
    pick = clean.filter(good).agg(F.min("id").alias("own")).join(F.broadcast(pending.agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("pending"))))
    chosen = pick.select(F.coalesce("own", "first").alias("id"), "pending")
    ends = pending.join(F.broadcast(chosen.select(F.col("id").alias("_at")))).agg(F.min("id").alias("_first"), F.max("id").alias("_last"), F.max(F.when(F.col("id") < F.col("_at"), F.col("id"))).alias("_before"), F.min(F.when(F.col("id") > F.col("_at"), F.col("id"))).alias("_after"))
    item = hygiene.healed(clean.join(F.broadcast(chosen.select("id")), "id", "left_semi")).select("id", "translated_text", "status")
    other = lambda near, end: F.nullif(F.coalesce(near, end), F.col("id"))
    return chosen.join(item, "id", "left").join(F.broadcast(ends)).select("id", "translated_text", "status", "pending", other("_before", "_last").alias("prev_id"), other("_after", "_first").alias("next_id"))
