"""Segments of documents and how far the memory covers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import segment_hash
from lexweave.operators.memory import best_by_hash

#: A field's place times this, plus the line's, is the place of a segment; no string has as many lines.
FIELD_ROOM = 2**31
FIELDS = ("title", "excerpt", "text", "seo_title", "seo_description")


def fields(docs: DataFrame, names: tuple[str, ...] = FIELDS, id_col: str = "doc_id") -> DataFrame:
    """Long form ``doc_id``, ``lang``, ``field``, ``field_no``, ``text``: one row per text field that isn't blank."""
    one = F.posexplode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("text")) for n in names])).alias("field_no", "f")
    rows = docs.select(F.col(id_col).alias("doc_id"), "lang", one)
    return rows.select("doc_id", "lang", "field_no", "f.field", "f.text").filter(F.trim("text") != "")


def segments(long: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``segment``, ``pos``: the distinct lines of a document's fields at their first place."""
    lines = long.select("doc_id", "lang", "field_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    trimmed = lines.withColumn("segment", F.trim("line")).filter("segment <> ''")
    return trimmed.groupBy("doc_id", "lang", "segment").agg(F.min(F.col("field_no").cast("long") * FIELD_ROOM + F.col("line_no")).alias("pos"))


def with_target(segs: DataFrame, target: Column) -> DataFrame:
    return segs.withColumn("target_lang", target).withColumn("hash", segment_hash(F.col("lang"), F.col("target_lang"), F.col("segment")))


def resolved(segs: DataFrame, memory: DataFrame) -> DataFrame:
    """Segments with the status and translation of their hash; ``missing`` where there is none."""
    best = best_by_hash(memory).select("hash", "id", "translated_text", "status")
    return segs.join(best, "hash", "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def coverage(found: DataFrame) -> DataFrame:
    """Per document: segments, cached, confirmed, pending (missing, auto or edited), two percentages and the bucket."""
    count = lambda c: F.count(F.when(c, 1))
    status = F.col("status")
    by = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), count(status != "missing").alias("cached"), count(status == "confirmed").alias("confirmed"), count(status.isin("missing", "auto", "edited")).alias("pending"))
    percent = lambda c: F.when(F.col("segments") > 0, F.round(100 * F.col(c) / F.col("segments"))).otherwise(100).cast("int")
    return by.withColumns({"cached_pct": percent("cached"), "confirmed_pct": percent("confirmed")}).withColumn("bucket", bucket())


def bucket() -> Column:
    """The first bucket that a document falls to."""
    n = F.col("segments")
    return F.when(F.col("cached") == 0, "none").when(F.col("cached") < n, "partial").when(F.col("confirmed") == n, "fully_confirmed").otherwise("needs_review")


def missing(segs: DataFrame, memory: DataFrame) -> DataFrame:
    """Segments that the memory doesn't hold."""
    return segs.join(memory.filter(F.col("hash").isNotNull()).select("hash"), "hash", "left_anti")


def needs_work(found: DataFrame, wanted: str = "needs_work") -> DataFrame:
    kinds = {"needs_work": ("auto", "edited", "missing"), "pending": ("auto", "edited"), "all": None}
    of = kinds.get(wanted, (wanted,))
    return found if of is None else found.filter(F.col("status").isin(*of))


def published(docs: DataFrame, types: tuple[str, ...] = ("post", "page"), excluded_types: tuple[str, ...] = (), excluded_ids: tuple[int, ...] = ()) -> DataFrame:
    """Published documents of the given types without the excluded types and ids."""
    left = [t for t in types if t not in excluded_types]
    rows = docs.filter((F.col("post_status") == "publish") & F.col("post_type").isin(left))
    return rows.filter(~F.col("doc_id").isin([int(i) for i in excluded_ids])) if excluded_ids else rows


def by_hash(segs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Which segments of which documents have the given hashes."""
    return segs.join(hashes.filter("hash <> ''").select("hash").distinct(), "hash", "left_semi")
