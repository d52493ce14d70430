"""Cleaning the memory: purges, passthrough rows, healing and near-duplicate review rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators.memory import COLLATION, deduplicated


def junk_kind(df: DataFrame) -> Column:
    """Which purge a row falls to (``provider_error``, ``trivial``, ``code``), null for rows that stay.

    The first two take automatic rows only, code-like sources go whatever their status.
    """
    source, auto = F.col("source_text"), F.col("status") == "auto"
    trivial = T.is_link(source) | T.is_number_unit(source) | T.is_capital_code(source)
    return F.when(auto & T.is_provider_error(F.col("translated_text"), T.PURGE_MARKERS), "provider_error").when(auto & trivial, "trivial").when(T.is_code(source) | T.is_shortcode(source), "code")


def purged(memory: DataFrame) -> DataFrame:
    return memory.filter(junk_kind(memory).isNull())


def purge_counts(memory: DataFrame) -> DataFrame:
    """``kind``, ``rows``: what each purge would take."""
    return memory.select(junk_kind(memory).alias("kind")).filter("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))


def is_passthrough(df: DataFrame | None = None) -> Column:
    """Automatic rows whose source needs no translation: equal to it, already in the target language, or technical."""
    s, t = F.col("source_text"), F.col("translated_text")
    same = (s == t) | T.already_in_target(s, F.col("source_lang"), F.col("target_lang")) | T.is_technical(s)
    return F.coalesce((F.col("status") == "auto") & (F.col("source_lang") != F.col("target_lang")) & same, F.lit(False))


def passthrough_confirmed(memory: DataFrame) -> DataFrame:
    """The memory with passthrough rows confirmed, their source as translation; technical ones name that provider."""
    hit = is_passthrough()
    technical = T.is_technical(F.col("source_text"))
    named = F.when(hit & (technical | (F.coalesce("provider", F.lit("")) == "")), F.lit("passthrough")).otherwise(F.col("provider"))
    return memory.withColumns({"provider": named, "translated_text": F.when(hit, F.col("source_text")).otherwise(F.col("translated_text")), "status": F.when(hit, "confirmed").otherwise(F.col("status"))})


def cleaned(memory: DataFrame, collation: str = COLLATION) -> DataFrame:
    """Duplicates, then junk removed, then passthrough rows confirmed."""
    return passthrough_confirmed(purged(deduplicated(memory, collation)))


def healed(memory: DataFrame) -> DataFrame:
    """Passthrough rows as ``passthrough_confirmed``; the other automatic rows get their polished translation."""
    settled = passthrough_confirmed(memory)
    better = T.polish(F.col("source_text"), F.col("translated_text"))
    return settled.withColumn("translated_text", F.when(F.col("status") == "auto", better).otherwise(F.col("translated_text")))


def review_score(df: DataFrame | None = None) -> Column:
    s, t = F.col("source_text"), F.col("translated_text")
    base = F.when(F.col("status") == "confirmed", 400).when(F.col("status") == "edited", 300).when(F.col("status") == "auto", 200).when(F.col("status") == "missing", 0).otherwise(100)
    return base + F.when((t != "") & (t != s), 50).otherwise(0) + F.when(s == T.canonical_source(s), 10).otherwise(0)


def review_rows(rows: DataFrame) -> DataFrame:
    """Review rows without the automatic and missing ones that a better near-duplicate of their language pair replaces.

    Empty sources are no duplicates of each other; edited and confirmed rows always stay. The best
    row of a text is found by a partial aggregate, so a text of many rows is in no one task.
    """
    k = T.canonical_source(F.col("source_text"))
    keyed = rows.withColumns({"_k": k, "_own": F.when(k == "", F.col("id")), "_score": F.struct(review_score(), F.col("id"))})
    names = ["source_lang", "target_lang", "_k", "_own"]
    best = keyed.groupBy(*names).agg(F.max("_score").alias("_best")).select(*[F.col(c).alias(f"_b{c}") for c in names], "_best")
    j = keyed.filter(F.col("status").isin("auto", "missing") | F.col("status").isNull()).join(best, [F.col(c).eqNullSafe(F.col(f"_b{c}")) for c in names]).filter(F.col("_score") == F.col("_best"))
    stay = keyed.filter(~F.col("status").isin("auto", "missing"))
    return stay.select(*rows.columns).unionByName(j.select(*rows.columns))


def maintenance_counts(memory: DataFrame, collation: str = COLLATION) -> DataFrame:
    """``deduped``, ``purged``, ``confirmed``: what each step of ``cleaned`` takes or changes."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    unique = deduplicated(memory, collation).withColumns({"_junk": junk_kind(memory).isNotNull(), "_pass": is_passthrough()})
    after = unique.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_junk"), 1)).alias("purged"), F.count(F.when(~F.col("_junk") & F.col("_pass"), 1)).alias("confirmed"))
    return one(memory, "m").join(F.broadcast(after)).select((F.col("m") - F.col("n")).alias("deduped"), "purged", "confirmed")
