"""Glossary and phrases that are never translated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def phrase_key(phrase: Column) -> Column:
    """Phrases meet without regard to ASCII case and outer blanks."""
    return F.translate(F.trim(phrase), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def glossary_map(glossary: DataFrame) -> DataFrame:
    """``lang``, ``key``, ``source``, ``target``: one entry per language and source as written, the least target of a repeated one.

    Blank and comment lines and entries without a target are no entries. Sources that differ in case
    only are entries of their own with one key.
    """
    rows = glossary.select(F.trim("lang").alias("lang"), F.trim("source").alias("source"), F.trim("target").alias("target")).filter((F.col("source") != "") & (F.col("target") != "") & ~F.col("source").startswith("#"))
    return rows.groupBy("lang", "source").agg(F.min("target").alias("target")).select("lang", phrase_key(F.col("source")).alias("key"), "source", "target")


def glossary_targets(glossary: DataFrame, name: str = "target") -> DataFrame:
    """``lang``, ``key``, ``exact`` (source as written to target) and ``name``, the target of the first other entry: the longest, then in text order."""
    order = F.struct(-F.length("source"), F.col("source"))
    by = glossary_map(glossary).groupBy("lang", "key").agg(F.map_from_entries(F.collect_list(F.struct("source", "target"))).alias("exact"), F.min_by("target", order).alias(name))
    return by


def target_of(text: Column, exact: Column, first: Column) -> Column:
    """The glossary's text for a whole segment: the entry written alike, else the first one but for case."""
    return F.coalesce(F.try_element_at(exact, F.trim(text)), first)


def kept_phrases(phrases: DataFrame) -> DataFrame:
    """``key``: the phrases without blanks, comments and repeats."""
    return phrases.select(phrase_key(F.col("phrase")).alias("key")).filter((F.col("key") != "") & ~F.col("key").startswith("#")).distinct()


def whole_matches(texts: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """Rows whose whole text is such a phrase."""
    return texts.withColumn("_k", phrase_key(F.col(text))).join(kept_phrases(phrases).withColumnRenamed("key", "_k"), "_k", "left_semi").drop("_k")


def translated_terms(texts: DataFrame, text: str, lang: str, glossary: DataFrame) -> DataFrame:
    """Rows whose whole text the glossary of their language holds, with ``glossary_target``: the entry written alike before others."""
    g = glossary_targets(glossary, "_first").select(F.col("lang").alias("_lang"), F.col("key").alias("_k"), F.col("exact").alias("_exact"), "_first")
    rows = texts.withColumns({"_k": phrase_key(F.col(text)), "_lang": F.lower(F.col(lang))}).join(g, ["_lang", "_k"])
    return rows.withColumn("glossary_target", target_of(F.col(text), F.col("_exact"), F.col("_first"))).drop("_k", "_lang", "_exact", "_first")


def protected_phrases(phrases: DataFrame, glossary: DataFrame) -> DataFrame:
    """``lang``, ``phrase``: what must not be translated word by word, for each language of the glossary: the kept phrases and its sources."""
    kept = phrases.select(F.trim("phrase").alias("phrase")).filter((F.col("phrase") != "") & ~F.col("phrase").startswith("#")).distinct()
    g = glossary_map(glossary)
    return kept.join(F.broadcast(g.select("lang").distinct())).select("lang", "phrase").unionByName(g.select("lang", F.col("source").alias("phrase"))).distinct()


def term_patterns(phrases: DataFrame, glossary: DataFrame) -> DataFrame:
    """``target_lang``, ``term_pattern``, ``term_targets``: one row per language, its protected phrases as one pattern, the longest first, and the texts that replace them by key.

    Both tables are lines of a site's settings; what is gathered are the lines of one language.
    """
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.length("phrase")).alias("n"), "phrase"))), lambda x: F.concat(F.lit(r"\Q"), F.replace(x["phrase"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    by = protected_phrases(phrases, glossary).groupBy(F.col("lang").alias("target_lang")).agg(F.concat(F.lit("(?iu:"), F.array_join(order, "|"), F.lit(")")).alias("term_pattern"))
    first = F.struct(-F.length("source"), F.col("source"))
    each = glossary_map(glossary).groupBy("lang", "key").agg(F.min_by("target", first).alias("target"))
    targets = each.groupBy(F.col("lang").alias("target_lang")).agg(F.map_from_entries(F.collect_list(F.struct("key", "target"))).alias("term_targets"))
    return by.join(targets, "target_lang", "left")


def term_originals(found: Column, targets: Column) -> Column:
    """What masked phrases become again: the glossary's text, else themselves."""
    return F.transform(found, lambda o: F.coalesce(F.try_element_at(targets, phrase_key(o)), o))


def contained(texts: DataFrame, id_col: str, text: str, phrases: DataFrame) -> DataFrame:
    """``id``, ``key``, ``times``: phrases inside longer texts, word for word, counted.

    Each text gives its runs of as many words as phrases have, and the runs meet the phrases by
    equality, so no text is held against every phrase.
    """
    keys = kept_phrases(phrases).select(F.array_join(F.regexp_extract_all("key", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ").alias("key")).filter("key <> ''").distinct()
    lengths = sorted(r.n for r in keys.select(F.size(F.split("key", " ")).alias("n")).distinct().collect())
    tokens = F.regexp_extract_all(phrase_key(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = texts.select(F.col(id_col).alias("id"), tokens.alias("t")).filter(F.size("t") > 0)

    def run_of(n: int) -> Column:
        return F.transform("t", lambda x, i: F.when(i + n <= F.size("t"), F.array_join(F.slice("t", i + 1, F.lit(n)), " ")))

    if not lengths:
        return rows.select("id", F.lit("").alias("key"), F.lit(0).cast("long").alias("times")).limit(0)
    each = rows.select("id", F.explode(F.concat(*[run_of(n) for n in lengths])).alias("key")).filter(F.col("key").isNotNull())
    return each.join(keys, "key", "left_semi").groupBy("id", "key").agg(F.count(F.lit(1)).alias("times"))
