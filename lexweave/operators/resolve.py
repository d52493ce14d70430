"""Which rule gives each segment its text: the precedence ladder over the memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators.memory import best_by_hash
from lexweave.operators.terms import glossary_targets, kept_phrases, phrase_key, target_of, term_originals, term_patterns


def resolve(segs: DataFrame, memory: DataFrame, glossary: DataFrame, phrases: DataFrame, budget: int | None = None) -> DataFrame:
    """``segment``, ``lang``, ``target_lang``, ``rule``, ``result``, ``status``, ``provider``, ``write``.

    ``segs`` holds the distinct ``segment``, ``lang``, ``target_lang``. The first rule that applies
    counts: ``protected`` (links, shortcodes, phrases never translated), ``passthrough`` (technical or
    already in the target language), ``exact`` (confirmed or edited row), ``affix`` (confirmed or
    edited row of the core without its edge signs), ``affix_glossary``, ``echo`` (automatic row that
    repeats its source), ``cached`` (other automatic row, polished), ``glossary``, and for the rest
    ``fetch`` within the budget of calls per language pair, else ``partial``. ``write`` marks
    results that go back to the memory.
    """
    s, src, tgt = F.col("segment"), F.col("lang"), F.col("target_lang")
    core = T.affix_split(s)
    rows = segs.withColumns({"hash": T.segment_hash(src, tgt, s), "core": core["core"], "prefix": core["prefix"], "suffix": core["suffix"]})
    rows = rows.withColumns({"core_hash": T.segment_hash(src, tgt, F.col("core")), "term": phrase_key(s), "core_term": phrase_key(F.col("core"))})
    best = best_by_hash(memory).select("hash", F.struct("translated_text", "status", "provider").alias("m"))
    sure = best.filter(F.col("m.status").isin("confirmed", "edited")).select(F.col("hash").alias("core_hash"), F.col("m").alias("c"))
    terms = glossary_targets(glossary)
    named = lambda key, out: terms.select(F.col("lang").alias("target_lang"), F.col("key").alias(key), F.struct("exact", "target").alias(out))
    keep = kept_phrases(phrases).select(F.col("key").alias("term"), F.lit(True).alias("kept"))
    rows = rows.join(best, "hash", "left").join(sure, "core_hash", "left").join(keep, "term", "left").join(named("term", "g"), ["target_lang", "term"], "left").join(named("core_term", "cg"), ["target_lang", "core_term"], "left")
    join = lambda x: F.concat("prefix", x, "suffix")
    technical, in_target = T.is_technical(s), T.already_in_target(s, src, tgt)
    stored, status = F.col("m").isNotNull(), F.col("m.status")
    term, core_term = target_of(s, F.col("g.exact"), F.col("g.target")), target_of(F.col("core"), F.col("cg.exact"), F.col("cg.target"))
    polished = F.when(status == "auto", T.polish(s, F.col("m.translated_text"))).otherwise(F.col("m.translated_text"))
    cases: list[tuple[str, Column, Column, Column, Column, Column]] = [
        ("protected", T.is_link(s) | T.is_shortcode(s) | F.col("kept"), s, F.lit(None), F.lit(None), F.lit(False)),
        ("passthrough", technical | in_target, s, F.lit("confirmed"), F.when(technical, F.lit("passthrough")).otherwise(F.coalesce("m.provider", F.lit("passthrough"))), F.lit(True)),
        ("exact", stored & status.isin("confirmed", "edited"), F.col("m.translated_text"), status, F.col("m.provider"), F.lit(False)),
        ("affix", F.col("c").isNotNull(), join(F.col("c.translated_text")), F.col("c.status"), F.when(F.coalesce("c.provider", F.lit("")) == "", "affix").otherwise(F.col("c.provider")), F.lit(True)),
        ("affix_glossary", F.col("cg").isNotNull(), join(core_term), F.lit("confirmed"), F.lit("glossary"), F.lit(True)),
        ("echo", stored & (F.col("m.translated_text") == s), s, F.lit("confirmed"), F.col("m.provider"), F.lit(True)),
        ("cached", stored, polished, status, F.when(F.coalesce("m.provider", F.lit("")) == "", "guard").otherwise(F.col("m.provider")), F.coalesce(polished != F.col("m.translated_text"), F.lit(False))),
        ("glossary", F.col("g").isNotNull(), term, F.lit("auto"), F.lit("glossary"), F.lit(True)),
    ]
    # The rule is decided once; everything else is chosen by its name.
    ruled = rows.withColumn("rule", cascade([(c[1], F.lit(c[0])) for c in cases], F.lit("fetch")))
    pick = lambda i, other: cascade([(F.col("rule") == c[0], c[i]) for c in cases], other)
    out = ruled.select("segment", "lang", "target_lang", "rule", pick(2, F.lit(None)).alias("result"), pick(3, F.lit(None)).alias("status"), pick(4, F.lit(None)).alias("provider"), pick(5, F.lit(False)).alias("write"))
    if budget is None:
        return out
    # Only the first rows of each task reach the window, so no task holds all misses of a language pair.
    w = Window.partitionBy("lang", "target_lang").orderBy("segment")
    first = out.filter("rule = 'fetch'").select("segment", "lang", "target_lang").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= budget)
    names = ["segment", "lang", "target_lang"]
    return out.join(first, names, "left").withColumn("rule", F.when((F.col("rule") == "fetch") & F.col("n").isNull(), "partial").otherwise(F.col("rule"))).drop("n")


def counters(resolved: DataFrame) -> DataFrame:
    """``hits``, ``calls``, ``hit_rate``: segments answered without a provider, and those sent to one."""
    hit = F.col("rule").isin("passthrough", "exact", "affix", "affix_glossary", "echo", "cached")
    by = resolved.agg(F.count(F.when(hit, 1)).alias("hits"), F.count(F.when(F.col("rule") == "fetch", 1)).alias("calls"))
    return by.withColumn("hit_rate", F.when(F.col("hits") + F.col("calls") > 0, F.round(100 * F.col("hits") / (F.col("hits") + F.col("calls")))).otherwise(F.lit(0.0)).cast("int"))


def cascade(cases: list[tuple[Column, Column]], other: Column) -> Column:
    out = F.when(*cases[0])
    for c in cases[1:]:
        out = out.when(*c)
    return out.otherwise(other)


def fetched(todo: DataFrame, transform: Callable[[str, str, str], str], glossary: DataFrame | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """``segment``, ``lang``, ``target_lang``, ``result``, ``error`` of a provider called once for each masked segment.

    Links, shortcodes, protected terms (if ``glossary`` and ``phrases`` are given) and numbers are
    masked before the call and put back after it, terms as the glossary has them, and the result is
    polished; an exception becomes the row's error and no result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, a, b in zip(pdf["masked"], pdf["lang"], pdf["target_lang"], strict=True):
                try:
                    out.append((transform(text, a, b), None))
                except Exception as x:  # noqa: BLE001
                    out.append((None, str(x)))
            yield pdf.assign(raw=[x[0] for x in out], error=[x[1] for x in out])

    rows = todo.select("segment", "lang", "target_lang", T.mask(F.col("segment"), T.LINK, "BTL").alias("l"))
    rows = rows.withColumn("s", T.mask(F.col("l.masked"), T.SHORTCODE, "BTS"))
    if glossary is not None and phrases is not None:
        rows = rows.join(term_patterns(phrases, glossary), "target_lang", "left")
        masked = F.when(F.col("term_pattern").isNotNull(), T.mask(F.col("s.masked"), F.col("term_pattern"), "BTX"))
        rows = rows.withColumn("x", F.coalesce(masked, F.struct(F.col("s.masked").alias("masked"), F.array().cast("array<string>").alias("originals"))))
        back_to = F.coalesce(term_originals(F.col("x.originals"), F.coalesce("term_targets", F.create_map().cast("map<string,string>"))), F.array().cast("array<string>"))
    else:
        rows = rows.withColumn("x", F.struct(F.col("s.masked").alias("masked"), F.array().cast("array<string>").alias("originals")))
        back_to = F.col("x.originals")
    rows = rows.withColumn("n", T.mask_numbers(F.col("x.masked")))
    rows = rows.select("segment", "lang", "target_lang", F.col("n.masked").alias("masked"), F.col("l.originals").alias("l"), F.col("s.originals").alias("s"), back_to.alias("x"), F.col("n.originals").alias("n"))
    schema = "segment string, lang string, target_lang string, masked string, l array<string>, s array<string>, x array<string>, n array<string>, raw string, error string"
    got = rows.mapInPandas(run, schema)
    back = F.col("raw")
    for name, prefix in (("n", "BTN"), ("x", "BTX"), ("s", "BTS"), ("l", "BTL")):
        back = T.unmask(back, F.col(name), prefix)
    return got.select("segment", "lang", "target_lang", T.let(back, lambda x: T.polish(F.col("segment"), x)).alias("result"), "error")


def answered(out: DataFrame) -> DataFrame:
    """What a fetch means for the memory: an echo of the source is confirmed as it is, other results are automatic, errors change nothing."""
    echo = F.col("result") == F.col("segment")
    ok = out.filter(F.col("error").isNull() & (F.col("result") != ""))
    return ok.select(F.col("lang").alias("source_lang"), "target_lang", F.col("segment").alias("source_text"), F.col("result").alias("translated_text"), F.when(echo, "confirmed").otherwise("auto").alias("status"), F.when(echo, "passthrough").otherwise("provider").alias("provider"), echo.alias("force"))


def stub(text: str, source: str, target: str) -> str:
    """A provider without network: the same text, marked with its target language."""
    return f"[{target}] {text}"
