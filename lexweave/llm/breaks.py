"""Problem 1: translations that stop before their end.

Method: length histograms in characters and bytes, per provider; a spike is a length at which far
more texts without terminal punctuation end than at the lengths around it. A text without an end at
such a length is cut unless it ends like its source or lacks the full stop only. Texts cut in
transfer end at any length, which no histogram shows, so the method alone can't list them: every
text is also held against its source, for leftovers at the break, for a last sentence that no
complete translation ends like, and, by a stack of delimiters, for a bracket, quote or fence left open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import words
from lexweave.llm.forms import WORD, same_form
from lexweave.llm.phrases import Phrases
from lexweave.llm.residue_terms import NOTICES, PLACEHOLDER, PLACEHOLDER_SIGN, REFUSALS
from lexweave.plans.lineage import keep, spread

ENDED = r"[.!?…:;][\s\"'»“”’)\]>*]*$"
_ENDS = (".", "!", "?", "…")
_ENDED = re.compile(r"[.!?…][\s\"'»“”’)\]>*]*$")
#: What may stay or be put where a text broke off.
_LEFT = re.compile(r"(?:\s*(?:\[(?:\.\.\.|…)\]|\((?:\.\.\.|…)\)|…|\.\.\.+|\s&#?\w{0,8};?|</?[^<>]{0,30}|�+|\\u?[0-9a-fA-F]{0,4}|(?<=\w)-|\[(?:truncated|cut|more|gekürzt|tronqué|cortado)\]|\((?:truncated|more|cont\.?|continued)\)))+\s*$")
#: What stays at the end of a text, its last piece, is no longer than this, and ends in one of these or holds one of those.
_LEFT_PIECE, _LEFT_ENDS, _LEFT_SIGNS = 40, ("]", ")", "…", "...", "�", "-"), re.compile(r"[&<\\]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\s\"'»“”’)]+")
_WORD = re.compile(r"[^\W_]+")
_EDGE = " \t\r\n\"'»«“”„’)(]>*;<"
# Kinds of delimiters: brackets close what they name, quotes what any quote of their kind opened.
_BRACKETS = {")": "(", "]": "[", "}": "{"}
_DELIMITERS = re.compile(r"```|(?<![:;=])(?<![:;=]-)\(|[\[{)\]}«»„“”\"]")
DELIMITED = r"[(\[{«»\u201c-\u201e\"]"
#: Backwards: what may follow a sentence, its end and its last word.
END_WORD = r"(?=[!\").?'»\u2019-\u201d])(?<=^|[\s\p{Zs}]|^[\u0085\u2028\u2029])[\"'»“”’)]*+(?:[.!?]|[!?][ \u00a0])([\p{L}\p{N}\p{M}\p{Cf}]++)"
#: Characters at the end of a text among which a sign of a break is looked for: it, twelve more and a line end.
LAST = 15
#: Texts without an end at a length, against the mean of those around it, that make a spike.
SPIKE_LEAST, SPIKE_TIMES, AROUND = 8, 4.0, 8
#: Share of the length expected from its source under which a last sentence is too short.
SHORT = 0.66
#: The same at a spike, where most texts without an end are cut: what is missing is the full stop only.
SHORT_AT_SPIKE = 0.9
#: Sentences of complete texts that must end with a word to make it a usual one.
LEAST_ENDS = 3
#: Notices and refusals stop where they do.
_EXCUSED = Phrases((*NOTICES, *REFUSALS))


def length_spikes(df: DataFrame, source: Column, text: Column) -> DataFrame:
    """``source``, ``unit``, ``length``, ``open_texts``, ``all_texts``: lengths at which texts of a source are cut.

    Counts of all rows; texts without terminal punctuation are held against those of the lengths nearby.
    """
    one = df.filter(text.isNotNull()).groupBy(F.coalesce(source, F.lit("")).alias("source"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes")).agg(F.count(F.lit(1)).alias("all_texts"), F.count(F.when(~text.rlike(ENDED), 1)).alias("open_texts"))
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("u")
    # Written once: a row for each length, which its neighbours read again.
    by = keep(one.select("source", units, "all_texts", "open_texts").groupBy("source", F.col("u.unit").alias("unit"), F.col("u.length").alias("length")).agg(F.sum("all_texts").alias("all_texts"), F.sum("open_texts").alias("open_texts")))
    near = by.filter("open_texts > 0").select("source", "unit", F.explode(F.sequence(F.col("length") - AROUND, F.col("length") + AROUND)).alias("length"), F.col("length").alias("from"), "open_texts")
    around = near.filter(F.col("from") != F.col("length")).groupBy("source", "unit", "length").agg((F.sum("open_texts") / (2 * AROUND)).alias("usual"))
    spiked = by.filter(F.col("open_texts") >= SPIKE_LEAST).join(around, ["source", "unit", "length"], "left").filter(F.col("open_texts") > SPIKE_TIMES * (F.coalesce("usual", F.lit(0.0)) + 1))
    return spiked.select("source", "unit", "length", "open_texts", "all_texts")


def end_words(df: DataFrame, text: Column, lang: Column) -> DataFrame:
    """``lang``, ``word``: words that sentences of complete texts end with, counted over all rows."""
    # Read from the end of the text, where only a sign can begin a match, words are not tried in vain.
    last = F.explode(F.regexp_extract_all(F.reverse(text), F.lit(END_WORD), F.lit(1))).alias("raw")
    seen = df.filter(text.rlike(ENDED)).select(F.coalesce(lang, F.lit("")).alias("lang"), last).groupBy("lang", "raw").agg(F.count(F.lit(1)).alias("n"))
    # one plain form for each distinct word, not for each text
    rows = seen.select("lang", F.lower(same_form(F.reverse("raw"))).alias("word"), "n").filter(F.col("word").rlike(r"^\p{L}+$"))
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_ENDS).select("lang", "word")


def core(text: str) -> str:
    return text.strip(_EDGE)


def leftover(text: str) -> re.Match[str] | None:
    """What stays at the end of a text, from its first piece; ``text`` doesn't end in a blank."""
    # Where nothing stays the end alone tells so; the whole text is searched where something does.
    at = max(0, len(text) - _LEFT_PIECE)
    if not text.endswith(_LEFT_ENDS) and not _LEFT_SIGNS.search(text, at):
        return None
    return _LEFT.search(text) if _LEFT.search(text, at) else None


def ended(text: str) -> bool:
    """Whether a text has an end of its own; most tell it by their last character."""
    return text[-1:] in _ENDS or not text[-1:].isalnum() and bool(_ENDED.search(text))


def delimited(text: Column) -> Column:
    return text.rlike(DELIMITED) | text.contains("```")


def open_delimiters(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Delimiters that ``text`` leaves open, from the outermost, and all that it opens: kind, number among its kind, place.

    Closing ones without an opening one, as in ``a)`` or ``5"``, count nothing; an opening one that an
    outer pair closes over is none.
    """
    stack: list[tuple[str, int, int]] = []
    opened: list[tuple[str, int, int]] = []
    masked = PLACEHOLDER.sub(lambda m: "x" * len(m.group()), text) if PLACEHOLDER_SIGN.search(text) else text
    for m in _DELIMITERS.finditer(masked):
        x, at = m.group(), m.start()
        if x in _BRACKETS:
            kind, opens, closes = _BRACKETS[x], False, True
        elif x in "([{":
            kind, opens, closes = x, True, False
        elif x == "```":
            kind, opens, closes = x, True, True
        else:
            # A quote closes an open one; “ and the angles open or close by the language.
            before = masked[at - 1] if at else " "
            kind, closes = "quote", x != "„"
            opens = x != "”" and (x != '"' or not before.isalnum() and masked[m.end() :][:1].strip() != "")
        held = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == kind), None)
        if closes and held is not None:
            del stack[held:]
        elif opens:
            stack.append((kind, sum(k == kind for k, _, _ in opened), at))
            opened.append(stack[-1])
    return stack, opened


def inside_delimiters(source: str, target: str) -> bool:
    """Whether ``target`` stops inside a bracket, quote or fence that ``source`` opens too and closes."""
    left, _ = open_delimiters(target)
    if not left or not _WORD.search(target):
        return False
    unclosed, opened = open_delimiters(source)
    theirs = {(kind, k): at for kind, k, at in opened}
    if _EXCUSED.within(target.lower()):
        return False
    whole = ended(target.rstrip())
    for kind, k, at in left:
        if (kind, k) in theirs and not any(x == kind for x, _, _ in unclosed):
            # A text with an end of its own may just have lost the sign; it is cut where words are missing too.
            rest, full = len(target.rstrip()) - at, len(source.rstrip()) - theirs[kind, k]
            if not whole or rest < SHORT * full:
                return True
    return False


def breaks_off(source: str, target: str, usual_end: bool, at_spike: bool) -> bool:
    """Whether ``target`` stops within a sentence although ``source`` is complete. ``usual_end``: complete texts of the language end with its last word."""
    s, t = core(source), core(target)
    if not _WORD.search(t) or not s:
        return False
    low = t.lower()
    if _EXCUSED.within(low):
        return False
    open_source = s.endswith(("…", "...")) or bool(leftover(s))
    left = leftover(target.rstrip())
    body = core(target[: left.start()]) if left else t
    if left and not open_source and not PLACEHOLDER.search(target[left.start() - 1 if left.start() else 0 :]):
        return not ended(body) or bool(re.search(r"[\[&<�]", left.group()))
    if ended(t) or s[-4:] == t[-4:] or open_source and left or words(s.lower()) == words(low):
        return False
    places = list(PLACEHOLDER.finditer(t)) if PLACEHOLDER_SIGN.search(t) else []
    if places and places[-1].end() >= len(t) - 1:
        return False
    if not ended(s):
        return not places and (_title_breaks(s, t) or at_spike and len(t) < SHORT * len(s))
    theirs, ours = [x for x in _SENTENCE.split(s) if _WORD.search(x)], [x for x in _SENTENCE.split(t) if _WORD.search(x)]
    if len(ours) < len(theirs):
        return True
    last = words(ours[-1].lower())[-1]
    if not usual_end:
        return not (last.isdigit() and last in theirs[-1]) or len(ours[-1]) < SHORT * len(theirs[-1])
    rest_s, rest_t = len(s) - len(theirs[-1]), len(t) - len(ours[-1])
    usual = rest_t / rest_s if rest_s > 60 else 0.97
    return len(ours[-1]) < (SHORT_AT_SPIKE if at_spike else SHORT) * usual * len(theirs[-1])


def _title_breaks(s: str, t: str) -> bool:
    """Titles and field lists carry no full stop: a list with fewer fields or without its last unit, a title far too short."""
    fields = len(re.findall(r"[:=]", s))
    if fields >= 2:
        pieces = [x for x in re.split(r"[;|·•\n]|(?<!\d)[,/]|[,/](?!\d)", t) if _WORD.search(x)]
        return len(pieces) < fields or not re.search(r"[:=]\s*[^\s:=]", pieces[-1]) or bool(re.search(r"\d$", t)) and "mod" not in pieces[-1].lower()
    number = re.findall(r"\d+", s)
    return bool(number) and not re.search(r"\d", t) and len(t) < 0.8 * len(s) or len(s) >= 12 and len(t) < 0.4 * len(s)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for i, p, s, t, open_, delimited, spike, usual in pdf.itertuples(index=False):
            if open_ and breaks_off(s, t, usual, spike) or delimited and inside_delimiters(s, t):
                out.append((i, p, spike))
        yield pd.DataFrame(out, columns=["id", "source", "at_spike"])


def cut_texts(df: DataFrame, id_col: str = "id") -> DataFrame:
    """``id``, ``source``, ``at_spike`` of the rows whose ``translated_text`` breaks off.

    Not cut: null, blank and wordless texts; texts that end like their source; texts that lack only
    the full stop. A row without source text is complete. Spikes and usual last words are joined to
    the texts without an end, in any number.
    """
    text, source, lang = F.col("translated_text"), F.col("source_text"), F.coalesce(F.lower(F.substring("target_lang", 1, 2)), F.lit(""))
    spikes = length_spikes(df, F.col("provider"), text).select("source", "unit", "length")
    ends = keep(end_words(df, text, lang))
    open_ = ~text.rlike(r"[.!?](?<=[^.].)[\s\"'»“”’)*]*$") | F.substring(text, -LAST, LAST).rlike(r"[\[&<�…-][^\s]{0,12}$")
    rows = spread(df).filter(source.isNotNull() & text.isNotNull()).withColumns({"_open": open_, "_delimited": delimited(text) & delimited(source)})
    # a text with an end of its own needs no comparison, unless a delimiter may be open there
    rows = rows.filter("_open or _delimited").select(F.col(id_col).cast("long").alias("id"), F.coalesce("provider", F.lit("")).alias("source"), lang.alias("lang"), same_form(source).alias("s"), same_form(text).alias("t"), F.length(text).alias("chars"), F.octet_length(text).alias("octets"), F.col("_open").alias("open_"), F.col("_delimited").alias("delimited"))
    # the last word is the first one from the end
    rows = rows.withColumn("word", F.reverse(F.regexp_extract(F.reverse(F.lower(F.col("t"))), WORD, 0)))
    mark = lambda d, name: d.withColumn(name, F.lit(True))
    by = lambda unit, length: mark(spikes.filter(F.col("unit") == unit).select("source", F.col("length").alias(length)), f"at_{unit}")
    rows = rows.join(by("chars", "chars"), ["source", "chars"], "left").join(by("bytes", "octets"), ["source", "octets"], "left")
    # A language without any end word of its own takes those of all.
    rows = rows.join(mark(ends, "own"), ["lang", "word"], "left").join(mark(ends.select("lang").distinct(), "known"), "lang", "left").join(mark(ends.select("word").distinct(), "some"), "word", "left")
    yes = lambda *c: F.coalesce(*c, F.lit(False))
    ready = rows.select("id", "source", "s", "t", "open_", "delimited", yes("at_chars", "at_bytes").alias("spike"), F.when(yes("known"), yes("own")).otherwise(yes("some")).alias("usual"))
    return ready.mapInPandas(_cut, "id long, source string, at_spike boolean")


def cut_share(df: DataFrame, id_col: str = "id") -> DataFrame:
    """``provider``, ``rows``, ``cut``, ``at_spike``, ``share``: how often each provider's translations are cut; null counts as blank."""
    cut = cut_texts(df, id_col).groupBy("source").agg(F.countDistinct("id").alias("cut"), F.count(F.when(F.col("at_spike"), 1)).alias("at_spike"))
    all_rows = df.groupBy(F.coalesce("provider", F.lit("")).alias("provider")).agg(F.count(F.lit(1)).alias("rows"))
    j = all_rows.join(cut, all_rows.provider == cut.source, "left").na.fill(0, ["cut", "at_spike"])
    return j.select("provider", "rows", "cut", "at_spike", (F.col("cut") / F.col("rows")).alias("share"))
