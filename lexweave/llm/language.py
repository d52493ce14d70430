"""Problem 7: the language of documents and of the segments of mixed ones.

Method: prediction by partial matching. One variable-order byte context tree per language, trained
on a bounded sample of labelled rows and then frozen, gives each word an exact code length with
escape probabilities; a segment belongs to the language that codes it in the fewest bits. Contexts
reach back to the blank before a word, so each distinct word is coded once per task.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import WORD, words
from lexweave.llm.forms import INVISIBLE, LIGATURES, fold_table, same_form
from lexweave.plans.lineage import shared, spread

LANGS = ("de", "en", "es", "fr")
# Further codes of the languages; regional forms such as de-DE keep their first part.
LONG_CODES = {"deu": "de", "ger": "de", "german": "de", "eng": "en", "english": "en", "spa": "es", "spanish": "es", "fra": "fr", "fre": "fr", "french": "fr"}
#: Labelled rows per language that the models are trained on.
SAMPLE = 3000
#: Rows, taken by hash, among which the sample is ranked.
AMONG = 50_000
ORDER = 4
#: Bits by which a text or sentence must favour another language, and by which a language must be ahead.
CLEAR_BITS, SENTENCE_BITS = 16.0, 20.0
#: Bits of each segment that do not count for a mixture.
PART_BITS = 4.0
#: Words without digits that a text needs before its label is called wrong; codes and names tell no language.
LEAST_WORDS = 3
MOST_CACHED = 200_000
#: Texts shorter than this teach nothing.
SHORTEST = 12

_FOLD = {ord(c): plain for c, plain in zip_longest(*fold_table(), fillvalue="")}
BREAK = re.compile(r"(?<=[.!?…])[\s\"'»“”)*>]+|\n+")


def label_language(label: Column) -> Column:
    """``de``, ``en``, ``es`` or ``fr`` for a label that names one of them in any usual form, else null."""
    code = F.regexp_replace(F.lower(F.trim(label)), "[-_].*$", "")
    known = F.create_map(*[F.lit(x) for kv in {**{x: x for x in LANGS}, **LONG_CODES}.items() for x in kv])
    return F.try_element_at(known, F.coalesce(code, F.lit("")))


def names_language(label: Column) -> Column:
    """Whether a label looks like the code of any language; the codes for none do not."""
    code = F.lower(F.trim(label))
    nothing = ("und", "auto", "n/a", "na", "none", "null", "unknown", "mul", "mis", "zxx", "xx", "xxx", "unk")  # fixed values
    return F.coalesce(code.rlike("^[a-z]{2,3}([-_][a-z0-9]{2,8})*$|^[a-z]{4,}$") & ~code.isin(*nothing), F.lit(False))


class ContextTree:
    """Frozen byte statistics of one language: symbols after contexts of up to four bytes."""

    def __init__(self, counts: Mapping[bytes, int]) -> None:
        seen: Counter = Counter()
        for word, n in counts.items():
            data = b" " + word + b" "
            for i in range(1, len(data)):
                for k in range(min(ORDER, i) + 1):
                    seen[k, data[i - k : i + 1]] += n
        self.symbols = {s: n for (k, s), n in seen.items() if k < ORDER or n > 1}
        self.contexts: dict[bytes, tuple[int, int]] = {}
        for s, n in self.symbols.items():
            total, kinds = self.contexts.get(s[:-1], (0, 0))
            self.contexts[s[:-1]] = (total + n, kinds + 1)

    def cost(self, run: bytes) -> float:
        """Code length of the last byte of ``run`` after the others, at most ``ORDER``."""
        p = 1.0
        for k in range(len(run)):
            seen = self.contexts.get(run[k:-1])
            if seen is None:
                continue
            n = self.symbols.get(run[k:])
            if n is not None:
                p *= n / (seen[0] + seen[1])
                break
            p *= seen[1] / (seen[0] + seen[1])
        else:
            p /= 256
        return -math.log2(p)

    def bits(self, word: bytes) -> float:
        """Code length of a word and the blank after it."""
        return sum(map(self.cost, runs(word)))


def runs(word: bytes) -> list[bytes]:
    """Each byte of a word and the blank after it, behind the bytes that its code length depends on."""
    data = b" " + word + b" "
    return [data[max(0, i - ORDER) : i + 1] for i in range(1, len(data))]


class Scorer:
    """Code lengths of words under every language, each distinct word coded once and each run of bytes in all words; words with digits count nothing."""

    def __init__(self, trees: Mapping[str, ContextTree]) -> None:
        self.trees, self.cache, self.costs = [trees[x] for x in LANGS], {}, {}

    def row(self, word: str) -> list[float]:
        if not word.isalpha():
            return [0.0] * len(self.trees)
        if len(self.costs) > MOST_CACHED:
            self.costs.clear()
        return [sum(x) for x in zip(*[self.costs.get(r) or self.costs.setdefault(r, [t.cost(r) for t in self.trees]) for r in runs(word.encode())], strict=True)]

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.cache) > MOST_CACHED:
            self.cache.clear()
        which, unique = pd.factorize(np.array(words, dtype=object))
        rows = []
        for w in unique:
            row = self.cache.get(w)
            if row is None:
                row = self.cache[w] = self.row(w)
            rows.append(row)
        return np.array(rows)[which]


def spans(text: str) -> list[tuple[int, int]]:
    """Where the sentences and lines of a text begin and end."""
    at, out = 0, []
    for m in BREAK.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    return [(i, j) for i, j in [*out, (at, len(text))] if text[i:j].strip()]


def origins(text: str, plain: str) -> list[int]:
    """For each place in the plain form, and its end, the place in ``text`` that it comes from."""
    if text == plain:
        return list(range(len(text) + 1))
    out: list[int] = []
    i = 0
    while i < len(text) and len(out) < len(plain):
        j = i + 1
        # A letter and the marks after it become one; what is invisible between them vanishes.
        while j < len(text) and (unicodedata.combining(text[j]) or text[j] in INVISIBLE):
            j += 1
        folded = "".join(LIGATURES.get(c, c) for c in text[i:j].translate(_FOLD))
        one = unicodedata.normalize("NFC", folded)
        n = len(one) if plain.startswith(one, len(out)) else len(folded)
        out += [i] * n
        i = j
    return [*out, *[len(text)] * (len(plain) + 1 - len(out))]


def flat_bits(texts: list[list[str]], scorer: Scorer) -> np.ndarray:
    """Code lengths of all segments of all texts, one row each."""
    own = [words(s.lower()) for t in texts for s in t]
    flat = [w for s in own for w in s]
    if not flat:
        return np.zeros((len(own), len(LANGS)))
    ends = np.vstack([np.zeros(len(LANGS)), np.cumsum(scorer.of(flat), axis=0)])
    cuts = np.cumsum([0, *map(len, own)])
    return ends[cuts[1:]] - ends[cuts[:-1]]


def scored(texts: list[list[str]], scorer: Scorer) -> list[np.ndarray]:
    """For each text a matrix of code lengths, one row per segment."""
    return np.split(flat_bits(texts, scorer), np.cumsum([len(t) for t in texts])[:-1]) if texts else []


def trained(df: DataFrame, sample: int = SAMPLE, among: int = AMONG) -> dict[str, ContextTree]:
    """Context trees from at most ``sample`` different texts a label, the first by hash of about ``among`` rows; mislabelled ones leave before the second training."""
    every = max(1, df.count() // among)
    both = [df.select(label_language(F.col(label)).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h")) for label, text in (("source_lang", "source_text"), ("target_lang", "translated_text"))]
    # The hash leaves few texts; only their labels are read.
    few = both[0].unionByName(both[1]).filter((F.pmod("h", F.lit(every)) == 0) & (F.length("text") >= SHORTEST) & F.col("lang").isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    # A text stored many times is one text of the sample.
    rows = few.distinct().withColumn("rank", rank).filter(F.col("rank") <= sample).select("lang", same_form(F.col("text")).alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for r in rows:
        texts.setdefault(r.lang, []).append(r.text)

    def fit(of: Mapping[str, list[str]]) -> dict[str, ContextTree]:
        return {x: ContextTree(Counter(w.encode() for t in of.get(x, ()) for w in words(t.lower()) if w.isalpha())) for x in LANGS}

    first = Scorer(fit(texts))
    kept = {}
    for x, own in texts.items():
        bits = [m.sum(0) for m in scored([[t] for t in own], first)]
        kept[x] = [t for t, b in zip(own, bits, strict=True) if b[LANGS.index(x)] <= b.min() + CLEAR_BITS]
    return fit(kept)


def judged(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of code lengths the place of the best language and its confidence."""
    return bits.argmin(1), 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)


def mixture(m: np.ndarray) -> tuple[str, ...]:
    """Languages whose segments, each in it rather than in any other, together tell it clearly; one entry or none if not mixed.

    The bits of a language add up over its segments; a segment that comes again adds nothing.
    """
    if len(m) < 2:
        return ()
    clear = _clear(m)
    if len(clear) > 1:
        clear = _clear(np.unique(np.round(m, 6), axis=0))
    return tuple(sorted(clear)) if len(clear) > 1 else ()


def _clear(m: np.ndarray) -> list[str]:
    two = np.partition(m, 1, axis=1)
    ahead = np.maximum(two[:, 1] - two[:, 0] - PART_BITS, 0)
    sums = np.bincount(m.argmin(1), weights=ahead, minlength=len(LANGS))
    return [LANGS[i] for i in np.nonzero(sums >= SENTENCE_BITS - PART_BITS)[0]]


def label_bits(df: DataFrame, label: str) -> np.ndarray:
    """Code length of each language as a label of all rows, for texts that tell nothing themselves."""
    seen = {r.lang: r["n"] for r in df.groupBy(label_language(F.col(label)).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.array([seen.get(x, 0) + 1.0 for x in LANGS])
    return -np.log2(counts / counts.sum())


OUT = "id long, field string, segment int, begin int, end int, lang string, confidence double, issue string"
_NAMES = np.array([*LANGS, None], object)


def _languages(df: DataFrame, of: DataFrame, id_col: str, sample: int, issues: bool) -> DataFrame:
    """Language rows of the texts of ``of`` by the labelled texts of ``df``, with the ``issue`` that a row tells of, if any; only those with one if ``issues``."""
    trees = shared(df.sparkSession, trained(df, sample))
    prior = {f: label_bits(df, f) for f in ("source_lang", "target_lang")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(trees())
        for pdf in batches:
            for field, side in (("source_lang", "source"), ("target_lang", "target")):
                held = pdf[pdf[side].notna()]
                if len(held):
                    told = held["label"] if side == "source" else pd.Series([None] * len(held))
                    yield field_rows(field, held["id"].to_numpy(), held[f"{side}_raw"].tolist(), held[side].tolist(), told.tolist(), held[f"has_{side}"].to_numpy(bool), scorer, prior[field], issues)

    rows = spread(of).select(
        F.col(id_col).cast("long").alias("id"),
        label_language(F.col("source_lang")).alias("label"),
        names_language(F.col("source_lang")).alias("has_source"),
        names_language(F.col("target_lang")).alias("has_target"),
        F.col("source_text").alias("source_raw"),
        F.col("translated_text").alias("target_raw"),
        same_form(F.col("source_text")).alias("source"),
        same_form(F.col("translated_text")).alias("target"),
    )
    return rows.mapInPandas(run, OUT)


def field_rows(field: str, ids: np.ndarray, originals: list[str], texts: list[str], labels: list[str | None], named: np.ndarray, scorer: Scorer, prior: np.ndarray, issues: bool) -> pd.DataFrame:
    """The rows of the texts of one field, each in its plain form and as stored: one for the whole, one for each segment."""
    wordless = np.array([not WORD.search(t) for t in texts])
    cuts = [[] if w else spans(t) for t, w in zip(texts, wordless, strict=True)]
    counts = np.array([len(c) for c in cuts])
    m = flat_bits([[t[i:j] for i, j in c] for t, c in zip(texts, cuts, strict=True)], scorer)
    text_of = np.repeat(np.arange(len(texts)), counts)
    starts = np.cumsum(counts) - counts
    total = np.zeros((len(texts), len(LANGS)))
    np.add.at(total, text_of, m)
    lang, sure = judged(total + prior)
    issue = np.full(len(texts), None, object)
    part_issue = np.full(len(m), None, object)
    own, own_sure = judged(m) if len(m) else (np.zeros(0, int), np.zeros(0))
    # A segment that tells nothing itself is in the language of its text.
    silent = ~m.any(1)
    own, own_sure = np.where(silent, lang[text_of], own), np.where(silent, sure[text_of], own_sure)
    issue[~named & ~wordless] = "missing"
    if field == "source_lang":
        mixed = np.zeros(len(texts), bool)
        for k in _maybe_mixed(m, text_of, len(texts)):
            part = slice(starts[k], starts[k] + counts[k])
            mix = mixture(m[part])
            mixed[k] = bool(mix)
            part_issue[part] = ["mixed" if LANGS[x] in mix and not s else None for x, s in zip(own[part], silent[part], strict=True)]
        told = np.array([LANGS.index(x) if x in LANGS else -1 for x in labels])
        against = total[np.arange(len(texts)), told] - total.min(1) >= CLEAR_BITS
        for k in np.nonzero(named & ~wordless & ~mixed & (told >= 0) & (lang != told) & against)[0]:
            if sum(w.isalpha() for w in words(texts[k])) >= LEAST_WORDS:
                issue[k] = "wrong"
    whole = pd.DataFrame({"id": ids, "field": field, "segment": 0, "begin": 0, "end": [len(x) for x in originals], "lang": _NAMES[np.where(wordless, -1, lang)], "confidence": np.where(wordless, 0.0, sure), "issue": issue})
    at = np.array([x for c in cuts for x in c], np.int64).reshape(-1, 2)
    if not issues:
        for k, (original, text) in enumerate(zip(originals, texts, strict=True)):
            if original != text and counts[k]:
                part = slice(starts[k], starts[k] + counts[k])
                at[part] = np.array(origins(original, text))[at[part]]
    parts = pd.DataFrame({"id": ids[text_of], "field": field, "segment": np.arange(len(m)) - starts[text_of] + 1, "begin": at[:, 0], "end": at[:, 1], "lang": _NAMES[own], "confidence": own_sure, "issue": part_issue})
    return pd.concat([x[x["issue"].notna()] if issues else x for x in (whole, parts)])


def _maybe_mixed(m: np.ndarray, text_of: np.ndarray, texts: int) -> np.ndarray:
    """Texts for whose segments two languages add up to enough, before repeated segments are looked for."""
    if not len(m):
        return np.zeros(0, int)
    two = np.partition(m, 1, axis=1)
    sums = np.zeros((texts, len(LANGS)))
    np.add.at(sums, (text_of, m.argmin(1)), np.maximum(two[:, 1] - two[:, 0] - PART_BITS, 0))
    return np.nonzero((sums >= SENTENCE_BITS - PART_BITS).sum(1) > 1)[0]


def languages(df: DataFrame, id_col: str = "id", sample: int = SAMPLE) -> DataFrame:
    """``id``, ``field``, ``segment``, ``begin``, ``end``, ``lang``, ``confidence``: the language of every text and of each of its sentences or lines.

    Segment 0 is the whole text; ``begin`` and ``end`` are places in the text as it is stored.
    A text without a word has no language, with confidence 0; null texts get no row.
    """
    return _languages(df, df, id_col, sample, False).drop("issue")


def language_issues(df: DataFrame, id_col: str = "id", sample: int = SAMPLE) -> DataFrame:
    """``id``, ``field``, ``issue`` (missing, wrong, mixed), ``lang``, ``confidence``, from the rows of ``languages``.

    ``missing``: the label is null, blank or names no language; texts without a word get no row, all
    others the language that codes them best. ``wrong``: the label names another language than the
    whole source text is in. ``mixed``: sentences in two languages, one row each, as sure as the
    surest of its sentences. Null texts have no issue.
    """
    # A translation whose label names a language has no issue, so it isn't scored here.
    of = df.withColumn("translated_text", F.when(~names_language(F.col("target_lang")), F.col("translated_text")))
    rows = _languages(df, of, id_col, sample, True)
    return rows.groupBy("id", "field", "issue", "lang").agg(F.max("confidence").alias("confidence"))
