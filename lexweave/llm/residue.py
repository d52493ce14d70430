"""Problem 4: placeholders, filler and error pages in place of translations.

Method: labels spread among the segments of all translations, with digits masked. Two kinds of
segments bear a trusted label: those that many rows hold although their translations are as long as
their sources by chance only, since what stands for any source renders none, and those that say what
inspected notices say, however rare. From there every segment most of whose words labelled segments
hold is held against all labelled ones of about its size: the Hamming distance of the SimHash
fingerprints of their words drops the unlike ones, the words themselves decide, and the label
spreads until the connected components are exhausted. Unfilled placeholders inside a translated sentence
mark their own row only, since the sentence around them is a good one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lexweave.llm.common import blanked, words
from lexweave.llm.forms import odd, same_form
from lexweave.llm.neardup import mixed
from lexweave.llm.phrases import Phrases
from lexweave.llm.residue_terms import FILLER, LATIN, NOTICES, PLACEHOLDER, PLACEHOLDER_SIGN, REFUSALS
from lexweave.plans.lineage import built, keep, keep_table, sent_if_few

#: Share of the words of both that near-duplicates have in common.
NUM, DEN = 4, 5
#: Bits of 64 by which near-duplicates may differ; at that share they differ by 8 to 12 on average and by 27 at most in 70,000 tries.
MOST_BITS = 28
#: Labelled segments that are sent to the executors at a time.
MOST_SENT = 100_000

#: Different sources whose rows hold a segment of so many words, and the mean by which the logarithms of the lengths of their texts differ, that make a notice of it.
LEAST_ROWS, NOTICE_WORDS, STRANGE_LENGTHS = 8, 4, 0.7

_WITH_MASK = blanked("#")
_INSPECTED, _REFUSALS = Phrases((*NOTICES, *FILLER)), Phrases(REFUSALS)


def digits_masked(low: Column) -> Column:
    """Every token with a digit one sign."""
    # Most segments hold neither digits nor runs of blanks; a cheap search spares them the replacements.
    return F.when(low.rlike("[0-9]"), F.regexp_replace(low, r"(?<![\p{L}\p{N}])[0-9a-f]*\d[0-9a-z]*", "#")).otherwise(low)


def blanks_collapsed(masked: Column) -> Column:
    blanks = reduce(Column.__or__, [masked.contains(x) for x in ("  ", "\t", "\f", "\x0b")])
    return F.trim(F.when(blanks, F.regexp_replace(masked, r"\s+", " ")).otherwise(masked))


def segments(df: DataFrame, text: str, *keep_columns: Column) -> DataFrame:
    """One row per sentence or line of ``text`` that holds a letter or a number."""
    # One search of a text tells whether its segments have a plain form of their own; most are in lower case before the split.
    texts = df.filter(F.col(text).isNotNull()).select(*keep_columns, F.col(text).alias("_text"), odd(F.col(text)).alias("_odd"))
    kept = [c for c in texts.columns if c not in ("_text", "_odd")]
    rows = texts.select(*kept, "_odd", F.explode(F.split(F.when(F.col("_odd"), F.col("_text")).otherwise(F.lower("_text")), r"(?=\s)(?:(?<=[.!?…])\s+|[\r\n]+)")).alias("segment"))
    low = F.when(F.col("_odd"), F.lower(same_form(F.col("segment")))).otherwise(F.col("segment"))
    # Held against the plain form: a filter on the masked one would mask every segment twice.
    rows = rows.select(*kept, low.alias("low")).filter(F.col("low").rlike(r"[\p{L}#]|(?<![\p{L}\p{N}])[0-9]"))
    # Steps of their own, so that none is evaluated again for each mention in the next.
    rows = rows.select(*kept, digits_masked(F.col("low")).alias("masked")).withColumn("masked", blanks_collapsed(F.col("masked")))
    return rows.withColumn("seg_key", F.xxhash64("masked"))


def masked_words(masked: str) -> list[str]:
    """Words of a segment, each mask one of them."""
    return words(masked.replace("#", " # ") if "#" in masked else masked, _WITH_MASK)


def trusted(masked: str, rows: int = 1, gap: float = 0.0) -> bool:
    """Whether a segment bears a trusted label: it stands for any source, says what inspected notices and fillers say, or is nonsense Latin.

    ``rows``: how many rows of different sources hold it, since a row stored again says nothing more.
    ``gap``: how far the lengths of their two texts are apart, as the mean of the absolute logarithm
    of their ratio. Refusals stand for any source too but are answers.
    """
    if _INSPECTED.within(masked):
        return True
    strange = rows >= LEAST_ROWS and gap >= STRANGE_LENGTHS
    own = masked_words(masked)
    if strange and len(own) >= NOTICE_WORDS and not _REFUSALS.within(masked):
        return True
    return len(own) >= 4 and not LATIN.isdisjoint(own) and sum(w in LATIN for w in own) >= 0.6 * len(own)


def simhash(sets: list[list[str]]) -> np.ndarray:
    """64-bit SimHash of each list of distinct words, none empty; their order doesn't count."""
    counts = np.array([len(w) for w in sets])
    which, unique = pd.factorize(np.array([x for w in sets for x in w], object))
    h = mixed(np.array([hash_text(x) for x in unique], np.uint64))[which]
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.empty((len(sets), 64), np.int32)
    for i in range(0, len(sets), 4096):
        lo, hi = starts[i], ends[min(i + 4096, len(sets)) - 1]
        out[i : i + 4096] = np.add.reduceat(signs(h[lo:hi]), starts[i : i + 4096] - lo, axis=0)
    return np.packbits(out > 0, axis=1).view(np.uint64).ravel()


def signs(h: np.ndarray) -> np.ndarray:
    """1 or -1 for each bit of each hash."""
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16) * 2 - 1


def hash_text(x: str) -> int:
    """64 bits of a word from two checksums; the same in every process."""
    data = x.encode()
    return zlib.crc32(data) << 32 | zlib.adler32(data, len(data))


def word_set(masked: str) -> list[str]:
    """Distinct words of a segment; one without any is its own word."""
    return list(dict.fromkeys(masked_words(masked))) or [masked]


class Known:
    """Labelled segments by number of words, against which others are held."""

    def __init__(self, texts: list[str]) -> None:
        sets = sorted({frozenset(word_set(t)) for t in texts}, key=len)
        self.sets, self.sizes = sets, np.array([len(x) for x in sets])
        self.words = frozenset().union(*sets)
        self.prints = simhash([list(x) for x in sets]) if sets else np.zeros(0, np.uint64)

    def near(self, texts: list[str]) -> list[bool]:
        """Whether each text shares four fifths of the words of both with a labelled one."""
        out, own = [False] * len(texts), [set(masked_words(t)) or {t} for t in texts]
        # Words that no labelled segment has count against each of them, so most texts need no fingerprint.
        open_ = [i for i, w in enumerate(own) if DEN * len(w & self.words) >= NUM * len(w)]
        if not open_:
            return out
        for i, p in zip(open_, simhash([list(own[i]) for i in open_]), strict=True):
            n, w = len(own[i]), own[i]
            lo, hi = np.searchsorted(self.sizes, -(-NUM * n // DEN)), np.searchsorted(self.sizes, DEN * n // NUM, "right")
            for j in np.nonzero(np.bitwise_count(self.prints[lo:hi] ^ p) <= MOST_BITS)[0] + lo:
                both = len(w & self.sets[j])
                if DEN * both >= NUM * (n + len(self.sets[j]) - both):
                    out[i] = True
                    break
        return out


def _marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.loc[[trusted(*x) for x in zip(pdf["masked"], pdf["rows"], pdf["gap"], strict=True)], ["seg_key", "masked"]]


def near_segments(rest: DataFrame, frontier: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``seg_key``, ``masked`` of the segments of ``rest`` that are near-duplicates of one of ``frontier``; all of it is sent, ``most`` at a time."""
    parts = -(-frontier.count() // most)
    near = []
    for part in range(parts):
        texts = [r.masked for r in frontier.filter(F.pmod("seg_key", F.lit(parts)) == part).select("masked").collect()]
        known = built(rest.sparkSession, texts, Known)

        def run(batches: Iterator[pd.DataFrame], known: Callable[[], Known] = known) -> Iterator[pd.DataFrame]:
            held = known()
            for pdf in batches:
                yield pdf[held.near(pdf["masked"].tolist())]

        near.append(rest.mapInPandas(run, "seg_key long, masked string"))
    return reduce(DataFrame.unionByName, near).distinct()


def pieces(df: DataFrame, id_col: str = "id", text: str = "translated_text", source: str = "source_text") -> DataFrame:
    """``id``, ``gap``, ``source_key``, ``masked``, ``seg_key`` of every segment, written once as a table."""
    gap = F.abs(F.ln((F.length(text) + 1) / (F.length(source) + 1)))
    return keep_table(segments(df, text, F.col(id_col).alias("id"), gap.cast("float").alias("gap"), F.xxhash64(source).alias("source_key")))


def residue_segments(parts: DataFrame) -> DataFrame:
    """``seg_key`` of the segments of ``parts`` that bear a trusted label or are near-duplicates of such."""
    # Identical segments are one; they are written once, as every round reads them.
    one = keep_table(parts.groupBy("seg_key").agg(F.min("masked").alias("masked"), F.count(F.lit(1)).alias("rows")))
    often = sent_if_few(one.filter(F.col("rows") >= LEAST_ROWS).select("seg_key"))
    # Copies of a row are one; sources are told apart for the segments that rows enough hold.
    apart = parts.join(often, "seg_key", "left_semi").groupBy("seg_key", "source_key").agg(F.avg("gap").alias("gap"))
    sources = apart.groupBy("seg_key").agg(F.count(F.lit(1)).alias("sources"), F.avg("gap").alias("gap")).filter((F.col("sources") >= LEAST_ROWS) & (F.col("gap") >= STRANGE_LENGTHS))
    # What a segment says it says by itself; only those that stand for any source, few, meet their counts.
    rest = one.select("seg_key", "masked")
    strange = rest.join(sent_if_few(keep(sources)), "seg_key").select("seg_key", "masked", F.col("sources").alias("rows"), "gap")
    held = rest.withColumns({"rows": F.lit(1).cast("long"), "gap": F.lit(0.0)}).unionByName(strange)
    found = frontier = keep(held.mapInPandas(_marked, "seg_key long, masked string").distinct())
    # Every round labels segments that had no label, so there are as many as the longest chain has links.
    while not frontier.isEmpty():
        frontier = keep(near_segments(rest, frontier).join(found.select("seg_key"), "seg_key", "left_anti"))
        found = keep(found.unionByName(frontier))
    return found.select("seg_key")


def placeholders(text: str) -> set[str]:
    return {re.sub(r"\s+", "", m) for m in PLACEHOLDER.findall(text)} if PLACEHOLDER_SIGN.search(text) else set()


@F.pandas_udf(BooleanType())
def unfilled(source: pd.Series, target: pd.Series) -> pd.Series:
    """Whether the translation holds a placeholder that its source does not."""
    return pd.Series([bool(placeholders(t) - placeholders(s)) for s, t in zip(source, target, strict=True)], dtype=bool)


@F.pandas_udf(BooleanType())
def _discusses(source: pd.Series) -> pd.Series:
    """Whether the source itself carries a notice or filler."""
    return pd.Series([_INSPECTED.within(s) for s in source.str.lower()], dtype=bool)


#: Called nondeterministic, which it is not, so that it isn't moved before the join that leaves few rows.
discusses = _discusses.asNondeterministic()


def residue_rows(df: DataFrame, id_col: str = "id") -> DataFrame:
    """``id`` of the rows whose ``translated_text`` holds residue that its source doesn't carry.

    Null translations hold nothing; a null source carries nothing. Placeholders count where the
    source lacks the same one.
    """
    source = F.coalesce(F.col("source_text"), F.lit(""))
    marked = df.filter(F.col("translated_text").rlike(r"[{}$%<>\[\]@_⟦#]")).select(F.col(id_col).alias("id"), source.alias("s"), F.col("translated_text").alias("t")).filter(unfilled("s", "t")).select("id")
    parts = pieces(df, id_col)
    labelled = keep(parts.select("id", "seg_key").join(sent_if_few(residue_segments(parts)), "seg_key", "left_semi").select("id").distinct())
    # Few rows are left; only their sources are read, after the join.
    noticed = df.select(F.col(id_col).alias("id"), source.alias("s")).join(sent_if_few(labelled), "id", "left_semi").filter(~discusses("s")).select("id")
    return marked.unionByName(noticed).distinct()
