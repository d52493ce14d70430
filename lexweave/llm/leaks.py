"""Problem 9: passages of held-out items inside a corpus.

Method: spaced-seed hashing. A fixed mask over eight tokens ignores some positions; the masked
windows of items and documents are joined on their hash, and each hit is verified around it along
its diagonal, where single substituted words don't end an overlap. Eight equal words in a row fill
every window, so no such passage is missed; the masks' gaps find the passages with substitutions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.forms import words
from lexweave.plans.lineage import shared, spread

SPAN = 8
MASKS = ("11101011", "11011101", "10111011")
#: Items with more words than this are joined by a shuffle instead of being sent to every executor.
MOST_SENT_WORDS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(text: str) -> Column:
    """Hashes of the words of a text, in order; null for null."""
    return F.transform(words(F.col(text)), lambda w: F.xxhash64(w))


def window_keys(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked window at each position that has a whole window after it."""
    n = len(tokens) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.full(n, np.uint64(int(mask, 2)))
    for i, used in enumerate(mask):
        if used == "1":
            key = (key ^ (tokens[i : i + n] + _MIX)) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
    return key


class Seeds:
    """Masked windows of all items in sorted order, with the item tokens for verification."""

    def __init__(self, ids: list[int], tokens: list[np.ndarray]) -> None:
        self.ids, self.tokens = ids, tokens
        self.tables = []
        for mask in MASKS:
            keys = [window_keys(t, mask) for t in tokens]
            lengths = [len(k) for k in keys]
            flat = np.concatenate([*keys, np.zeros(0, np.uint64)])
            order = np.argsort(flat, kind="stable")
            which = np.repeat(np.arange(len(ids)), lengths)
            at = np.concatenate([*[np.arange(n) for n in lengths], np.zeros(0, np.int64)])
            self.tables.append((mask, flat[order], which[order], at[order]))

    def hits(self, tokens: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(position, item, position in item)`` of every shared masked window."""
        for mask, keys, which, at in self.tables:
            found = window_keys(tokens, mask)
            if not len(keys) or not len(found):
                continue
            lo = np.searchsorted(keys, found)
            maybe = np.nonzero(keys[np.minimum(lo, len(keys) - 1)] == found)[0]
            for p in maybe:
                k, i = found[p], lo[p]
                while i < len(keys) and keys[i] == k:
                    yield int(p), int(which[i]), int(at[i])
                    i += 1


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Longest exact run on a diagonal, and words and substitutions of its longest overlap without two wrong words in a row."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    at = np.flatnonzero(doc[lo + shift : hi + shift] == item[lo:hi])
    if not len(at):
        return 0, 0, 0
    step = np.diff(at)
    ends = lambda far: np.concatenate([[0], np.flatnonzero(step > far) + 1, [len(at)]])
    # One wrong word is a step of two; a longer one begins another overlap.
    cuts = ends(2)
    words_, wrong = np.diff(cuts), np.add.reduceat(np.concatenate([[0], step == 2]), cuts[:-1])
    best = np.lexsort((-wrong, words_))[-1]
    return int(np.diff(ends(1)).max()), int(words_[best]), int(wrong[best])


OUT = "doc_id long, item_id long, exact_run int, overlap_words int, substitutions int"


def _found(doc_ids: np.ndarray, offsets: np.ndarray, flat: np.ndarray, seeds: Seeds) -> list[tuple[int, int, int, int, int]]:
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: set[tuple[int, int, int]] = set()
    for p, item, q in seeds.hits(flat):
        row = int(np.searchsorted(offsets, p, "right")) - 1
        start, end = offsets[row], offsets[row + 1]
        if p + SPAN > end or (row, item, p - q) in done:
            continue
        done.add((row, item, p - q))
        got = overlap(flat[start:end], seeds.tokens[item], int(p - q - start))
        best[row, item] = max(best.get((row, item), (0, 0, 0)), got)
    return [(int(doc_ids[r]), seeds.ids[i], *got) for (r, i), got in best.items()]


def _batches(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "exact_run", "overlap_words", "substitutions"])


def _scan(batches: Iterator[pa.RecordBatch], seeds: Seeds) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = b.column("t")
        offsets = t.offsets.to_numpy().astype(np.int64)
        flat = t.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
        yield _batches(_found(b.column("doc_id").to_numpy(), offsets - offsets[0], flat, seeds))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = b.column("t")
        offsets = t.offsets.to_numpy().astype(np.int64)
        flat, offsets = t.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]
        ids = np.repeat(b.column("doc_id").to_numpy(), np.diff(offsets))
        last = np.repeat(offsets[1:], np.diff(offsets))
        inside = np.nonzero(np.arange(len(flat)) + SPAN <= last)[0]
        keys = [window_keys(flat, m)[inside].view(np.int64) for m in MASKS]
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids[inside], len(MASKS))), pa.array(np.concatenate(keys))], ["doc_id", "key"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, known = [], {}
        (docs, d), (items, i) = ((b.column(c).values.to_numpy().view(np.uint64), b.column(c).offsets.to_numpy()) for c in ("t", "u"))
        for k, (doc, item) in enumerate(zip(b.column("doc_id").to_numpy(), b.column("item_id").to_numpy(), strict=True)):
            theirs, ours = items[i[k] : i[k + 1]], docs[d[k] : d[k + 1]]
            # An id stored twice has two texts, so seeds are kept by their tokens.
            key = (item, theirs.tobytes())
            seeds = known[key] = known.get(key) or Seeds([int(item)], [theirs])
            out += _found(np.array([doc]), np.array([0, len(ours)]), ours, seeds)
        yield _batches(out)


def leaks(docs: DataFrame, items: DataFrame, most_sent: int = MOST_SENT_WORDS) -> DataFrame:
    """``doc_id``, ``item_id``, ``exact_run``, ``overlap_words``, ``substitutions`` of every document that meets an item.

    Case, punctuation and layout don't count. Null, blank and too short texts meet nothing; an id
    stored twice with two texts counts with the better of both. Items go to every executor only up
    to ``most_sent`` words; more are met by a join of the masked windows, with the same result.
    """
    d = spread(docs.filter(F.col("text").isNotNull())).select(F.col("doc_id").cast("long").alias("doc_id"), token_hashes("text").alias("t")).filter(F.size("t") >= SPAN)
    i = items.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), token_hashes("text").alias("u")).filter(F.size("u") >= SPAN)
    if (i.agg(F.sum(F.size("u"))).first()[0] or 0) <= most_sent:
        rows = i.collect()
        seeds = shared(docs.sparkSession, Seeds([r.item_id for r in rows], [np.array(r.u, np.int64).view(np.uint64) for r in rows]))
        found = d.mapInArrow(lambda it: _scan(it, seeds()), OUT)
    else:
        keyed = lambda x: x.mapInArrow(_windows, "doc_id long, key long").distinct()
        theirs = keyed(i.select(F.col("item_id").alias("doc_id"), F.col("u").alias("t"))).withColumnRenamed("doc_id", "item_id")
        pairs = keyed(d).join(theirs, "key").select("doc_id", "item_id").distinct()
        found = pairs.join(d, "doc_id").join(i, "item_id").mapInArrow(_verify, OUT)
    best = F.max(F.struct("exact_run", "overlap_words", "substitutions")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")
