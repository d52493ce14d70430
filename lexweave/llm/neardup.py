"""Problem 2: rows whose texts share most of their words.

Method: parities. Every distinct word of a set flips one bit of a bitmap, so two bitmaps differ in no
more bits than the sets have words apart, and sets that share three quarters of their words have at
most a seventh of the words of both apart. The sets of a language pair whose sizes allow that are all
held against each other by 64 bits (more for longer texts), those that remain by twice as many, and
the words themselves decide. No pair can be lost; the bits drop practically all of the unrelated ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.forms import words
from lexweave.llm.common import lang_pair
from lexweave.llm.copies import canonical_words
from lexweave.plans.lineage import keep, keep_table, width

BASE, RATE, TOP = 1.05, 20.0, 254
SIMILAR_NUM, SIMILAR_DEN, LEAST_WORDS = 3, 4, 18
#: Blocks that the largest class of sizes of a language pair is cut into, and sets in a block, at least and at most.
BLOCKS, BLOCK_LEAST, BLOCK_MOST = 4, 4096, 524_288
#: Rows and columns that are held against each other at a time.
TILE_ROWS, TILE_COLUMNS = 64, 2048
#: Twice the log-likelihood that a pair at the threshold may lose against its best estimate.
SLACK = 24.0

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def register_values(hashes: np.ndarray, registers: int) -> np.ndarray:
    """The value each register takes from each element: ``floor(1 - log_b(x))`` of an exponential ``x``, truncated."""
    seeds = (np.arange(1, registers + 1, dtype=np.uint64) * _STEP)[None, :]
    u = (mixed(hashes.astype(np.uint64)[:, None] + seeds) >> np.uint64(11)).astype(np.float64)
    x = -np.log((u + 0.5) / 2.0**53) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint8)


def sketches(values: np.ndarray, starts: np.ndarray, registers: int) -> np.ndarray:
    """Registers of each set; ``values`` are all sets' hashes in a row, ``starts`` where each begins (none is empty)."""
    unique, which = np.unique(values, return_inverse=True)
    table = np.concatenate([register_values(unique[i : i + 4096], registers) for i in range(0, len(unique), 4096)])
    out, ends = np.empty((len(starts), registers), np.uint8), [*starts[1:], len(values)]
    for i in range(0, len(starts), 512):
        lo, hi = starts[i], ends[min(i + 512, len(starts)) - 1]
        out[i : i + 512] = np.maximum.reduceat(table[which[lo:hi]], starts[i : i + 512] - lo, axis=0)
    return out


def size_bounds() -> np.ndarray:
    """Where each class of sizes begins; a set is similar to sets of its class and of the two beside it only."""
    bounds = [LEAST_WORDS]
    while bounds[-1] < 2**31:
        bounds.append(-(-SIMILAR_DEN * bounds[-1] // SIMILAR_NUM))
    return np.array(bounds)


def level(n: int) -> int:
    """How often 64 bits are doubled to have one for each of ``n`` words; bitmaps are of the next level."""
    return max(0, (int(n) - 1).bit_length() - 6)


def parities(values: np.ndarray, which: np.ndarray, rows: int, words: int) -> np.ndarray:
    """Bitmaps of ``words`` 64-bit words for ``rows`` sets; each of ``values`` flips one bit of set ``which``."""
    out, at = np.zeros((rows, words), np.uint64), mixed(values)
    np.bitwise_xor.at(out, (which, ((at >> np.uint64(6)) % np.uint64(words)).astype(np.intp)), np.uint64(1) << (at & np.uint64(63)))
    return out


def _with_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bounds = size_bounds()
    for batch in batches:
        if batch.num_rows:
            w = batch.column("w")
            offsets = w.offsets.to_numpy()
            values, n = w.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64), np.diff(offsets)
            owner, levels, bits = np.repeat(np.arange(len(n)), n), np.array([level(x) for x in n]), [b""] * len(n)
            for x in np.unique(levels):
                own = np.flatnonzero(levels == x)
                place = np.full(len(n), -1)
                place[own] = np.arange(len(own))
                mine = place[owner] >= 0
                for i, row in zip(own, parities(values[mine], place[owner[mine]], len(own), 2 << x), strict=True):
                    bits[i] = row.tobytes()
            classes = (np.searchsorted(bounds, n, "right") - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("set_key"), batch.column("salt"), w, pa.array(classes), pa.array(bits, pa.binary())], ["set_key", "salt", "w", "class", "bits"])


def in_blocks(parts: dict[tuple[int, int], int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deals sets to the pairs of blocks in which they meet others; ``parts``: blocks of a language pair's class, where they are several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt, size = (batch.column(c).to_numpy() for c in ("set_key", "salt", "class"))
            size = size.astype(np.int64)
            own, up, down = (np.array([parts.get((s, c + k), 1) for s, c in zip(salt.tolist(), size.tolist(), strict=True)]) for k in (0, 1, -1))
            down[size == 0] = 0
            part = (mixed(key.view(np.uint64)) % own.astype(np.uint64)).astype(np.int64)
            each = own + up + down
            row = np.repeat(np.arange(len(each)), each)
            to = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            mine, o, u = part[row], own[row], up[row]
            level_ = (to >= o).astype(np.int64)
            below = to >= o + u
            other = np.where(below, to - o - u, np.where(level_ == 1, to - o, to))
            side = np.where(below, 1, np.where(level_ == 1, 0, np.where(mine < other, 0, np.where(mine > other, 1, 2))))
            first = np.where(side == 1, other, mine)
            second = np.where(side == 1, mine, other)
            pair = mixed(salt.view(np.uint64)[row])
            for x in (size[row] - below, level_, first, second):
                pair = mixed(pair * _M1 + x.astype(np.uint64) + _STEP)
            sent = batch.select(["set_key", "n", "bits"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(side.astype(np.int8)), *sent.columns], ["pair", "side", "set_key", "n", "bits"])

    return run


class Block:
    """Sets by their number of words, with their bitmaps of every level that they have."""

    def __init__(self, table: pa.Table) -> None:
        n = table.column("n").to_numpy()
        order = np.argsort(n, kind="stable")
        bits = table.column("bits").to_pylist()
        self.n, self.keys = n[order], table.column("set_key").to_numpy()[order]
        self.tops = np.array([level(x) + 1 for x in self.n], int)
        # By level: where its sets begin, and their bitmaps; those of longer sets are folded.
        self.levels: list[tuple[int, np.ndarray]] = []
        longer = np.zeros((0, 2), np.uint64)
        for x in range(self.tops[-1], -1, -1) if len(n) else ():
            lo, hi = np.searchsorted(self.tops, x), np.searchsorted(self.tops, x, "right")
            rows = np.frombuffer(b"".join(bits[i] for i in order[lo:hi]), np.uint64).reshape(-1, 1 << x)
            folded = longer[:, : 1 << x] ^ longer[:, 1 << x :] if len(longer) else rows[:0]
            longer = np.concatenate([rows, folded])
            self.levels.insert(0, (int(lo), longer))

    def bits(self, x: int, rows: slice | np.ndarray) -> np.ndarray:
        start, matrix = self.levels[x]
        return matrix[slice(rows.start - start, rows.stop - start) if isinstance(rows, slice) else rows - start]


def apart(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """Words that only one of two similar sets of these sizes has, at most."""
    return (SIMILAR_DEN - SIMILAR_NUM) * (n + m) // (SIMILAR_DEN + SIMILAR_NUM)


def close(a: Block, b: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``b`` whose bitmaps let them be similar; each two of one block once."""
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int))]
    for at in range(0, len(a.n), TILE_ROWS):
        till = min(at + TILE_ROWS, len(a.n))
        least, most = int(a.n[at]), int(a.n[till - 1])
        lo, hi = np.searchsorted(b.n, -(-SIMILAR_NUM * least // SIMILAR_DEN)), np.searchsorted(b.n, SIMILAR_DEN * most // SIMILAR_NUM, "right")
        for left in range(max(lo, at) if same else lo, hi, TILE_COLUMNS):
            right = min(left + TILE_COLUMNS, hi)
            both = min(a.tops[at], b.tops[left])
            x = min(level(most), both)
            p, q = a.bits(x, slice(at, till)), b.bits(x, slice(left, right))
            differ = np.bitwise_count(p[:, None, 0] ^ q[None, :, 0])
            if x:
                differ = differ.astype(np.uint32)
                for k in range(1, 1 << x):
                    differ += np.bitwise_count(p[:, None, k] ^ q[None, :, k])
            hits = np.flatnonzero(differ <= apart(most, int(b.n[right - 1])))
            if len(hits):
                i, j = hits // (right - left) + at, hits % (right - left) + left
                n, m = a.n[i], b.n[j]
                good = np.bitwise_count(a.bits(both, i) ^ b.bits(both, j)).sum(1) <= apart(n, m)
                good &= SIMILAR_DEN * np.minimum(n, m) >= SIMILAR_NUM * np.maximum(n, m)
                if same:
                    good &= i < j
                found.append((i[good], j[good]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _met(table: pa.Table) -> pa.Table:
    side = table.column("side").to_numpy()
    a = Block(table.filter(pa.array(side != 1)))
    same = bool((side == 2).any())
    b = a if same else Block(table.filter(pa.array(side == 1)))
    i, j = close(a, b, same)
    x, y = a.keys[i], b.keys[j]
    return pa.table({"key_a": np.minimum(x, y), "key_b": np.maximum(x, y)})


def _equal(x: np.ndarray) -> np.ndarray:
    """Probability that one register exceeds the other, as a function of the share of elements only the one has."""
    return -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)


def similarity_gap(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, at: float) -> np.ndarray:
    """Twice the log-likelihood that similarity ``at`` or more loses against the best estimate of each pair."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / (1 - u), (1 - u) / u)
    p, q = _equal(u - (1 - u) * grid), _equal(1 - u - u * grid)
    like = more * np.log(p) + less * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-9, 1))
    return 2 * (like.max(1) - np.where(grid >= at - 0.005, like, -np.inf).max(1))


def word_sets(df: DataFrame, fields: tuple[str, ...], *keep_columns: Column) -> DataFrame:
    """``keep_columns``, ``salt``, ``w``, ``set_key`` for each text with words enough; ``w`` holds its distinct words' hashes."""
    rows = df.select(*keep_columns, F.xxhash64(lang_pair()).alias("salt"), *[F.col(f).alias(f"_text_{i}") for i, f in enumerate(fields)])
    named = [c for c in rows.columns if not c.startswith("_text_")]
    texts = rows.select(*named, F.explode(F.array(*[F.col(f"_text_{i}") for i in range(len(fields))])).alias("text"))
    # Every word takes a character; some characters, as in "ŉ", part words besides.
    texts = texts.filter(F.length("text") >= LEAST_WORDS)
    hashed = F.transform(F.array_sort(F.array_distinct(words(F.col("text")))), lambda x: F.xxhash64(x))
    sets = texts.select(*named, hashed.alias("w")).filter(F.size("w") >= LEAST_WORDS)
    return sets.withColumn("set_key", F.xxhash64("salt", "w"))


def similar_sets(sets: DataFrame) -> DataFrame:
    """``key_a`` < ``key_b`` of the distinct word sets that share three quarters of their words or more.

    The sets of a language pair are cut into classes of sizes and blocks of these; every two blocks
    that may hold similar sets meet in one place, so each pair is found once. The work grows with the
    square of the sets of a language pair. All joins are merge joins, since what they join grows with
    the data.
    """
    distinct = sets.groupBy("set_key").agg(F.any_value("salt").alias("salt"), F.any_value("w").alias("w"))
    one = keep_table(distinct.mapInArrow(_with_bits, "set_key long, salt long, w array<long>, class int, bits binary"))
    counts = one.groupBy("salt", "class").count()
    largest = counts.agg(F.max("count")).first()[0] or 0
    block = min(max(-(-largest // BLOCKS), BLOCK_LEAST), BLOCK_MOST)
    # At most as many as there are full blocks.
    parts = {(r.salt, r["class"]): -(-r["count"] // block) for r in counts.filter(F.col("count") > block).collect()}
    dealt = one.select("set_key", "salt", "class", F.size("w").alias("n"), "bits").mapInArrow(in_blocks(parts), "pair long, side byte, set_key long, n int, bits binary")
    # Pairs of blocks are few and large, so they are spread over more tasks than rows would be.
    pairs = dealt.repartition(4 * width(sets.sparkSession), "pair").groupBy("pair").applyInArrow(_met, "key_a long, key_b long")
    side = lambda s: one.select(F.col("set_key").alias(f"key_{s}"), F.col("w").alias(f"w_{s}")).hint("merge")
    both = pairs.join(side("a"), "key_a").join(side("b"), "key_b")
    shared = F.size(F.array_intersect("w_a", "w_b"))
    alike = both.withColumn("shared", shared).filter(SIMILAR_DEN * F.col("shared") >= SIMILAR_NUM * (F.size("w_a") + F.size("w_b") - F.col("shared")))
    return alike.select("key_a", "key_b")


def near_classes(df: DataFrame, fields: tuple[str, ...] = ("source_text", "previous_source_text"), id_col: str = "id", record: str = "source_text") -> tuple[DataFrame, DataFrame]:
    """Links between classes of rows, and the rows of each class.

    A class holds the rows of one language pair whose record is the same word for word and that bear
    one set of words; its representative is the smallest id. Returns ``links`` (``class_a``,
    ``class_b``: classes with different records whose word sets are similar) and ``members``
    (``class``, ``id``). A row with two texts may belong to two classes.
    """
    canon = F.unhex(F.md5(F.coalesce(canonical_words(F.col(record)), F.lit("\x01"))))
    # Written once: the sketches read the words, the classes the rows. Equal word hashes are stored as one.
    sets = keep_table(word_sets(df, fields, F.col(id_col).cast("long").alias("id"), canon.alias("canon")))
    rows = sets.select("set_key", "canon", "id")
    classes = keep(rows.groupBy("set_key", "canon").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("rows")))
    same = classes.groupBy("set_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("set_key").alias("key_a"), F.col("set_key").alias("key_b"))
    links = similar_sets(sets.select("set_key", "salt", "w")).unionByName(same)
    side = lambda s: classes.select(F.col("set_key").alias(f"key_{s}"), F.col("canon").alias(f"canon_{s}"), F.col("class").alias(f"class_{s}")).hint("merge")
    met = links.join(side("a"), "key_a").join(side("b"), "key_b").filter(F.col("canon_a") != F.col("canon_b"))
    links = met.select("key_a", "canon_a", "class_a", "key_b", "canon_b", "class_b")
    return links, rows.join(classes.select("set_key", "canon", "class").hint("merge"), ["set_key", "canon"])


def near_links(df: DataFrame, **names: object) -> DataFrame:
    """``class_a``, ``class_b``: links between classes by their representatives, smaller id first; each once.

    With ``near_members`` this is the whole result, however often a text is stored.
    """
    links, _ = near_classes(df, **names)
    ends = links.filter(F.col("class_a") != F.col("class_b"))
    return ends.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")).distinct()


def near_members(df: DataFrame, **names: object) -> DataFrame:
    """``class``, ``id``: the rows of every class that bears words enough, the representative among them."""
    return near_classes(df, **names)[1].select("class", "id").distinct()


def near_duplicates(df: DataFrame, fields: tuple[str, ...] = ("source_text", "previous_source_text"), id_col: str = "id", record: str = "source_text") -> DataFrame:
    """``id_a``, ``id_b``: rows of one language pair whose records differ in words but of whose texts two are similar.

    Null texts and texts of fewer than 18 distinct words count nowhere. Rows with the same words in
    the same order are no pair; rows with the same words in another order are. Copies of a text meet
    each other nowhere: the rows of two classes are paired only for a link between them, which the
    form of this result asks for; ``near_links`` and ``near_members`` hold the same without that.
    """
    links, members = near_classes(df, fields, id_col, record)
    side = lambda s: members.select(F.col("set_key").alias(f"key_{s}"), F.col("canon").alias(f"canon_{s}"), F.col("id").alias(f"id_{s}")).hint("merge")
    rows = links.join(side("a"), ["key_a", "canon_a"]).join(side("b"), ["key_b", "canon_b"]).filter(F.col("id_a") != F.col("id_b"))
    return rows.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
