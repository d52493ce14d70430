"""Problem 6: records that are equal but for layout, counted in tries over radix buckets.

Method: recursive radix partitioning on canonical bytes. Every input partition first counts its
own texts in a trie, so that a text stored in a third of all rows leaves each task once. The
partial counts are cut into buckets by their first bytes, a bucket that is too large by more
bytes, and each bucket's trie adds up the terminal counters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.forms import WORD, same_form
from lexweave.llm.common import digest, lang_pair
from lexweave.plans.lineage import keep

# Separators between the fields of a list; a comma or slash between digits belongs to a number.
FIELD_BREAK = r"[;|·•\n\r]|(?<!\d)[,/]|[,/](?!\d)"
# One field: a name of up to four words, one sign, a value without a sentence end inside.
FIELD = r"^[^\p{L}\p{N}:=]*(?:[\p{L}\p{N}'’-]+[^\p{L}\p{N}:=]*){1,4}[:=](?:(?![.!?…]\s+\p{L})[^:=])*[\p{L}\p{N}](?:(?![.!?…]\s+\p{L})[^:=])*$"
BUCKET_ROWS = 20_000
RADIX = 4
CHUNK = 12


def canonical_words(text: Column) -> Column:
    """Words in their order, or the sorted fields of a list of ``name: value`` fields; null for null."""
    form = F.lower(same_form(text))
    pieces = F.filter(F.split(form, FIELD_BREAK), lambda p: p.rlike(WORD))
    tokens = lambda p: F.translate(F.array_join(F.regexp_extract_all(p, F.lit(rf"{WORD}|[:=]"), F.lit(0)), " "), "=", ":")
    fields = F.when((F.size(pieces) >= 2) & F.forall(pieces, lambda p: p.rlike(FIELD)), F.concat(F.lit("\x02"), F.array_join(F.array_sort(F.transform(pieces, tokens)), "\x02")))
    in_order = F.array_join(F.regexp_extract_all(form, F.lit(WORD), F.lit(0)), " ")
    return F.when(text.rlike("(?s)[:=：＝].*[:=：＝]"), F.coalesce(fields, in_order)).otherwise(in_order)


class Trie:
    """Byte strings in chunks, each leaf holding its rest until a second string needs that path."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, copies: int, first: int) -> None:
        node, at = self.root, 0
        while True:
            chunk = key[at : at + CHUNK]
            at += CHUNK
            child = node.get(chunk)
            if child is None:
                node[chunk] = [key[at:], copies, first]
                return
            if type(child) is list:
                if child[0] == key[at:]:
                    child[1] += copies
                    child[2] = min(child[2], first)
                    return
                rest = child[0]
                node[chunk] = child = {rest[:CHUNK]: [rest[CHUNK:], child[1], child[2]]}
            node = child

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        todo = [(b"", self.root)]
        while todo:
            head, node = todo.pop()
            for chunk, child in node.items():
                if type(child) is list:
                    yield head + chunk + child[0], child[1], child[2]
                else:
                    todo.append((head + chunk, child))


def _counted(keys: pd.Series, copies: pd.Series, firsts: pd.Series, trie: Trie) -> Trie:
    for key, n, first in zip(keys, copies, firsts, strict=True):
        trie.add(key, n, first)
    return trie


def _partial(batches: Iterator[pd.DataFrame], most: int = 200_000) -> Iterator[pd.DataFrame]:
    trie, held = Trie(), 0

    def out() -> pd.DataFrame:
        return pd.DataFrame(list(trie.items()), columns=["bytes", "copies", "first_id"])

    for pdf in batches:
        for key, i in zip(pdf["bytes"], pdf["id"], strict=True):
            trie.add(key, 1, i)
        held += len(pdf)
        if held > most:
            yield out()
            trie, held = Trie(), 0
    yield out()


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    trie = _counted(pdf["bytes"], pdf["copies"], pdf["first_id"], Trie())
    return pd.DataFrame(list(trie.items()), columns=["bytes", "copies", "first_id"])


def radix_buckets(partial: DataFrame, most: int = BUCKET_ROWS, longest: int = 400) -> DataFrame:
    """``partial`` with ``bucket``: the shortest prefix of ``bytes`` that at most ``most`` rows share.

    Strings that share ``longest`` bytes and are still too many are dealt by the hash of the whole
    string. Equal strings stay together, so a bucket can only exceed ``most`` by the partial counts
    of one string, of which every task wrote one, or where a hash deals unevenly. The prefixes to
    split are at most rows / ``most`` on a level.
    """
    depth = RADIX
    rows = partial.withColumn("bucket", F.substring("bytes", 1, depth))
    while depth < longest:
        large = rows.filter(F.length("bucket") == depth).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("bytes")).alias("end")).filter((F.col("n") > most) & (F.col("end") > depth)).select(F.col("bucket").alias("large")).persist()
        if large.isEmpty():
            large.unpersist()
            break
        depth += RADIX
        rows = rows.join(large, F.col("bucket") == F.col("large"), "left").withColumn("bucket", F.when(F.col("large").isNotNull(), F.substring("bytes", 1, depth)).otherwise(F.col("bucket"))).drop("large")
    else:
        sizes = rows.filter(F.length("bucket") >= depth).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(F.col("bucket").alias("large"), F.ceil(2 * F.col("n") / most).alias("parts"))
        part = F.encode(F.concat(F.lit("\x00"), F.pmod(F.xxhash64("bytes"), F.col("parts")).cast("string")), "utf-8")
        rows = rows.join(sizes, F.col("bucket") == F.col("large"), "left").withColumn("bucket", F.when(F.col("large").isNotNull(), F.concat("bucket", part)).otherwise(F.col("bucket"))).drop("large", "parts")
    return rows


def copy_classes(df: DataFrame, text: str = "source_text", id_col: str = "id", most: int = BUCKET_ROWS) -> DataFrame:
    """``key``, ``first_id``, ``copies``: one row per record in one language pair, with its rows counted.

    Null texts are no record. Texts without any word are equal to each other. A row stored twice
    under one id counts twice.
    """
    rows = df.filter(F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.encode(F.concat_ws("\x00", canonical_words(F.col(text)), lang_pair()), "utf-8").alias("bytes"))
    partial = keep(rows.mapInPandas(_partial, "bytes binary, copies long, first_id long"))
    counted = radix_buckets(partial, most).groupBy("bucket").applyInPandas(_bucket, "bytes binary, copies long, first_id long")
    return counted.select(F.unhex(F.md5("bytes")).alias("key"), "first_id", "copies")


def later_copies(df: DataFrame, text: str = "source_text", id_col: str = "id") -> DataFrame:
    """``first_id``, ``id``: every row whose record a row of smaller id already held."""
    classes = copy_classes(df, text, id_col).filter(F.col("copies") > 1).select("key", "first_id")
    rows = df.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), digest(canonical_words(F.col(text)), lang_pair()).alias("key"))
    return rows.join(classes, "key").filter(F.col("id") != F.col("first_id")).select("first_id", "id").distinct()
