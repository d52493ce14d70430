"""Listing, paging and stepping through the memory."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexweave.plans.lineage import with_row_numbers

SORTS = {"newest": ("updated_at", False), "oldest": ("updated_at", True), "shortest": ("length", True), "longest": ("length", False)}


def in_status(status: Column, wanted: str) -> Column:
    """``pending`` means automatic or edited, a blank means all."""
    return F.lit(True) if not wanted else status.isin("auto", "edited") if wanted == "pending" else status == wanted


def listed(memory: DataFrame, status: str = "", target_lang: str = "", search: str = "", collation: str = "UNICODE_CI_AI") -> DataFrame:
    """Rows of a status and language whose source or translation holds ``search``, case and accents aside."""
    rows = memory.filter(in_status(F.col("status"), status))
    rows = rows.filter(F.col("target_lang") == target_lang) if target_lang else rows
    if search:
        term = F.collate(F.lit(search), collation)
        rows = rows.filter(F.contains(F.collate("source_text", collation), term) | F.contains(F.collate("translated_text", collation), term))
    return rows


def page(rows: DataFrame, sort: str = "newest", number: int = 1, per: int = 20) -> DataFrame:
    """One page of at most 100 rows by one of four orders, ids breaking ties in the same direction."""
    name, up = SORTS.get(sort, SORTS["newest"])
    key = F.length("source_text") if name == "length" else F.col(name)
    per, number = min(max(per, 1), 100), max(number, 1)
    order = [key.asc() if up else key.desc(), F.col("id").asc() if up else F.col("id").desc()]
    return rows.orderBy(*order).offset((number - 1) * per).limit(per)


def totals(rows: DataFrame, per: int = 20) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / F.lit(per)).cast("long").alias("pages"))


def clamped_page(rows: DataFrame, sort: str = "newest", number: int = 1, per: int = 20) -> DataFrame:
    """A page as in ``page``, the last one where the number is beyond it."""
    per = min(max(per, 1), 100)
    return page(rows, sort, min(max(number, 1), max(1, -(-rows.count() // per))), per)


def adjacent(memory: DataFrame, current: int, status: str = "pending", target_lang: str = "") -> DataFrame:
    """``prev_id``, ``next_id`` of any id, listed or not, around the ends; an id that isn't listed has the last and the first.

    Null where the current id is the only one.
    """
    ids = listed(memory, status, target_lang)
    by = ids.agg(F.count_distinct("id").alias("n"), F.max(F.col("id") == current).alias("listed"), F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.when(F.col("id") < current, F.col("id"))).alias("before"), F.min(F.when(F.col("id") > current, F.col("id"))).alias("after"))
    alone, here = F.coalesce(F.col("listed") & (F.col("n") == 1), F.lit(False)), F.coalesce("listed", F.lit(False))
    either = lambda near, end: F.when(~alone, F.when(here, F.coalesce(near, end)).otherwise(F.col(end)))
    return by.select(either("before", "last").alias("prev_id"), either("after", "first").alias("next_id"))


def stats(memory: DataFrame) -> DataFrame:
    """Rows by status in one row; ``total`` counts every status."""
    one = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return memory.agg(F.count(F.lit(1)).alias("total"), one("auto"), one("edited"), one("confirmed"))


def stats_with(memory: DataFrame, runs: DataFrame) -> DataFrame:
    """``stats`` with ``api_calls`` and ``cache_hits``, summed over the counters of all runs (``hits``, ``calls``)."""
    sums = runs.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("api_calls"), F.coalesce(F.sum("hits"), F.lit(0)).alias("cache_hits"))
    return stats(memory).join(F.broadcast(sums)).withColumn("hit_rate", hit_rate(F.col("cache_hits"), F.col("api_calls")))


def neighbours(memory: DataFrame, status: str = "pending") -> DataFrame:
    """``id``, ``prev_id``, ``next_id`` among the rows of a status, around the ends; null for a single row.

    Numbered over ranges of ids, so that no task holds all of them.
    """
    rows = with_row_numbers(memory.filter(in_status(F.col("status"), status)).select("id").distinct(), "id")
    ends = rows.agg(F.max("row_number").alias("n"))
    j = rows.join(F.broadcast(ends))
    at = lambda shift: (F.col("row_number") - 1 + shift + F.col("n")) % F.col("n") + 1
    other = lambda name: rows.select(F.col("row_number").alias(f"at_{name}"), F.col("id").alias(f"{name}_id"))
    out = j.withColumns({"at_prev": at(-1), "at_next": at(1)}).join(other("prev"), "at_prev").join(other("next"), "at_next")
    alone = F.col("n") == 1
    return out.select("id", F.when(~alone, F.col("prev_id")).alias("prev_id"), F.when(~alone, F.col("next_id")).alias("next_id"))


def next_after(memory: DataFrame, current: int, status: str = "pending") -> DataFrame:
    """``next_id``: first id of a status after ``current``, else the first of all."""
    ids = memory.filter(in_status(F.col("status"), status))
    return ids.agg(F.coalesce(F.min(F.when(F.col("id") > current, F.col("id"))), F.min("id")).alias("next_id"))


def hit_rate(hits: Column, calls: Column) -> Column:
    return F.when(hits + calls > 0, F.round(100 * hits / (hits + calls))).otherwise(F.lit(0.0)).cast("int")


def token_diff(old: str, new: str) -> list[tuple[str, str]]:
    """Longest common subsequence of words and blanks, read from the end: there a deletion comes before an insertion.

    Equal beginnings and ends are taken off first, so that the table only holds what lies between.
    """
    a, b = (np.array([x for x in re.split(r"(\s+)", s) if x], object) for s in (old, new))
    short = min(len(a), len(b))
    tail = next((k for k in range(short) if a[-1 - k] != b[-1 - k]), short)
    x, y = a[: len(a) - tail], b[: len(b) - tail]
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(1, len(x) + 1):
        # A row at once: the best so far of the row above, one more where the tokens are equal.
        best[i, 1:] = np.maximum.accumulate(np.where(y == x[i - 1], best[i - 1, :-1] + 1, best[i - 1, 1:]))
    out, i, j = [("eq", t) for t in a[len(a) - tail :][::-1]], len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append(("eq", x[i]))
        elif best[i - 1, j] >= best[i, j - 1]:
            i -= 1
            out.append(("del", x[i]))
        else:
            j -= 1
            out.append(("ins", y[j]))
    return [*[("ins", t) for t in y[:j]], *[("del", t) for t in x[:i]], *out[::-1]]


DIFF = ArrayType(StructType([StructField("op", StringType()), StructField("token", StringType())]))


@F.pandas_udf(DIFF)
def diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Token differences of two texts; none where the old text is null, blank or the same."""
    return pd.Series([[] if not a or a == b else token_diff(a, b or "") for a, b in zip(old, new, strict=True)])
