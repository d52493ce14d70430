"""The translation memory as snapshots: identity, lookup, upsert, import, correction.

A snapshot goes in and a new one comes out; nothing is changed in place. Where one row's change can
meet another's, the winner is decided in one window over the snapshot, not row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import normalize, segment_hash
from lexweave.plans.lineage import keep, with_row_numbers

#: Case, accents, ellipsis forms and trailing blanks don't tell source texts apart.
COLLATION = "UNICODE_CI_AI_RTRIM"
COLUMNS = ("id", "hash", "source_lang", "target_lang", "source_text", "previous_source_text", "translated_text", "status", "provider", "updated_at")


def status_rank(status: Column) -> Column:
    """0 confirmed, 1 edited, 2 anything else."""
    return F.when(status == "confirmed", 0).when(status == "edited", 1).otherwise(2)


def with_hash(df: DataFrame, name: str = "hash") -> DataFrame:
    return df.withColumn(name, segment_hash(F.col("source_lang"), F.col("target_lang"), F.col("source_text")))


def by_ids(memory: DataFrame, ids: Sequence[int]) -> DataFrame:
    return memory.filter(F.col("id").isin([int(i) for i in ids]))


def by_hashes(memory: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose hash is among ``keys.hash``; blank and repeated keys count once or not."""
    return memory.join(keys.filter(F.col("hash") != "").select("hash").distinct(), "hash", "left_semi")


def best_by_hash(memory: DataFrame) -> DataFrame:
    """One row per hash: confirmed before edited before others, then the newest id; rows without hash leave."""
    order = F.struct(-status_rank(F.col("status")), F.col("id"))
    rest = [c for c in memory.columns if c != "hash"]
    return memory.filter(F.col("hash").isNotNull()).groupBy("hash").agg(F.max_by(F.struct(*rest), order).alias("r")).select("hash", "r.*")


def duplicate_groups(memory: DataFrame, collation: str = COLLATION) -> DataFrame:
    """``source_lang``, ``target_lang``, ``rows``, ``ids`` of source texts stored more than once, ids in order."""
    rows = memory.withColumn("k", F.collate("source_text", collation))
    return rows.groupBy("source_lang", "target_lang", "k").agg(F.count(F.lit(1)).alias("rows"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids")).filter("rows > 1").drop("k")


def duplicate_members(memory: DataFrame, collation: str = COLLATION) -> DataFrame:
    """``group``, ``id``, ``rows``: the same groups in long form, named by their smallest id, for texts of any number of rows."""
    rows = memory.select("id", "source_lang", "target_lang", F.collate("source_text", collation).alias("k"))
    groups = rows.groupBy("source_lang", "target_lang", "k").agg(F.min("id").alias("group"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    same = [rows[c].eqNullSafe(groups[c]) for c in ("source_lang", "target_lang", "k")]
    return rows.join(groups, same).select("group", "id", "rows")


def winners(memory: DataFrame, collation: str = COLLATION) -> DataFrame:
    """The best row of each group of equal source texts, with ``_rows``, the size of the group: status, real translations first, newest id."""
    order = F.struct(-status_rank(F.col("status")), F.coalesce(F.col("provider") != "passthrough", F.lit(True)), F.col("id"))
    keyed = memory.withColumn("_k", F.collate("source_text", collation))
    best = keyed.groupBy(F.col("source_lang").alias("_s"), F.col("target_lang").alias("_t"), "_k").agg(F.max_by(F.struct(*memory.columns), order).alias("_r"), F.count(F.lit(1)).alias("_rows"))
    return best.select("_r.*", "_rows")


def deduplicated(memory: DataFrame, collation: str = COLLATION) -> DataFrame:
    """The winner of each group of equal source texts."""
    return winners(memory, collation).drop("_rows")


def canonicalized(memory: DataFrame, which: Column | None = None) -> DataFrame:
    """The memory with source texts in their normal form, for the rows that ``which`` names, else all.

    A row whose new hash another row holds is dropped; of several that would take one hash the
    smallest id gets it.
    """
    new = F.when(F.lit(True) if which is None else which, normalize(F.col("source_text")))
    moved = memory.select("id", "source_lang", "target_lang", "source_text", new.alias("new_source"))
    moved = moved.filter((F.col("new_source") != "") & (F.col("new_source") != F.col("source_text"))).select("id", "new_source", segment_hash(F.col("source_lang"), F.col("target_lang"), F.col("new_source")).alias("new_hash"))
    first = moved.groupBy("new_hash").agg(F.min("id").alias("owner"))
    held = memory.select(F.col("hash").alias("new_hash")).distinct().withColumn("held", F.lit(True))
    fate = moved.join(first, "new_hash").join(held, "new_hash", "left").select("id", "new_source", "new_hash", (F.col("held").isNull() & (F.col("id") == F.col("owner"))).alias("gets"))
    j = memory.join(fate, "id", "left").filter(F.col("gets").isNull() | F.col("gets"))
    to = {"source_text": F.coalesce("new_source", "source_text"), "hash": F.coalesce("new_hash", "hash")}
    return j.select(*[to[c].alias(c) if c in to else F.col(c) for c in memory.columns])


def folded(memory: DataFrame, collation: str = COLLATION) -> DataFrame:
    """``deduplicated``, the source text of every row that had twins in its normal form."""
    best = keep(winners(memory, collation))
    return canonicalized(best, F.col("_rows") > 1).drop("_rows")


def siblings(memory: DataFrame, collation: str = COLLATION) -> DataFrame:
    """``id``, ``sibling_id``, ``sibling_lang``: rows of the same source text in other target languages, the newest of each.

    The rows of one text are gathered only as far as its target languages, one row each, so no text
    stored many times pairs with itself; ``sibling_groups`` holds all of them.
    """
    rows = memory.withColumn("k", F.collate("source_text", collation))
    one = rows.groupBy("source_lang", "target_lang", "k").agg(F.max("id").alias("sibling_id")).select(F.col("source_lang").alias("sl"), F.col("target_lang").alias("sibling_lang"), F.col("k").alias("k2"), "sibling_id")
    j = rows.join(one, (F.col("source_lang") == F.col("sl")) & (F.col("k") == F.col("k2")) & (F.col("target_lang") != F.col("sibling_lang")))
    return j.select("id", "sibling_id", "sibling_lang")


def sibling_groups(memory: DataFrame, collation: str = COLLATION) -> DataFrame:
    """``group``, ``id``, ``target_lang``: every row that shares its source text with another row of its source language, by the smallest id."""
    rows = memory.filter(F.col("source_lang").isNotNull() & F.col("source_text").isNotNull()).select("id", "source_lang", "target_lang", F.collate("source_text", collation).alias("k"))
    groups = rows.groupBy("source_lang", "k").agg(F.min("id").alias("group"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(groups, ["source_lang", "k"]).select("group", "id", "target_lang")


def siblings_corrected(memory: DataFrame, old: str, new: str, source_lang: str, except_id: int, collation: str = COLLATION) -> DataFrame:
    """The memory with a corrected source text in the other rows of the old text, whatever their target language."""
    twin = (F.col("source_lang") == source_lang) & (F.collate("source_text", collation) == F.collate(F.lit(old), collation)) & (F.col("id") != except_id)
    return corrected(memory, memory.filter(twin).select("id", F.lit(new).alias("new_source")))


def without(memory: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows that ``ids.id`` doesn't name; ids of 0 and below name none."""
    return memory.join(ids.filter("id > 0").select("id").distinct(), "id", "left_anti")


def upsert(memory: DataFrame, changes: DataFrame, now: Column, collation: str = COLLATION) -> DataFrame:
    """The memory with ``changes`` (both languages, texts, ``status``, ``provider``, ``force``) put in.

    A change meets the stored row of its hash. One that meets none meets the best row whose source
    text equals its own but for the collation, which takes over the change's source text, and the
    other rows of that text are deleted. A confirmed or edited row keeps its translation unless the
    change is forced or isn't automatic. What meets no row is new, with ids after the largest in the
    order of the hash. Of several changes for one hash, or for one text without its hash, the best
    status counts, then the text order. A row met in both ways takes the change of its text.
    """
    keyed = with_hash(changes).filter(F.col("hash").isNotNull())
    order = F.struct(status_rank(F.col("status")), F.col("translated_text"), F.col("source_text"))
    change = F.struct("source_lang", "target_lang", "source_text", "translated_text", "status", "provider", "force")
    mine = keep(keyed.groupBy("hash").agg(F.min_by(change, order).alias("c")))
    names = ["_s", "_t", "_k"]
    text = lambda at: (F.col(f"{at}source_lang").alias("_s"), F.col(f"{at}target_lang").alias("_t"), F.collate(F.col(f"{at}source_text"), collation).alias("_k"))
    fresh = mine.join(memory.select("hash"), "hash", "left_anti").select("hash", "c", *text("c."))
    fresh = fresh.groupBy(*names).agg(F.min_by(F.struct(F.col("hash"), F.col("c")), F.struct(status_rank(F.col("c.status")), F.col("c.translated_text"), F.col("hash"))).alias("f"))
    best = memory.select(*text(""), "id", "status").groupBy(*names).agg(F.max_by("id", F.struct(-status_rank(F.col("status")), F.col("id"))).alias("winner"))
    met = fresh.join(best, names, "left")
    twins = met.filter(F.col("winner").isNotNull()).select(*names, "f", "winner")
    stored = memory.withColumns(dict(zip(names, text(""), strict=True))).join(twins, names, "left").filter(F.col("winner").isNull() | (F.col("winner") == F.col("id"))).join(mine, "hash", "left")
    taken = F.coalesce(F.col("f.c"), F.col("c"))
    kept = F.col("status").isin("confirmed", "edited") & (taken["status"] == "auto") & ~F.coalesce(taken["force"], F.lit(False))
    takes = taken.isNotNull() & ~F.coalesce(kept, F.lit(False))
    renamed = F.col("winner").isNotNull()
    updated = stored.select("id", F.when(renamed, F.col("f.hash")).otherwise(F.col("hash")).alias("hash"), "source_lang", "target_lang", F.when(renamed, F.col("f.c.source_text")).otherwise(F.col("source_text")).alias("source_text"), "previous_source_text", *[F.when(takes, taken[x]).otherwise(F.col(x)).alias(x) for x in ("translated_text", "status", "provider")], F.when(takes | renamed, now).otherwise(F.col("updated_at")).alias("updated_at"))
    top = memory.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = with_row_numbers(met.filter(F.col("winner").isNull()).select("f.hash", "f.c"), "hash").join(F.broadcast(top))
    added = numbered.select((F.col("top") + F.col("row_number")).alias("id"), "hash", "c.source_lang", "c.target_lang", "c.source_text", F.lit(None).cast("string").alias("previous_source_text"), "c.translated_text", "c.status", "c.provider", now.alias("updated_at"))
    return updated.unionByName(added)


def confirmed(memory: DataFrame, ids: DataFrame) -> DataFrame:
    """The memory with the rows of ``ids.id`` confirmed and their previous source text cleared."""
    j = memory.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return j.select(*[F.when(F.col("_hit"), F.lit("confirmed")).otherwise(F.col(c)).alias(c) if c == "status" else F.when(F.col("_hit").isNull(), F.col(c)).alias(c) if c == "previous_source_text" else F.col(c) for c in memory.columns])


def corrected(memory: DataFrame, changes: DataFrame) -> DataFrame:
    """The memory with new source texts (``id``, ``new_source``); a change whose hash another row holds is refused.

    Of several rows that claim one new hash the smallest id gets it. The old text is kept as the previous one.
    """
    wanted = memory.join(changes.select("id", "new_source"), "id").filter(~F.col("new_source").eqNullSafe(F.col("source_text")) & (F.trim("new_source") != ""))
    wanted = wanted.withColumn("new_hash", segment_hash(F.col("source_lang"), F.col("target_lang"), F.col("new_source")))
    first = wanted.groupBy("new_hash").agg(F.min("id").alias("id"))
    free = first.join(memory.select(F.col("hash").alias("new_hash")), "new_hash", "left_anti")
    moved = wanted.select("id", "new_source").join(free, "id")
    j = memory.join(moved, "id", "left")
    hit = F.col("new_hash").isNotNull()
    to = {"source_text": F.when(hit, F.col("new_source")).otherwise(F.col("source_text")), "hash": F.when(hit, F.col("new_hash")).otherwise(F.col("hash")), "previous_source_text": F.when(hit, F.col("source_text")).otherwise(F.col("previous_source_text"))}
    return j.select(*[to[c].alias(c) if c in to else F.col(c) for c in memory.columns])


def valid_imports(items: DataFrame) -> DataFrame:
    """Import rows with all four required fields; unknown statuses become auto, a missing provider ``import``."""
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("source_lang", "target_lang", "source_text", "translated_text")]
    ok = items.filter(filled[0] & filled[1] & filled[2] & filled[3])
    return ok.select("source_lang", "target_lang", "source_text", "translated_text", F.when(F.col("status").isin("auto", "edited", "confirmed"), F.col("status")).otherwise("auto").alias("status"), F.when(F.coalesce("provider", F.lit("")) == "", "import").otherwise(F.col("provider")).alias("provider"))


def importable(memory: DataFrame, items: DataFrame, skip_confirmed: bool = True) -> DataFrame:
    """Valid import rows, as forced changes; those whose stored row is confirmed are left out if asked."""
    rows = with_hash(valid_imports(items))
    if skip_confirmed:
        rows = rows.join(memory.filter("status = 'confirmed'").select("hash"), "hash", "left_anti")
    return rows.drop("hash").withColumn("force", F.lit(True))


def import_counts(memory: DataFrame, items: DataFrame, skip_confirmed: bool = True) -> DataFrame:
    """``imported``, ``skipped``: how many items an import takes and how many it leaves out."""
    taken, every = importable(memory, items, skip_confirmed).agg(F.count(F.lit(1)).alias("imported")), items.agg(F.count(F.lit(1)).alias("n"))
    return taken.join(F.broadcast(every)).select("imported", (F.col("n") - F.col("imported")).alias("skipped"))


def lookup(memory: DataFrame, keys: DataFrame, status: str = "") -> DataFrame:
    """Rows of the given hashes and status, by id."""
    wanted = F.lit(True) if not status else F.col("status").isin("auto", "edited") if status == "pending" else F.col("status") == status
    return by_hashes(memory, keys).filter(wanted).orderBy("id")


def export_items(memory: DataFrame) -> DataFrame:
    """The seven exported fields as strings, null as blank, with the id for the order."""
    return memory.select("id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("hash", "source_lang", "target_lang", "source_text", "translated_text", "status", "provider")])


def propagated(texts: DataFrame, old: str, new: str, columns: Sequence[str]) -> DataFrame:
    """``texts`` with every exact occurrence of ``old`` in ``columns`` replaced, and ``changed``."""
    to = {c: F.replace(F.col(c), F.lit(old), F.lit(new)) if old else F.col(c) for c in columns}
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~to[c].eqNullSafe(F.col(c))
    return texts.select("*", changed.alias("changed")).withColumns(to)
