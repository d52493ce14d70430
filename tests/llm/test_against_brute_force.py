import brute
import pytest
from compare import same
from pyspark.sql import functions as F

from lexweave.llm import copies, leaks, neardup, queries, variants


@pytest.fixture(scope="module")
def rows(spark, data):
    return [r.asDict() for r in spark.read.parquet(f"{data}/bt_translations.parquet").collect()]


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.read.parquet(f"{data}/bt_translations.parquet")


def test_variants(table, rows):
    fields = ["source_text", "translated_text"]
    assert {(r.id_a, r.id_b, r.field) for r in variants.variant_pairs(table, fields).collect()} == brute.variants(rows, fields)


def test_copies_in_small_buckets(table, rows):
    assert {(r.first_id, r.id) for r in copies.later_copies(table).collect()} == brute.copies(rows)
    small = copies.copy_classes(table, most=7)
    assert small.agg(F.sum("copies")).first()[0] == len(rows) and small.count() == len(rows) - len(brute.copies(rows))


def test_near_duplicates(table, rows):
    assert {(r.id_a, r.id_b) for r in neardup.near_duplicates(table).collect()} == brute.near(rows)


def test_leaks_both_ways(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute.leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    sent, joined = leaks.leaks(docs, items), leaks.leaks(docs, items, most_sent=0)
    assert {(r.doc_id, r.item_id) for r in sent.filter("exact_run >= 8").collect()} == want
    assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, joined.collect()))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, data, name):
    same(spark, data, queries.queries()[name], queries.oracle_sql()[name])
