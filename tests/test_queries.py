import pytest
from compare import same
from pyspark.sql import functions as F

from lexweave.operators import memory as M, review as V, terms as G
from lexweave.queries import QUERIES, segs


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in QUERIES.items() if sql))
def test_same_as_sql(spark, data, name):
    same(spark, data, *QUERIES[name])


@pytest.mark.parametrize("name", ["healed_memory", "polished", "guarded_tokens", "retranslated"])
def test_keeps_every_row(spark, data, name):
    ids = [r.id for r in QUERIES[name][0](spark, data).select("id").collect()]
    assert sorted(ids) == sorted(r.id for r in spark.read.parquet(f"{data}/bt_translations.parquet").select("id").collect())


def test_diff_rebuilds_both_texts(spark, data):
    rows = spark.read.parquet(f"{data}/bt_translations.parquet").filter("previous_source_text <> source_text").select("previous_source_text", "source_text", V.diff("previous_source_text", "source_text").alias("d")).collect()
    assert rows
    for old, new, d in rows:
        assert "".join(x.token for x in d if x.op != "ins") == old and "".join(x.token for x in d if x.op != "del") == new
    assert {r.op for r in QUERIES["source_diff"][0](spark, data).select("op").distinct().collect()} <= {"eq", "del", "ins"}


def test_chunks_fit(spark, data):
    rows = QUERIES["request_chunks"][0](spark, data).collect()
    assert max(len(r.text) for r in rows) <= 450
    assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").filter("trim(text) <> ''").collect()}


def test_every_segment_has_a_rule(spark, data):
    rows = QUERIES["resolved_segments"][0](spark, data).collect()
    assert len(rows) == segs(spark, data).select("segment", "lang", "target_lang").distinct().count()
    assert all(r.result is None for r in rows if r.rule == "fetch") and all(r.result is not None for r in rows if r.rule not in ("fetch", "partial"))
    few = QUERIES["resolved_within_budget"][0](spark, data)
    assert few.filter("rule = 'fetch'").groupBy("lang", "target_lang").count().agg({"count": "max"}).first()[0] == 5
    counts = QUERIES["resolution_counters"][0](spark, data).first()
    assert counts.calls == sum(r.rule == "fetch" for r in rows)


def test_collation_leaves_one_of_each(spark, data):
    m = spark.read.parquet(f"{data}/bt_translations.parquet")
    kept = {r.id for r in QUERIES["dedupe_by_collation"][0](spark, data).collect()}
    groups = m.groupBy("source_lang", "target_lang", F.collate("source_text", M.COLLATION)).count().count()
    assert len(kept) == groups and kept <= {r.id for r in m.collect()}


def test_glossary_goes_in(spark, data):
    rows = QUERIES["upsert_glossary"][0](spark, data).collect()
    have = {(r.target_lang, r.source_text.lower()) for r in rows if r.source_lang == "de" and r.source_text}
    g = G.glossary_map(spark.read.parquet(f"{data}/glossary.parquet")).collect()
    assert g and all((r.lang, r.source.lower()) in have for r in g) and len({r.id for r in rows}) == len(rows)


def test_documents_are_translated(spark, data):
    rows = QUERIES["translated_documents"][0](spark, data).collect()
    assert all(r.translated.startswith("<script>x < 1</script><p>") and r.translated.endswith("<code>y</code>") for r in rows) and sum("en] " in r.translated or "de] " in r.translated for r in rows) > len(rows) / 2
    filled = QUERIES["filled_documents"][0](spark, data).collect()
    assert all(r.error is None and r.translated >= 0 for r in filled) and sum(r.translated for r in filled) > 0
    assert all(r.error is None and r.result for r in QUERIES["fetched_titles"][0](spark, data).collect())


def test_terms_are_masked(spark, data):
    rows = QUERIES["masked_terms"][0](spark, data).collect()
    assert any(r.back_to for r in rows) and all(r.masked.count("__BTX") == len(r.back_to) for r in rows)


def test_guards_come_back(spark, data):
    assert QUERIES["guarded_tokens"][0](spark, data).filter("not round_trip").count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
