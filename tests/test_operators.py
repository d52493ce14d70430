from pyspark.sql import functions as F

from lexweave.config import Settings
from lexweave.operators import hygiene as H, memory as M, review as V, terms as G
from lexweave.sources import exchange, html
from lexweave.streaming import queue as S

MEMORY = "id long, hash string, source_lang string, target_lang string, source_text string, previous_source_text string, translated_text string, status string, provider string, updated_at timestamp_ntz"


def memory(spark, *rows):
    df = spark.createDataFrame([(i, None, "de", "en", s, None, t, st, "deepl", None) for i, s, t, st in rows], MEMORY)
    return M.with_hash(df).select(*[f.split()[0] for f in MEMORY.split(", ")])


def test_collation_twins(spark):
    m = memory(spark, (1, "Warte…", "a", "auto"), (2, "warte...", "b", "confirmed"), (3, "Straße", "c", "auto"), (4, "STRASSE ", "d", "edited"))
    assert sorted(r.id for r in M.deduplicated(m).collect()) == [2, 4]
    assert M.deduplicated(M.deduplicated(m)).count() == 2


def test_upsert(spark):
    m = memory(spark, (7, "a", "A", "confirmed"), (9, "b", "B", "auto"))
    new = [("de", "en", s, t, "auto", "x", f) for s, t, f in (("a", "A2", False), ("b", "B2", False), ("c", "C", False), ("c", "C0", False))]
    df = spark.createDataFrame(new, "source_lang string, target_lang string, source_text string, translated_text string, status string, provider string, force boolean")
    got = {r.source_text: (r.id, r.translated_text) for r in M.upsert(m, df, F.lit(None).cast("timestamp_ntz")).collect()}
    assert got == {"a": (7, "A"), "b": (9, "B2"), "c": (10, "C")}
    forced = {r.source_text: r.translated_text for r in M.upsert(m, df.withColumn("force", F.lit(True)), F.lit(None).cast("timestamp_ntz")).collect()}
    assert forced["a"] == "A2"
    assert M.upsert(m.limit(0), df.limit(0), F.lit(None).cast("timestamp_ntz")).count() == 0


def test_correction_refuses_taken_hashes(spark):
    m = memory(spark, (1, "a", "x", "auto"), (2, "b", "y", "auto"), (3, "c", "z", "auto"))
    change = spark.createDataFrame([(1, "b"), (2, "d"), (3, "d")], "id long, new_source string")
    assert {r.id: r.source_text for r in M.corrected(m, change).collect()} == {1: "a", 2: "d", 3: "c"}


def test_passthrough_heals(spark):
    m = memory(spark, (1, "R1,R2", "R1:R2", "auto"), (2, "Die Tür", "The door ..", "auto"))
    got = {r.id: (r.translated_text, r.status, r.provider) for r in H.healed(m).collect()}
    assert got[1] == ("R1,R2", "confirmed", "passthrough") and got[2][1] == "auto"


def test_neighbours(spark):
    m = memory(spark, (3, "a", "x", "auto"), (5, "b", "y", "auto"), (9, "c", "z", "confirmed"), (11, "d", "w", "edited"))
    assert {r.id: (r.prev_id, r.next_id) for r in V.neighbours(m).collect()} == {3: (11, 5), 5: (3, 11), 11: (5, 3)}
    assert V.neighbours(m.filter("id = 3")).first().next_id is None
    assert V.neighbours(m.limit(0)).count() == 0


def test_diff():
    assert V.token_diff("a b c", "a x c") == [("eq", "a"), ("eq", " "), ("ins", "x"), ("del", "b"), ("eq", " "), ("eq", "c")]
    assert V.token_diff("", "a") == [("ins", "a")] and V.token_diff("a b", "b") == [("del", "a"), ("del", " "), ("eq", "b")]
    assert V.token_diff("x y", "x y") == [("eq", "x"), ("eq", " "), ("eq", "y")]


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "Foo Bar und foo bar"), (2, None), (3, "")], "doc_id long, text string")
    phrases = spark.createDataFrame([("foo bar",), ("# x",), ("",), (None,)], "phrase string")
    assert [tuple(r) for r in G.contained(docs, "doc_id", "text", phrases).select("id", "key", "times").collect()] == [(1, "foo bar", 2)]
    assert G.contained(docs, "doc_id", "text", phrases.limit(0)).count() == 0


def test_html(spark):
    doc = "<p>Hallo &amp; <b class='x'>Welt</b></p><script>var a = '<p>';</script><code>x</code> Ende <br> neu"
    df = spark.createDataFrame([(doc,), (None,), ("kein Tag",)], "h string")
    assert [r.s for r in df.select(html.segments(F.col("h")).alias("s")).collect()] == [["Hallo &", "Welt", "Ende", "neu"], [], ["kein Tag"]]
    k, v = F.array(F.lit("Welt"), F.lit("Ende")), F.array(F.lit("World"), F.lit("<End>"))
    assert df.select(html.replaced("h", k, v).alias("s")).first().s == doc.replace("Welt", "World").replace(" Ende ", " &lt;End&gt; ")


def test_exchange(spark, tmp_path):
    m = memory(spark, (1, "ä\"b", "x", "auto"), (2, "b", "y", "edited"))
    exchange.write_export(m, str(tmp_path / "e"))
    back = exchange.read_import(spark, str(tmp_path / "e"))
    assert sorted(r.source_text for r in back.collect()) == ["b", "ä\"b"]
    (tmp_path / "doc.json").write_text('{"version": 1,\n "items": [{"source_lang": "de", "target_lang": "en", "source_text": "a", "translated_text": "b", "status": "odd"}]}')
    one = M.valid_imports(exchange.read_import(spark, str(tmp_path / "doc.json"))).first()
    assert (one.status, one.provider) == ("auto", "import")


def test_stream(spark, tmp_path):
    items = spark.createDataFrame([("post_title", 1, "en", "a"), ("post_title", 2, "en", " "), ("auto", 0, "fr", "b")], S.SCHEMA)
    items.coalesce(1).write.parquet(str(tmp_path / "in"))
    items.limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = S.drain(S.read_queue(spark, str(tmp_path / "in")), lambda df: df.select("id", F.upper("text").alias("t")), str(tmp_path / "out"), str(tmp_path / "st"), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    p = S.progress(spark, str(tmp_path / "st"), 3).first()
    assert (p.done, p.blank, p.errors, p.total, p.state) == (4, 1, 0, 4, "done")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_settings():
    s = Settings.of({"source_lang": "en", "target_langs": ("en", "xx"), "provider": "?"})
    assert (s.source_lang, s.target_langs, s.provider, s.all_langs) == ("en", ("fr",), "mymemory", ("en", "fr"))
