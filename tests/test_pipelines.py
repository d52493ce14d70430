import json

import pytest
from pyspark.sql import functions as F
from test_operators import memory

from lexweave.config import LANGUAGES
from lexweave.functions import text as T, urls as U
from lexweave.operators import content as P, coverage as C, hygiene as H, jobs as J, memory as M, resolve as R, review as V, terms as G
from lexweave.sources import exchange, providers
from lexweave.sources.store import SCHEMA, MemoryStore

def now():
    return F.lit(None).cast("timestamp_ntz")


def changes(spark, *rows):
    return spark.createDataFrame([("de", "en", *r) for r in rows], "source_lang string, target_lang string, source_text string, translated_text string, status string, provider string, force boolean")


@pytest.fixture(scope="module")
def terms(spark):
    g = spark.createDataFrame([("en", "Netzteil", "power supply"), ("en", "netzteil", "psu"), ("en", " # x", "y"), ("en", "Tür", "")], "lang string, source string, target string")
    return g, spark.createDataFrame([("Arduino",), (" # Kommentar",), ("",), (None,), ("Arduino Uno",)], "phrase string")


def test_upsert_meets_twins(spark):
    m = memory(spark, (1, "Warte…", "a", "auto"), (2, "warte...", "b", "edited"), (3, "x", "c", "confirmed"))
    got = {r.id: (r.source_text, r.translated_text, r.status) for r in M.upsert(m, changes(spark, ("WARTE...", "n", "auto", "p", False)), now()).collect()}
    # the best twin keeps its translation, takes the new source, the other one goes
    assert got == {2: ("WARTE...", "b", "edited"), 3: ("x", "c", "confirmed")}
    got = {r.id: (r.source_text, r.translated_text) for r in M.upsert(m, changes(spark, ("X", "n", "auto", "p", True)), now()).collect()}
    assert got == {1: ("Warte…", "a"), 2: ("warte...", "b"), 3: ("X", "n")}
    new = M.upsert(m, changes(spark, ("neu", "n", "auto", "p", False), ("NEU", "m", "edited", "p", False)), now())
    assert {(r.id, r.source_text) for r in new.collect()} >= {(4, "NEU")} and new.count() == 4


def test_canonical_conflicts(spark):
    m = memory(spark, (1, "hier :", "a", "auto"), (2, "hier  :", "b", "auto"), (3, "Da :", "c", "auto"), (4, "Da:", "d", "auto"))
    assert {r.id: r.source_text for r in M.canonicalized(m).collect()} == {1: "hier:", 4: "Da:"}
    assert {r.id: r.source_text for r in M.folded(memory(spark, (1, "da …", "a", "auto"), (2, "Da …", "b", "edited"), (3, "so :", "c", "auto"))).collect()} == {2: "Da...", 3: "so :"}


def test_groups(spark):
    m = memory(spark, (1, "a", "x", "auto"), (2, "A", "y", "auto"), (3, "b", "z", "auto"))
    other = m.filter("id = 1").withColumns({"id": F.lit(9).cast("long"), "target_lang": F.lit("fr")})
    assert sorted(map(tuple, M.sibling_groups(m.unionByName(other)).collect())) == [(1, 1, "en"), (1, 2, "en"), (1, 9, "fr")]
    assert sorted(map(tuple, M.duplicate_members(m).collect())) == [(1, 1, 2), (1, 2, 2)]
    fixed = M.siblings_corrected(m.unionByName(other), "a", "neu", "de", 1)
    assert {r.id: r.source_text for r in fixed.collect()} == {1: "a", 2: "neu", 3: "b", 9: "neu"}


def test_terms(spark, terms):
    g, p = terms
    texts = spark.createDataFrame([("Netzteil", "EN"), ("netzteil", "en"), ("NETZTEIL ", "en"), ("Tür", "en")], "t string, l string")
    assert {r.t: r.glossary_target for r in G.translated_terms(texts, "t", "l", g).collect()} == {"Netzteil": "power supply", "netzteil": "psu", "NETZTEIL ": "power supply"}
    todo = spark.createDataFrame([("Das Netzteil am ARDUINO uno kostet 5 V + 3 V, siehe www.a.de.", "de", "en"), ("# Kommentar", "de", "fr")], "segment string, lang string, target_lang string")
    seen = {r.segment[:3]: r.result for r in R.fetched(todo, lambda t, a, b: t.replace("Das", "The"), g, p).collect()}
    assert seen["Das"] == "The power supply am ARDUINO uno kostet 5 V + 3 V, siehe www.a.de." and seen["# K"] == "# Kommentar"
    rows = R.resolve(spark.createDataFrame([("# Kommentar", "de", "en"), ("arduino", "de", "en"), ("netzteil", "de", "en"), ("(NETZTEIL)", "de", "en")], "segment string, lang string, target_lang string"), memory(spark), g, p).collect()
    assert {r.segment: (r.rule, r.result) for r in rows} == {"# Kommentar": ("fetch", None), "arduino": ("protected", "arduino"), "netzteil": ("glossary", "psu"), "(NETZTEIL)": ("affix_glossary", "(power supply)")}


def test_budget_and_counters(spark, terms):
    segs = spark.createDataFrame([(f"Die Lampe {x}", "de", "en") for x in "abc"] + [("R1,R2", "de", "en")], "segment string, lang string, target_lang string")
    got = R.resolve(segs, memory(spark), *terms, budget=2)
    assert sorted(r.rule for r in got.collect()) == ["fetch", "fetch", "partial", "passthrough"]
    assert tuple(R.counters(got).first()) == (1, 2, 33)


def test_translated_documents(spark, terms):
    docs = spark.createDataFrame([(1, "de", "en", "<p>Die Tür</p><code>Die Tür</code><b> Lampe :</b>"), (2, "en", "en", "<p>Die Tür</p>"), (3, "de", "en", None), (4, "de", "en", " ")], "doc_id long, lang string, target_lang string, content string")
    m = memory(spark, (1, "Die Tür", "The <door>", "confirmed"))
    got = {r.doc_id: r.translated for r in P.translated(docs, m, *terms).collect()}
    assert got == {1: "<p>The &lt;door&gt;</p><code>Die Tür</code><b> Lampe :</b>", 2: "<p>Die Tür</p>", 3: None, 4: " "}
    fetched = {r.doc_id: r.translated for r in P.translated(docs, m, *terms, lambda t, a, b: t.upper()).collect()}
    assert fetched[1] == "<p>The &lt;door&gt;</p><code>Die Tür</code><b> LAMPE:</b>"


def test_retranslated(spark):
    m = memory(spark, (1, "Die Tür", "x", "confirmed"), (2, "Die Lampe", "x", "edited"), (3, "Das Bild", "x", "auto"))

    def call(text, a, b):
        if "Bild" in text:
            raise RuntimeError("down")
        return "The lamp"

    got = {r.id: (r.translated_text, r.status) for r in P.retranslated(m, m.select("id"), call, now()).collect()}
    assert got == {1: ("x", "confirmed"), 2: ("The lamp", "auto"), 3: ("x", "auto")}


def test_filled(spark, terms):
    m = memory(spark, (1, "Die Tür", "The door", "confirmed"))
    segs = C.with_target(spark.createDataFrame([(1, "de", "Die Tür"), (1, "de", "Die Lampe"), (1, "de", "Das Bild"), (2, "de", "Die Lampe"), (2, "de", "arduino"), (3, "de", "Die Tür")], "doc_id long, lang string, segment string"), F.lit("en"))

    def call(text, a, b):
        if "Bild" in text:
            raise RuntimeError("down")
        return "The lamp"

    after, counts = P.filled(segs, m, *terms, call, now())
    assert {r.doc_id: (r.translated, r.remaining, r.error) for r in counts.collect()} == {1: (1, 1, "down"), 2: (1, 1, None), 3: (0, 0, None)}
    assert {r.source_text for r in after.collect()} == {"Die Tür", "Die Lampe"}


def test_focus_and_list(spark):
    m = memory(spark, (1, "Die Tür", "The door", "confirmed"), (2, "Die Lampe", "The lamp ..", "auto"), (3, "Das Bild", "The picture", "edited"), (4, "Das Dach", "", "auto"))
    assert tuple(P.focus(m).first()) == (2, "The lamp..", "auto", 3, 4, 3) or P.focus(m).first().id == 2
    assert P.focus(m, 1).first().id == 1 and P.focus(m, 3, "fr").first().id is None
    r = P.focus(m, 3).first()
    assert (r.prev_id, r.next_id, r.pending) == (2, 4, 3)
    assert [x.id for x in P.review_list(m, sort="longest").orderBy("id").collect()] == [2, 3, 4]
    assert tuple(V.adjacent(m, 1).first()) == (4, 2) and tuple(V.adjacent(m, 3).first()) == (2, 4)
    assert tuple(V.adjacent(m.filter("id = 2"), 2).first()) == (None, None)
    assert [x.id for x in V.clamped_page(m, "shortest", 99, 3).collect()] == [2] and V.clamped_page(m.limit(0)).count() == 0
    assert tuple(H.maintenance_counts(m).first()) == (0, 0, 0)


def test_queue_states(spark):
    queue = spark.createDataFrame([("auto", 0, "en", "a")], "type string, id long, lang string, text string")
    status = spark.createDataFrame([("done", 2, 9, 1, 5)], "state string, total long, done long, errors long, started long")
    whole, now = J.appended(queue, spark.createDataFrame([("b",), ("b",), (" ",), (None,)], "text string"), ["en", "fr"], status)
    assert whole.count() == 3 and tuple(now.first()) == ("running", 12, 9, 1, 5)
    assert tuple(J.replaced(whole, F.lit(7))[1].first()) == ("running", 3, 0, 0, 7)


def test_store(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "memory"))
    with pytest.raises(ValueError):
        store.read()
    store.create()
    assert store.read().count() == 0
    m = memory(spark, (1, "a", "b", "auto"))
    store.write(m)
    store.write(M.upsert(store.read(), changes(spark, ("c", "d", "auto", "p", False)), now()))
    assert {r.source_text for r in store.read().collect()} == {"a", "c"} and len(list((tmp_path / "memory").iterdir())) == 2
    assert [c.split()[0] for c in SCHEMA.split(", ")] == store.read().columns
    store.drop()
    assert not (tmp_path / "memory").exists()


def test_document_round_trip(spark, tmp_path):
    m = memory(spark, (2, 'ä"\\\n', "x", "auto"), (1, "b", "y", "edited"))
    exchange.write_document(m, str(tmp_path / "e"), "de", F.lit("2024-01-01").cast("timestamp_ntz"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "e").glob("part-*")))
    doc = json.loads(whole)
    assert (doc["version"], doc["exported_at"], doc["source_lang"]) == (1, "2024-01-01T00:00:00Z", "de")
    assert [i["source_text"] for i in doc["items"]] == ["b", 'ä"\\\n']
    (tmp_path / "one.json").write_text(whole)
    assert exchange.read_import(spark, str(tmp_path / "one.json")).count() == 2
    empty = exchange.export_document(m.limit(0), "de", F.lit("2024-01-01").cast("timestamp_ntz")).orderBy("line").collect()
    assert json.loads("".join(r.value for r in empty))["items"] == []


def test_providers():
    answers = {"mymemory": {"responseStatus": 200, "responseData": {"translatedText": "a &amp; b"}}, "deepl": {"translations": [{"text": "x"}]}, "google": {"data": {"translations": [{"translatedText": "&lt;"}]}}, "libretranslate": {"translatedText": "y"}}
    asked = []
    call = lambda slug, f: (asked.append(f), (200, json.dumps(answers[slug])))[1]
    got = {x: providers.provider(x, call).translate("Hallo", "de", "en") for x in answers}
    assert got == {"mymemory": "a & b", "deepl": "x", "google": "<", "libretranslate": "y"}
    assert asked[1] == {"text": "Hallo", "source_lang": "DE", "target_lang": "EN-US"} and providers.provider("?", call).slug == "mymemory"
    asked.clear()
    assert providers.provider("mymemory", call).translate(("x" * 300 + ". ") * 3, "de", "en") == "a & b a & b a & b" and len(asked) == 3
    for code, body in ((500, "{}"), (200, "no"), (200, '{"translatedText": " "}'), (403, '{"error": "key"}')):
        with pytest.raises(RuntimeError):
            providers.provider("libretranslate", lambda s, f, c=code, b=body: (c, b)).translate("a", "de", "en")
    with pytest.raises(RuntimeError):
        providers.provider("mymemory", lambda s, f: (200, '{"responseStatus": 200, "responseData": {"translatedText": "INVALID LANGUAGE PAIR"}}')).translate("a", "de", "en")


def test_pages(spark):
    df = spark.createDataFrame([("/en/a?b=1", "x")], "u string, c string")
    rows = df.select(F.inline(U.alternates(F.col("u"), ("en", "fr"), "de"))).collect()
    assert {r.lang: r.url for r in rows} == {"de": "/a/?b=1", "en": "/en/a/?b=1", "fr": "/fr/a/?b=1", "x-default": "/a/?b=1"}
    rows = df.select(F.inline(U.switcher(F.col("u"), ("en", "pl"), "de", LANGUAGES))).collect()
    assert [(r.lang, r.label, r.is_current) for r in rows] == [("de", "German", False), ("en", "English", True), ("pl", "Polish", False)]


def test_settings_lists(spark):
    df = spark.createDataFrame([("  b\r\n# x\n\nlonger\nb", "3, 4 x -1 3")], "l string, i string")
    r = df.select(T.line_list(F.col("l")).alias("l"), T.id_list(F.col("i")).alias("i")).first()
    assert r.l == ["longer", "b", "b"] and r.i == [3, 4]
