"""More queries of the core: snapshots after an upsert, composed pipelines, the queue's state, settings and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.config import LANGUAGES
from lexweave.functions import text as T
from lexweave.functions import urls as U
from lexweave.operators import content as P
from lexweave.operators import coverage as C
from lexweave.operators import hygiene as H
from lexweave.operators import jobs as J
from lexweave.operators import memory as M
from lexweave.operators import resolve as R
from lexweave.operators import review as V
from lexweave.operators import terms as G
from lexweave.queries import DEDUPED, HASH, IMPORTS, KEY, LANGS_SQL, LCASE, NORMAL, RANK, SCORE, SEGS_SQL, SLUG, TARGETS, canonical_sql, capitals_sql, junk_sql, mem, passthrough_sql, q, query, segs, table
from lexweave.sources import exchange as X
from lexweave.sources import html, providers

NOW = "2024-01-01"
GIVEN = "source_lang IS NOT NULL AND target_lang IS NOT NULL AND source_text IS NOT NULL"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


# --- the memory after changes

CHANGES = f"""ch AS (SELECT source_lang, target_lang, replace(source_text, 'a', 'A') AS source_text, concat('+', translated_text) AS translated_text, 'auto' AS status, 'import' AS provider, target_lang = 'fr' AS force FROM bt_translations WHERE status = 'edited' AND {GIVEN}),
hc AS (SELECT *, {HASH} AS h FROM ch),
mine AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY translated_text, source_text) AS n FROM hc) WHERE n = 1),
fresh AS (SELECT * FROM (SELECT *, lower(source_text) AS k, row_number() OVER (PARTITION BY source_lang, target_lang, lower(source_text) ORDER BY translated_text, h) AS n2 FROM mine WHERE h NOT IN (SELECT hash FROM bt_translations WHERE hash IS NOT NULL)) WHERE n2 = 1),
best AS (SELECT source_lang, target_lang, k, id AS winner FROM (SELECT *, lower(source_text) AS k, row_number() OVER (PARTITION BY source_lang, target_lang, lower(source_text) ORDER BY {RANK}, id DESC) AS n FROM bt_translations) WHERE n = 1),
met AS (SELECT f.*, b.winner FROM fresh f LEFT JOIN best b ON f.source_lang = b.source_lang AND f.target_lang = b.target_lang AND f.k = b.k),
j AS (SELECT b.*, m.winner, m.h AS new_hash, m.source_text AS new_source, coalesce(m.h, c.h) AS got, CASE WHEN m.h IS NOT NULL THEN m.translated_text ELSE c.translated_text END AS new_text, CASE WHEN m.h IS NOT NULL THEN m.force ELSE c.force END AS forced FROM bt_translations b LEFT JOIN (SELECT * FROM met WHERE winner IS NOT NULL) m ON m.source_lang = b.source_lang AND m.target_lang = b.target_lang AND m.k = lower(b.source_text) LEFT JOIN mine c ON c.h = b.hash WHERE m.winner IS NULL OR m.winner = b.id),
u AS (SELECT *, got IS NOT NULL AND NOT coalesce(status IN ('confirmed', 'edited') AND NOT coalesce(forced, false), false) AS takes FROM j)"""


@query("upserted_import", f"WITH {CHANGES} SELECT id, coalesce(new_hash, hash) AS hash, coalesce(new_source, source_text) AS source_text, CASE WHEN takes THEN new_text ELSE translated_text END AS translated_text, CASE WHEN takes THEN 'auto' ELSE status END AS status, CASE WHEN takes THEN 'import' ELSE provider END AS provider FROM u UNION ALL SELECT (SELECT max(id) FROM bt_translations) + row_number() OVER (ORDER BY h), h, source_text, translated_text, status, provider FROM met WHERE winner IS NULL")
def upserted_import(spark, d):
    m = mem(spark, d)
    changes = m.filter(f"status = 'edited' AND {GIVEN}").select("source_lang", "target_lang", F.replace("source_text", F.lit("a"), F.lit("A")).alias("source_text"), F.concat(F.lit("+"), F.coalesce("translated_text", F.lit(""))).alias("translated_text"), F.lit("auto").alias("status"), F.lit("import").alias("provider"), (F.col("target_lang") == "fr").alias("force"))
    return M.upsert(m, changes, now(), LCASE).select("id", "hash", "source_text", "translated_text", "status", "provider")


def folded_sql(base: str, which: str) -> str:
    return f"""WITH b AS ({base}), w AS (SELECT *, {capitals_sql('c')} AS new_source FROM (SELECT *, {NORMAL} AS c FROM b WHERE {which})),
m AS (SELECT id, new_source, sha256(concat(source_lang, chr(0), target_lang, chr(0), new_source)) AS new_hash FROM w WHERE new_source <> '' AND new_source <> source_text AND source_lang IS NOT NULL AND target_lang IS NOT NULL),
f AS (SELECT *, new_hash NOT IN (SELECT hash FROM b WHERE hash IS NOT NULL) AND id = min(id) OVER (PARTITION BY new_hash) AS gets FROM m)
SELECT b.id, coalesce(f.new_hash, b.hash) AS hash, coalesce(f.new_source, b.source_text) AS source_text FROM b LEFT JOIN f ON f.id = b.id WHERE f.gets IS NULL OR f.gets"""


@query("canonicalized", folded_sql("SELECT * FROM bt_translations", "true"))
def canonicalized(spark, d):
    return M.canonicalized(mem(spark, d)).select("id", "hash", "source_text")


@query("folded_memory", folded_sql(DEDUPED.replace("SELECT *, row_number()", "SELECT *, count(*) OVER (PARTITION BY source_lang, target_lang, lower(source_text)) AS twins, row_number()"), "twins > 1"))
def folded_memory(spark, d):
    return M.folded(mem(spark, d), LCASE).select("id", "hash", "source_text")


@query("duplicate_members", "SELECT min(id) OVER w AS \"group\", id, count(*) OVER w AS rows FROM bt_translations WINDOW w AS (PARTITION BY source_lang, target_lang, lower(source_text)) QUALIFY rows > 1")
def duplicate_members(spark, d):
    return M.duplicate_members(mem(spark, d), LCASE)


@query("sibling_groups", "SELECT min(id) OVER w AS \"group\", id, target_lang FROM bt_translations WHERE source_lang IS NOT NULL AND source_text IS NOT NULL WINDOW w AS (PARTITION BY source_lang, lower(source_text)) QUALIFY count(*) OVER w > 1")
def sibling_groups(spark, d):
    return M.sibling_groups(mem(spark, d), LCASE)


@query("lookup_rows", "SELECT id, status FROM bt_translations WHERE status IN ('auto', 'edited') AND hash IN (SELECT hash FROM bt_translations WHERE provider = 'deepl' AND hash <> '') ORDER BY id")
def lookup_rows(spark, d):
    return M.lookup(mem(spark, d), mem(spark, d).filter("provider = 'deepl'").select("hash"), "pending").select("id", "status")


@query("rows_by_id", "SELECT id, status, provider FROM bt_translations WHERE id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def rows_by_id(spark, d):
    return M.by_ids(mem(spark, d), [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]).select("id", "status", "provider")


@query("import_counts", f"SELECT n AS imported, (SELECT count(*) FROM bt_translations) - n AS skipped FROM (SELECT count(*) AS n FROM ({IMPORTS}) WHERE {HASH} NOT IN (SELECT hash FROM bt_translations WHERE status = 'confirmed' AND hash IS NOT NULL))")
def import_counts(spark, d):
    return M.import_counts(mem(spark, d), mem(spark, d))


@query("maintenance_counts", f"WITH d AS ({DEDUPED}), k AS (SELECT *, {junk_sql()} AS kind FROM d) SELECT (SELECT count(*) FROM bt_translations) - (SELECT count(*) FROM d) AS deduped, count(*) FILTER (WHERE kind IS NOT NULL) AS purged, count(*) FILTER (WHERE kind IS NULL AND {passthrough_sql()}) AS confirmed FROM k")
def maintenance_counts(spark, d):
    return H.maintenance_counts(mem(spark, d), LCASE)


CASES = ((1, "auto", "Die Lampe", "MYMEMORY WARNING: YOU USED ALL"), (2, "edited", "Die Lampe", "MYMEMORY WARNING: YOU USED ALL"), (3, "auto", "www.a.de/b", "x"), (4, "auto", "5 mA", "x"), (5, "auto", "ABC1", "x"), (6, "edited", "5 mA", "x"), (7, "confirmed", "git clone x", "x"), (8, "auto", "[gallery ids=\"1\"]", "x"), (9, "auto", "hpcom-v11-6387f94d73599945123156", "x"), (10, "auto", "Die Tür ist offen", "The door is open"), (11, "auto", "if (a) { b; c; }", "x"))
VALUES = ", ".join(f"({i}, {q(s)}, {q(a)}, {q(b)})" for i, s, a, b in CASES)


@query("purge_cases", f"SELECT id, {junk_sql()} AS kind FROM (VALUES {VALUES}) t(id, status, source_text, translated_text)")
def purge_cases(spark, d):
    df = spark.createDataFrame(list(CASES), "id int, status string, source_text string, translated_text string")
    return df.select("id", H.junk_kind(df).alias("kind"))


# --- review

CLEANED = f"SELECT * REPLACE (CASE WHEN hit THEN 'confirmed' ELSE status END AS status) FROM (SELECT *, {passthrough_sql()} AS hit FROM ({DEDUPED}) WHERE ({junk_sql()}) IS NULL)"


@query("review_list", f"WITH p AS (SELECT * FROM ({CLEANED}) WHERE status IN ('auto', 'edited') AND target_lang = 'en' ORDER BY length(source_text) DESC, id DESC LIMIT 100) SELECT id, status FROM (SELECT id, status, row_number() OVER (PARTITION BY source_lang, target_lang, k, CASE WHEN k = '' THEN id END ORDER BY score DESC, id DESC) AS n FROM (SELECT *, {SCORE} AS score, {canonical_sql('source_text')} AS k FROM p)) WHERE n = 1 OR status <> 'auto'")
def review_list(spark, d):
    return P.review_list(mem(spark, d), "pending", "en", "", "longest", 1, 100, LCASE).select("id", "status")


@query("focus_item", f"WITH c AS ({CLEANED}), p AS (SELECT id FROM c WHERE status IN ('auto', 'edited') AND target_lang = 'fr') SELECT f.id, status, (SELECT count(*) FROM p) AS pending, (SELECT max(id) FROM p WHERE id <> f.id) AS prev_id, (SELECT min(id) FROM p WHERE id > f.id) AS next_id FROM (SELECT min(id) AS id FROM p) f JOIN c USING (id)")
def focus_item(spark, d):
    return P.focus(mem(spark, d), -1, "fr", LCASE).select("id", "status", "pending", "prev_id", "next_id")


@query("adjacent_ids", "SELECT coalesce(max(id) FILTER (WHERE id < c), max(id)) AS prev_id, coalesce(min(id) FILTER (WHERE id > c), min(id)) AS next_id FROM (SELECT id, (SELECT min(id) FROM bt_translations WHERE status = 'edited') AS c FROM bt_translations WHERE status IN ('auto', 'edited'))")
def adjacent_ids(spark, d):
    return V.adjacent(mem(spark, d), mem(spark, d).filter("status = 'edited'").agg(F.min("id")).first()[0] or 0)


@query("last_page", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY updated_at DESC, id DESC) AS n, count(*) OVER () AS total FROM bt_translations WHERE status = 'edited') WHERE n > 20 * ((total - 1) // 20)")
def last_page(spark, d):
    return V.clamped_page(mem(spark, d).filter("status = 'edited'"), "newest", 10**9).select("id")


@query("memory_stats_with_counters", "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'auto') AS auto, count(*) FILTER (WHERE status = 'edited') AS edited, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, 7 AS api_calls, 21 AS cache_hits, 75 AS hit_rate FROM bt_translations")
def memory_stats_with_counters(spark, d):
    return V.stats_with(mem(spark, d), spark.createDataFrame([(20, 5), (1, 2)], "hits long, calls long"))


# --- documents


def pages(spark, d):
    """The documents as HTML, a paragraph for each line."""
    safe = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    docs = table(spark, d, "documents").filter("lang is not null")
    return docs.select("doc_id", "lang", F.when(F.col("lang") == "de", "en").otherwise("de").alias("target_lang"), F.concat(F.lit("<script>x < 1</script><p>"), F.replace(safe, F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p><code>y</code>")).alias("content"))


LINES = "SELECT doc_id, trim(line) AS segment, min(n) AS first FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents WHERE lang IS NOT NULL) WHERE regexp_matches(line, '[^ \t\n\r\f\x0B ]') GROUP BY doc_id, trim(line)"


@query("extracted_segments", f"SELECT doc_id, segment, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INT AS pos FROM ({LINES})")
def extracted_segments(spark, d):
    return P.extracted(pages(spark, d)).select("doc_id", "segment", "pos")


@query("applied_translations", "SELECT doc_id, md5('<script>x < 1</script><p>' || string_agg(CASE WHEN length(trim(line)) > 20 THEN replace(line, trim(line), '[' || safe || ']') ELSE replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END, '</p>' || chr(10) || '<p>' ORDER BY n) || '</p><code>y</code>') AS digest FROM (SELECT *, replace(replace(replace(trim(line), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents WHERE lang IS NOT NULL)) GROUP BY doc_id")
def applied_translations(spark, d):
    docs = pages(spark, d)
    found = P.extracted(docs)
    results = found.filter(F.length("segment") > 20).select(F.col("segment").alias("found"), "lang", "target_lang").distinct().withColumn("result", F.concat(F.lit("["), "found", F.lit("]")))
    return P.applied(docs, found, results).select("doc_id", F.md5("translated").alias("digest"))


@query("translated_documents")
def translated_documents(spark, d):
    return P.translated(pages(spark, d), mem(spark, d), table(spark, d, "glossary"), table(spark, d, "do_not_translate"), R.stub).select("doc_id", "translated")


@query("filled_documents")
def filled_documents(spark, d):
    return P.filled(segs(spark, d).select("doc_id", "segment", "lang", "target_lang", "hash"), mem(spark, d), table(spark, d, "glossary"), table(spark, d, "do_not_translate"), R.stub, now(), LCASE)[1]


@query("retranslated")
def retranslated(spark, d):
    m = mem(spark, d)
    return P.retranslated(m, m.filter("status = 'edited'"), R.stub, now(), LCASE, table(spark, d, "glossary"), table(spark, d, "do_not_translate")).select("id", "translated_text", "status")


@query("resolved_within_budget")
def resolved_within_budget(spark, d):
    distinct = segs(spark, d).select("segment", "lang", "target_lang").distinct()
    return R.resolve(distinct, mem(spark, d), table(spark, d, "glossary"), table(spark, d, "do_not_translate"), 5)


@query("resolution_counters")
def resolution_counters(spark, d):
    distinct = segs(spark, d).select("segment", "lang", "target_lang").distinct()
    return R.counters(R.resolve(distinct, mem(spark, d), table(spark, d, "glossary"), table(spark, d, "do_not_translate")))


@query("site_documents", "SELECT doc_id, title FROM documents WHERE post_status = 'publish' AND post_type = 'post' AND doc_id NOT IN (1, 2, 3) ORDER BY doc_id")
def site_documents(spark, d):
    return C.published(table(spark, d, "documents"), excluded_types=("page",), excluded_ids=(1, 2, 3)).select("doc_id", "title").orderBy("doc_id")


@query("segments_by_hash", f"WITH {SEGS_SQL} SELECT doc_id, segment FROM seg WHERE hash IN (SELECT hash FROM seg GROUP BY hash HAVING count(DISTINCT doc_id) > 1)")
def segments_by_hash(spark, d):
    all_ = segs(spark, d)
    return C.by_hash(all_, all_.groupBy("hash").agg(F.count_distinct("doc_id").alias("n")).filter("n > 1")).select("doc_id", "segment")


@query("propagation_counts", "SELECT count(*) AS documents, count(*) FILTER (WHERE contains(coalesce(title, '') || coalesce(excerpt, '') || coalesce(text, ''), 'Lager')) AS changed FROM documents WHERE post_status IN ('publish','draft','pending','private','future')")
def propagation_counts(spark, d):
    docs = table(spark, d, "documents").filter(F.col("post_status").isin("publish", "draft", "pending", "private", "future"))
    return M.propagated(docs, "Lager", "Depot", ["title", "excerpt", "text"]).agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("changed"), 1)).alias("changed"))


# --- terms

ENTRIES = f"(SELECT trim(lang) AS lang, trim(source) AS source, min(trim(target)) AS target, {KEY.format('source')} AS key FROM glossary WHERE trim(source) <> '' AND trim(target) <> '' AND NOT starts_with(trim(source), '#') GROUP BY ALL)"


@query("glossary_cases", f"WITH e AS {ENTRIES}, t AS (SELECT DISTINCT lang, unnest([source, upper(source), concat(' ', source)]) AS text FROM e), x AS (SELECT t.lang, t.text, e.target, row_number() OVER (PARTITION BY t.lang, t.text ORDER BY CASE WHEN trim(t.text) = e.source THEN 0 ELSE 1 END, length(e.source) DESC, e.source) AS n FROM t JOIN e ON e.lang = t.lang AND e.key = {KEY.format('t.text')}) SELECT lang, text, target AS glossary_target FROM x WHERE n = 1")
def glossary_cases(spark, d):
    g = table(spark, d, "glossary")
    s = F.col("source")
    texts = G.glossary_map(g).select("lang", F.explode(F.array(s, F.upper(s), F.concat(F.lit(" "), s))).alias("text")).distinct()
    return G.translated_terms(texts, "text", "lang", g)


PHRASE = "trim(phrase) <> '' AND NOT starts_with(trim(phrase), '#')"


@query("kept_cases", f"SELECT DISTINCT t AS text FROM (SELECT unnest([phrase, upper(phrase), concat(phrase, 'x')]) AS t FROM do_not_translate WHERE phrase IS NOT NULL) WHERE {KEY.format('t')} IN (SELECT {KEY.format('phrase')} FROM do_not_translate WHERE {PHRASE})")
def kept_cases(spark, d):
    p = table(spark, d, "do_not_translate")
    x = F.col("phrase")
    return G.whole_matches(p.select(F.explode(F.array(x, F.upper(x), F.concat(x, F.lit("x")))).alias("text")).distinct(), "text", p)


@query("protected_phrases", f"WITH e AS {ENTRIES} SELECT DISTINCT lang, trim(phrase) AS phrase FROM do_not_translate, (SELECT DISTINCT lang FROM e) WHERE {PHRASE} UNION SELECT lang, source FROM e")
def protected_phrases(spark, d):
    return G.protected_phrases(table(spark, d, "do_not_translate"), table(spark, d, "glossary"))


@query("masked_terms")
def masked_terms(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.lit("en").alias("target_lang"), "text").join(G.term_patterns(table(spark, d, "do_not_translate"), table(spark, d, "glossary")), "target_lang")
    return rows.select("doc_id", T.mask(F.col("text"), F.col("term_pattern"), "BTX").alias("m"), "term_targets").select("doc_id", "m.masked", G.term_originals(F.col("m.originals"), F.col("term_targets")).alias("back_to"))


# --- queue

EVENT_TEXTS = """SELECT f.text AS text FROM (SELECT doc_id AS id, coalesce(is_update AND old IS NOT NULL, false) AS compare, unnest([{'was':old.title,'text':new.title},{'was':old.excerpt,'text':new.excerpt},{'was':old.content,'text':new.content}]) AS f
FROM change_events WHERE doc_id IN (SELECT doc_id FROM documents WHERE post_status = 'publish' AND post_type IN ('post', 'page'))) WHERE trim(f.text) <> '' AND (NOT compare OR f.was IS DISTINCT FROM f.text)
UNION SELECT t FROM (SELECT unnest([seo_title, seo_description]) AS t FROM documents WHERE post_status = 'publish' AND post_type IN ('post', 'page') AND doc_id IN (SELECT doc_id FROM change_events)) WHERE trim(t) <> ''"""
MENU = "SELECT DISTINCT text FROM content_items WHERE type = 'menu_item' AND trim(text) <> ''"


@query("changed_texts", EVENT_TEXTS)
def changed_texts(spark, d):
    return J.changed_texts(table(spark, d, "change_events"), table(spark, d, "documents"))


def _queued(spark, d):
    status = spark.createDataFrame([("done", 10, 10, 1, 5)], "state string, total long, done long, errors long, started long")
    return J.appended(table(spark, d, "queue"), J.menu_texts(table(spark, d, "content_items")), TARGETS, status)


@query("queue_after_append", f"SELECT type, id, lang, text FROM queue UNION ALL SELECT 'auto', 0, {LANGS_SQL}, text FROM ({MENU})")
def queue_after_append(spark, d):
    return _queued(spark, d)[0]


@query("queue_status", f"SELECT 'running' AS state, greatest(10 + added, 10 + added + n) AS total, 10 AS done, 1 AS errors, 5 AS started FROM (SELECT 3 * count(*) AS added FROM ({MENU})), (SELECT count(*) AS n FROM queue)")
def queue_status(spark, d):
    return _queued(spark, d)[1]


@query("queue_replaced", "SELECT 'running' AS state, 3 * count(*) AS total, 0 AS done, 0 AS errors, 0 AS started FROM (SELECT DISTINCT type, id, text FROM content_items WHERE trim(text) <> '')")
def queue_replaced(spark, d):
    return J.replaced(J.site_queue(table(spark, d, "content_items"), TARGETS), F.lit(0).cast("long"))[1]


@query("row_times", "SELECT id, epoch(updated_at)::BIGINT AS seconds, strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM bt_translations")
def row_times(spark, d):
    at = F.col("updated_at")
    return mem(spark, d).select("id", F.unix_timestamp(at.cast("timestamp")).alias("seconds"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


# --- exchange and services

ITEM = "{" + ", ".join(f"'{c}': coalesce({c}, '')" for c in X.FIELDS) + "}"


@query("export_document", f"WITH r AS (SELECT row_number() OVER (ORDER BY id) AS line, to_json({ITEM}) AS v, count(*) OVER () AS n FROM bt_translations) SELECT line, v || CASE WHEN line < n THEN ',' ELSE '' END AS value FROM r UNION ALL SELECT 0, '{{\"version\":1,\"exported_at\":\"2024-01-01T00:00:00Z\",\"source_lang\":\"de\",\"items\":[' UNION ALL SELECT count(*) + 1, ']}}' FROM r")
def export_document(spark, d):
    return X.export_document(mem(spark, d), "de", now())


@query("service_answers", "SELECT id, translated_text AS answer FROM bt_translations WHERE provider IN ('mymemory', 'deepl', 'google', 'libretranslate')")
def service_answers(spark, d):
    t = F.col("translated_text")
    body = F.when(F.col("provider") == "deepl", F.to_json(F.struct(F.array(F.struct(t.alias("text"))).alias("translations")))).when(F.col("provider") == "google", F.to_json(F.struct(F.struct(F.array(F.struct(t.alias("translatedText"))).alias("translations")).alias("data")))).when(F.col("provider") == "mymemory", F.to_json(F.struct(F.struct(t.alias("translatedText")).alias("responseData")))).otherwise(F.to_json(F.struct(t.alias("translatedText"))))
    return mem(spark, d).filter(F.col("provider").isin(*providers.PATHS)).select("id", providers.answer_text(body, F.col("provider")).alias("answer"))


# --- pages


def _url():
    return F.concat(F.lit("/"), F.coalesce(F.concat("lang", F.lit("/")), F.lit("")), "source", F.lit("/"), "doc_id", F.lit("/?p="), "doc_id")


BELOW = "source || '/' || doc_id || '/?p=' || doc_id"
PREFIX = "CASE WHEN l = 'de' THEN '/' ELSE '/' || l || '/' END"
PAGES = "(SELECT *, CASE WHEN lang IN ('en', 'fr', 'es') THEN '' ELSE coalesce(lang || '/', '') END AS own FROM documents)"


@query("alternate_languages", f"SELECT doc_id, l AS lang, {PREFIX} || own || {BELOW} AS url FROM {PAGES}, unnest(['de', 'en', 'fr', 'es']) t(l) UNION ALL SELECT doc_id, 'x-default', '/' || own || {BELOW} FROM {PAGES}")
def alternate_languages(spark, d):
    return table(spark, d, "documents").select("doc_id", F.inline(U.alternates(_url(), TARGETS, "de")))


NAMES = "CASE l " + " ".join(f"WHEN {q(x)} THEN {q(LANGUAGES[x])}" for x in ("de", *TARGETS)) + " END"


@query("language_switcher", f"SELECT doc_id, l AS lang, {NAMES} AS label, {PREFIX} || own || {BELOW} AS url, l = CASE WHEN lang IN ('en', 'fr', 'es') THEN lang WHEN source IN ('en', 'fr', 'es') THEN source ELSE 'de' END AS is_current FROM {PAGES}, unnest(['de', 'en', 'fr', 'es']) t(l)")
def language_switcher(spark, d):
    return table(spark, d, "documents").select("doc_id", F.inline(U.switcher(_url(), TARGETS, "de", LANGUAGES, F.col("source"))))


@query("translated_pages", f"SELECT doc_id FROM (SELECT *, {SLUG} AS u FROM documents) WHERE lang IN ('en', 'fr', 'es') AND source <> 'blog' AND trim(title) <> ''")
def translated_pages(spark, d):
    return table(spark, d, "documents").filter(U.is_translated(_url(), F.col("title"), TARGETS, "de", ["/blog", "# x"])).select("doc_id")
