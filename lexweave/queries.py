"""The queries over the reference's own operators, each beside its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions import urls as U
from lexweave.operators import coverage as C
from lexweave.operators import hygiene as H
from lexweave.operators import jobs as J
from lexweave.operators import memory as M
from lexweave.operators import resolve as R
from lexweave.operators import review as V
from lexweave.operators import terms as G

TARGETS = ("en", "fr", "es")
LCASE = "UTF8_LCASE"


def q(x: str) -> str:
    """A string literal of SQL."""
    return "'" + x.replace("'", "''") + "'"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def mem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bt_translations")


def segs(spark: SparkSession, d: str) -> DataFrame:
    """Segments of all document fields with the memory's target languages."""
    one = C.segments(C.fields(table(spark, d, "documents")))
    return C.with_target(one.filter("lang is not null"), F.when(F.col("lang") == "de", "en").otherwise("de"))


HASH = "sha256(concat(source_lang, chr(0), target_lang, chr(0), source_text))"
HASH_OR_NULL = f"CASE WHEN source_lang IS NOT NULL AND target_lang IS NOT NULL AND source_text IS NOT NULL THEN {HASH} END"
RANK = "CASE status WHEN 'confirmed' THEN 0 WHEN 'edited' THEN 1 ELSE 2 END"
FIELDS_SQL = """f AS (
  SELECT doc_id, lang, n AS field_no, u.field, u.text FROM (
    SELECT doc_id, lang, unnest([0,1,2,3,4]) AS n,
      unnest([{'field':'title','text':title},{'field':'excerpt','text':excerpt},{'field':'text','text':text},{'field':'seo_title','text':seo_title},{'field':'seo_description','text':seo_description}]) AS u
    FROM documents) WHERE trim(u.text) <> '')"""
SEGS_SQL = f"""{FIELDS_SQL}, l AS (
  SELECT doc_id, lang, field_no, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM f),
 s AS (SELECT doc_id, lang, trim(line) AS segment, min(field_no::BIGINT * 2147483648 + line_no) AS pos FROM l WHERE trim(line) <> '' GROUP BY ALL),
 seg AS (SELECT doc_id, lang, segment, pos, CASE WHEN lang = 'de' THEN 'en' ELSE 'de' END AS target_lang,
   sha256(concat(lang, chr(0), CASE WHEN lang = 'de' THEN 'en' ELSE 'de' END, chr(0), segment)) AS hash FROM s WHERE lang IS NOT NULL),
 best AS (SELECT hash, id, translated_text, status FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY {RANK}, id DESC) AS n FROM bt_translations WHERE hash IS NOT NULL) WHERE n = 1),
 found AS (SELECT seg.*, id, translated_text, coalesce(status, 'missing') AS status FROM seg LEFT JOIN best USING (hash))"""
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TRIM = r"regexp_replace({}, '^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$', '', 'g')"
UNIFY = "translate(replace({}, '…', '...'), chr(160) || chr(173), ' ')"


def entities(x: str) -> str:
    for a, b in T.ENTITIES.items():
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def canonical_sql(x: str) -> str:
    return UNIFY.format(TRIM.format(f"regexp_replace({entities(x)}, {q(T.WS + '+')}, ' ', 'g')"))


def count_sql(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def opaque_sql(x: str) -> str:
    t = TRIM.format(x)
    return f"(length({t}) >= 16 AND regexp_matches({t}, '^[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+$') AND {count_sql(t, '[0-9a-fA-F]')} / length({t}) >= 0.55)"


def code_sql(x: str) -> str:
    t = TRIM.format(x)
    signs = count_sql(t, r"[{}();=\[\]<>$|\\/`]")
    openings = (rf"^(?:\$|#|>|PS(?:{T.WS}+C:)?|C:\\){T.WS}+{T.NOT_WS}", rf"(?i)^(?:{T.TOOLS}){T.WS}+{T.NOT_WS}", rf"^[A-Za-z]:\\{T.NOT_WS}+")
    opening = " OR ".join(f"regexp_matches({t}, {q(p)})" for p in openings)
    dense = f"(length({t}) >= 8 AND {signs} >= 4 AND regexp_matches({t}, '\\p{{L}}') AND {signs} / length({t}) >= 0.12)"
    return f"({opening} OR {dense} OR ({count_sql(t, ';')} >= 2 AND regexp_matches({t}, '[{{}}=()]')) OR {opaque_sql(x)})"


def link_sql(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({TRIM.format(x)}, {q(p)})" for p in T.LINK_SEGMENT) + ")"


def shortcode_sql(x: str) -> str:
    return f"regexp_matches({TRIM.format(x)}, {q(f'^{T.SHORTCODE}{T.WS}*$')})"


def technical_sql(x: str) -> str:
    t = TRIM.format(x)
    parts = f"list_filter(regexp_split_to_array({t}, {q(rf'[,/_.:{T.WS_IN}-]+')}), lambda p: p <> '')"
    shape = f"(length({t}) BETWEEN 2 AND 40 AND regexp_matches({t}, {q(rf'^[A-Za-z0-9](?:[A-Za-z0-9,/_.:{T.WS_IN}-]*[A-Za-z0-9])?$')}) AND regexp_matches({t}, '[A-Za-z]') AND regexp_matches({t}, '[0-9]'))"
    plain = f"len(list_filter({parts}, lambda p: regexp_matches(p, '^[A-Za-z]{{4,}}$') OR (regexp_matches(p, '^[A-Za-z]{{3}}$') AND NOT regexp_matches(p, '^[A-Z]{{3}}$')))) = 0"
    single = f"(length({t}) <= 12 AND regexp_matches({t}, '^(?:[A-Za-z]{{1,4}}[0-9][A-Za-z0-9]*|[0-9]+[A-Za-z]{{1,4}})$'))"
    return f"({opaque_sql(x)} OR ({shape} AND {plain} AND CASE WHEN regexp_matches({t}, {q(rf'[,/_.:{T.WS_IN}-]')}) THEN len({parts}) >= 2 ELSE {single} END))"


def hits_sql(x: str, words: list[str]) -> str:
    return f"len(list_filter(regexp_extract_all(lower({x}), {q(T.TOKEN)}), lambda w: w IN ({', '.join(map(q, words))})))"


def english_sql(x: str) -> str:
    errors = f"regexp_matches(lower({x}), {q(T.ERROR_PHRASE)})"
    return f"(NOT regexp_matches({x}, {q(T.UMLAUT)}) AND ({errors} OR (length({x}) >= 12 AND {hits_sql(x, T.ENGLISH)} >= CASE WHEN length({x}) < 48 THEN 2 ELSE 4 END)))"


def german_sql(x: str) -> str:
    return f"(regexp_matches({x}, {q(T.UMLAUT)}) OR (length({x}) >= 24 AND {hits_sql(x, T.GERMAN)} >= 4))"


def in_target_sql(x: str) -> str:
    like = lambda lang: f"CASE lower({lang}) WHEN 'en' THEN {english_sql(x)} WHEN 'de' THEN {german_sql(x)} ELSE false END"
    return f"coalesce(source_lang <> target_lang AND {like('target_lang')} AND NOT {like('source_lang')}, false)"


def passthrough_sql() -> str:
    return f"coalesce(status = 'auto' AND source_lang <> target_lang AND (source_text = translated_text OR {in_target_sql('source_text')} OR {technical_sql('source_text')}), false)"


def junk_sql() -> str:
    errors = " OR ".join(f"contains(upper(translated_text), {q(m)})" for m in T.PURGE_MARKERS)
    trivial = f"({link_sql('source_text')} OR regexp_matches(source_text, {q(T.NUMBER_UNIT)}) OR (length(source_text) <= 5 AND regexp_matches(source_text, {q(T.CAPITALS)})))"
    return f"CASE WHEN status = 'auto' AND ({errors}) THEN 'provider_error' WHEN status = 'auto' AND {trivial} THEN 'trivial' WHEN {code_sql('source_text')} OR {shortcode_sql('source_text')} THEN 'code' END"


def corrected_sql(x: str) -> str:
    """The correction rules but the capitals, over a text that is trimmed and has one ellipsis."""
    for p, r in ((r"\x{00AD}[\r\n]+", ""), (r"(\p{L})-[\r\n]+(\p{Ll})", r"\1\2"), (r"(\p{L})[\r\n]+(\p{Ll})", r"\1\2"), (r"[ \t\f\x0B\p{Zs}]*[\r\n]+[ \t\f\x0B\p{Zs}]*", " "), (" {2,}", " "), (T.SPACE_BEFORE, r"\1")):
        x = f"regexp_replace({x}, {q(p)}, {q(r)}, 'g')"
    return x


def capitals_sql(x: str) -> str:
    first = r"regexp_extract(p, '(?s)^(\P{L}*)', 1) || upper(regexp_extract(p, '(?s)^\P{L}*(\p{Ll})', 1)) || regexp_replace(p, '(?s)^\P{L}*\p{Ll}?', '')"
    later = r"upper(regexp_extract(p, '^(\p{Ll})', 1)) || regexp_replace(p, '^\p{Ll}', '')"
    pieces = f"regexp_extract_all({x}, {q(rf'(?s).*?[.!?…]{T.WS}+|.+$')})"
    return f"CASE WHEN regexp_matches({x}, {q(f'{T.WS}|[.!?…]')}) THEN array_to_string(list_transform({pieces}, lambda p, i: CASE WHEN i = 1 THEN {first} ELSE {later} END), '') ELSE {x} END"


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = (f, sql)
        return f

    return add


# --- identity, lookup, export, import


@query("segment_hash", f"SELECT id, {HASH_OR_NULL} AS computed, coalesce({HASH_OR_NULL} = hash, false) AS fresh FROM bt_translations")
def segment_hash(spark, d):
    m = M.with_hash(mem(spark, d), "computed")
    return m.select("id", "computed", F.coalesce(F.col("computed") == F.col("hash"), F.lit(False)).alias("fresh"))


@query("lookup_queue", f"SELECT DISTINCT q.lang, q.text, b.id, b.status FROM (SELECT DISTINCT lang, text FROM queue WHERE trim(text) <> '' AND lang IS NOT NULL) q JOIN (SELECT hash, id, status FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY {RANK}, id DESC) AS n FROM bt_translations WHERE hash IS NOT NULL) WHERE n = 1) b ON b.hash = sha256(concat('de', chr(0), lower(q.lang), chr(0), q.text))")
def lookup_queue(spark, d):
    keys = table(spark, d, "queue").filter("trim(text) <> '' and lang is not null").select("lang", "text").distinct()
    keys = keys.withColumn("hash", T.segment_hash(F.lit("de"), F.lower("lang"), F.col("text")))
    return keys.join(M.best_by_hash(mem(spark, d)), "hash").select("lang", "text", "id", "status")


@query("by_hashes", "SELECT id, hash FROM bt_translations WHERE hash IN (SELECT hash FROM bt_translations WHERE status = 'edited' AND hash <> '')")
def by_hashes(spark, d):
    return M.by_hashes(mem(spark, d), mem(spark, d).filter("status = 'edited'").select("hash")).select("id", "hash")


@query("export_items", "SELECT id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in ("hash", "source_lang", "target_lang", "source_text", "translated_text", "status", "provider")) + " FROM bt_translations")
def export_items(spark, d):
    return M.export_items(mem(spark, d))


IMPORTS = "SELECT source_lang, target_lang, source_text, translated_text, CASE WHEN status IN ('auto','edited','confirmed') THEN status ELSE 'auto' END AS status, CASE WHEN coalesce(provider, '') = '' THEN 'import' ELSE provider END AS provider FROM bt_translations WHERE coalesce(source_lang, '') <> '' AND coalesce(target_lang, '') <> '' AND coalesce(source_text, '') <> '' AND coalesce(translated_text, '') <> ''"


@query("import_rows", f"SELECT *, true AS force FROM ({IMPORTS}) i WHERE {HASH} NOT IN (SELECT hash FROM bt_translations WHERE status = 'confirmed' AND hash IS NOT NULL)")
def import_rows(spark, d):
    return M.importable(mem(spark, d), mem(spark, d))


@query("upsert_glossary", None)
def upsert_glossary(spark, d):
    g = G.glossary_map(table(spark, d, "glossary"))
    changes = g.select(F.lit("de").alias("source_lang"), F.col("lang").alias("target_lang"), F.col("source").alias("source_text"), F.col("target").alias("translated_text"), F.lit("auto").alias("status"), F.lit("glossary").alias("provider"), F.lit(False).alias("force"))
    return M.upsert(mem(spark, d), changes, F.lit("2024-01-01").cast("timestamp_ntz"))


@query("confirm_edited", "SELECT id, CASE WHEN status = 'edited' THEN 'confirmed' ELSE status END AS status, CASE WHEN status = 'edited' THEN NULL ELSE previous_source_text END AS previous_source_text FROM bt_translations")
def confirm_edited(spark, d):
    return M.confirmed(mem(spark, d), mem(spark, d).filter("status = 'edited'")).select("id", "status", "previous_source_text")


@query("delete_blank", "SELECT id FROM bt_translations WHERE id NOT IN (SELECT id FROM bt_translations WHERE trim(translated_text) = '')")
def delete_blank(spark, d):
    return M.without(mem(spark, d), mem(spark, d).filter("trim(translated_text) = ''")).select("id")


@query("correct_sources", f"WITH w AS (SELECT *, regexp_replace(source_text, ' +', ' ', 'g') AS new_source FROM bt_translations), c AS (SELECT id, new_source, source_text, sha256(concat(source_lang, chr(0), target_lang, chr(0), new_source)) AS new_hash FROM w WHERE new_source <> source_text AND trim(new_source) <> '' AND source_lang IS NOT NULL AND target_lang IS NOT NULL), fr AS (SELECT new_hash, min(id) AS id FROM c GROUP BY 1 HAVING new_hash NOT IN (SELECT hash FROM bt_translations WHERE hash IS NOT NULL)) SELECT b.id, coalesce(c.new_hash, b.hash) AS hash, coalesce(c.new_source, b.source_text) AS source_text, CASE WHEN c.id IS NOT NULL THEN b.source_text ELSE b.previous_source_text END AS previous_source_text FROM bt_translations b LEFT JOIN (c JOIN fr USING (id, new_hash)) c ON c.id = b.id")
def correct_sources(spark, d):
    m = mem(spark, d)
    changes = m.filter("source_lang is not null and target_lang is not null").select("id", F.regexp_replace("source_text", " +", " ").alias("new_source"))
    return M.corrected(m, changes).select("id", "hash", "source_text", "previous_source_text")


@query("propagate_correction", "SELECT doc_id, replace(title, 'Lager', 'Depot') AS title, replace(excerpt, 'Lager', 'Depot') AS excerpt, replace(text, 'Lager', 'Depot') AS text, contains(coalesce(title, '') || coalesce(excerpt, '') || coalesce(text, ''), 'Lager') AS changed FROM documents WHERE post_status IN ('publish','draft','pending','private','future')")
def propagate_correction(spark, d):
    docs = table(spark, d, "documents").filter(F.col("post_status").isin("publish", "draft", "pending", "private", "future"))
    return M.propagated(docs.select("doc_id", "title", "excerpt", "text"), "Lager", "Depot", ["title", "excerpt", "text"])


# --- duplicates and hygiene


@query("duplicate_groups", "SELECT source_lang, target_lang, count(*) AS rows, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM bt_translations GROUP BY source_lang, target_lang, lower(source_text) HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return M.duplicate_groups(mem(spark, d), LCASE)


DEDUPED = f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY source_lang, target_lang, lower(source_text) ORDER BY {RANK}, CASE WHEN provider = 'passthrough' THEN 1 ELSE 0 END, id DESC) AS n FROM bt_translations) WHERE n = 1"


@query("dedupe_winners", f"SELECT id FROM ({DEDUPED})")
def dedupe_winners(spark, d):
    return M.deduplicated(mem(spark, d), LCASE).select("id")


@query("dedupe_by_collation", None)
def dedupe_by_collation(spark, d):
    return M.deduplicated(mem(spark, d)).select("id")


@query("siblings", "WITH o AS (SELECT source_lang, target_lang, lower(source_text) AS k, max(id) AS sibling_id FROM bt_translations GROUP BY ALL) SELECT b.id, o.sibling_id, o.target_lang AS sibling_lang FROM bt_translations b JOIN o ON o.source_lang = b.source_lang AND o.k = lower(b.source_text) AND o.target_lang <> b.target_lang")
def siblings(spark, d):
    return M.siblings(mem(spark, d), LCASE)


@query("purge_counts", f"SELECT kind, count(*) AS rows FROM (SELECT {junk_sql()} AS kind FROM bt_translations) WHERE kind IS NOT NULL GROUP BY kind")
def purge_counts(spark, d):
    return H.purge_counts(mem(spark, d))


@query("passthrough_rows", f"SELECT id, translated_text, status, provider FROM (SELECT id, CASE WHEN hit THEN source_text ELSE translated_text END AS translated_text, CASE WHEN hit THEN 'confirmed' ELSE status END AS status, CASE WHEN hit AND ({technical_sql('source_text')} OR coalesce(provider, '') = '') THEN 'passthrough' ELSE provider END AS provider FROM (SELECT *, {passthrough_sql()} AS hit FROM bt_translations))")
def passthrough_rows(spark, d):
    return H.passthrough_confirmed(mem(spark, d)).select("id", "translated_text", "status", "provider")


@query("cleaned_memory", f"SELECT id, CASE WHEN hit THEN 'confirmed' ELSE status END AS status FROM (SELECT *, {passthrough_sql()} AS hit FROM ({DEDUPED}) WHERE ({junk_sql()}) IS NULL)")
def cleaned_memory(spark, d):
    return H.cleaned(mem(spark, d), LCASE).select("id", "status")


@query("healed_memory", None)
def healed_memory(spark, d):
    return H.healed(mem(spark, d)).select("id", "translated_text", "status", "provider")


SCORE = f"CASE status WHEN 'confirmed' THEN 400 WHEN 'edited' THEN 300 WHEN 'auto' THEN 200 WHEN 'missing' THEN 0 ELSE 100 END + CASE WHEN translated_text <> '' AND translated_text <> source_text THEN 50 ELSE 0 END + CASE WHEN source_text = {canonical_sql('source_text')} THEN 10 ELSE 0 END"


@query("review_rows", f"SELECT id, status FROM (SELECT id, status, row_number() OVER (PARTITION BY source_lang, target_lang, k, CASE WHEN k = '' THEN id END ORDER BY score DESC, id DESC) AS n FROM (SELECT *, {SCORE} AS score, {canonical_sql('source_text')} AS k FROM bt_translations)) WHERE n = 1 OR status NOT IN ('auto', 'missing')")
def review_rows(spark, d):
    return H.review_rows(mem(spark, d)).select("id", "status")


# --- review


@query("memory_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'auto') AS auto, count(*) FILTER (WHERE status = 'edited') AS edited, count(*) FILTER (WHERE status = 'confirmed') AS confirmed FROM bt_translations")
def memory_stats(spark, d):
    return V.stats(mem(spark, d))


@query("pending_by_lang", "SELECT target_lang, count(*) AS pending FROM bt_translations WHERE status IN ('auto', 'edited') GROUP BY target_lang")
def pending_by_lang(spark, d):
    return mem(spark, d).filter(V.in_status(F.col("status"), "pending")).groupBy("target_lang").agg(F.count(F.lit(1)).alias("pending"))


LISTED = "FROM bt_translations WHERE status IN ('auto', 'edited') AND target_lang = 'en' AND (contains(lower(source_text), 'netzteil') OR contains(lower(translated_text), 'netzteil'))"


@query("review_page", f"SELECT id, status, source_text {LISTED} ORDER BY length(source_text) DESC, id DESC LIMIT 20 OFFSET 20")
def review_page(spark, d):
    return V.page(V.listed(mem(spark, d), "pending", "en", "netzteil", LCASE), "longest", 2).select("id", "status", "source_text")


@query("review_totals", f"SELECT count(*) AS total, ceil(count(*) / 20)::BIGINT AS pages {LISTED}")
def review_totals(spark, d):
    return V.totals(V.listed(mem(spark, d), "pending", "en", "netzteil", LCASE))


@query("review_neighbours", "SELECT id, CASE WHEN n > 1 THEN coalesce(lag(id) OVER w, last_value(id) OVER a) END AS prev_id, CASE WHEN n > 1 THEN coalesce(lead(id) OVER w, first_value(id) OVER a) END AS next_id FROM (SELECT DISTINCT id, count(*) OVER () AS n FROM bt_translations WHERE status IN ('auto', 'edited')) WINDOW w AS (ORDER BY id), a AS (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def review_neighbours(spark, d):
    return V.neighbours(mem(spark, d))


@query("next_pending", "SELECT coalesce(min(id) FILTER (WHERE id > 100), min(id)) AS next_id FROM bt_translations WHERE status IN ('auto', 'edited')")
def next_pending(spark, d):
    return V.next_after(mem(spark, d), 100)


@query("source_diff", None)
def source_diff(spark, d):
    return mem(spark, d).filter("previous_source_text is not null").select("id", F.inline(V.diff("previous_source_text", "source_text")))


# --- text


@query("canonical_sources", f"SELECT id, {canonical_sql('source_text')} AS canonical FROM bt_translations")
def canonical_sources(spark, d):
    return mem(spark, d).select("id", T.canonical_source(F.col("source_text")).alias("canonical"))


NORMAL = corrected_sql(UNIFY.format(TRIM.format(r"regexp_replace(" + entities("source_text") + r", '[\t\f]+', ' ', 'g')")))


@query("normalized_sources", f"SELECT id, {capitals_sql('c')} AS normal FROM (SELECT id, {NORMAL} AS c FROM bt_translations)")
def normalized_sources(spark, d):
    return mem(spark, d).select("id", T.normalize(F.col("source_text")).alias("normal"))


def _class_sql(x: str) -> str:
    blank = q(rf"^[\d{T.WS_IN}.,:;+()/%€$-]+$")
    no = f"{link_sql(x)} OR {shortcode_sql(x)} OR {code_sql(x)} OR regexp_matches({x}, {q(T.NUMBER_UNIT)}) OR (length({x}) <= 5 AND regexp_matches({x}, {q(T.CAPITALS)})) OR regexp_matches({x}, {blank})"
    return f"{link_sql(x)} AS link, {shortcode_sql(x)} AS shortcode, {code_sql(x)} AS code, {opaque_sql(x)} AS opaque, {technical_sql(x)} AS technical, {english_sql(x)} AS english, {german_sql(x)} AS german, (length({x}) >= 2 AND regexp_matches({x}, '\\p{{L}}') AND NOT ({no})) AS translatable"


@query("segment_classes", f"WITH {SEGS_SQL} SELECT segment, {_class_sql('segment')} FROM (SELECT DISTINCT segment FROM seg)")
def segment_classes(spark, d):
    s = F.col("segment")
    return segs(spark, d).select("segment").distinct().select("segment", T.is_link(s).alias("link"), T.is_shortcode(s).alias("shortcode"), T.is_code(s).alias("code"), T.is_opaque_id(s).alias("opaque"), T.is_technical(s).alias("technical"), T.looks_english(s).alias("english"), T.looks_german(s).alias("german"), T.is_translatable(s).alias("translatable"))


@query("already_translated", f"SELECT id FROM bt_translations WHERE {in_target_sql('source_text')}")
def already_translated(spark, d):
    return mem(spark, d).filter(T.already_in_target(F.col("source_text"), F.col("source_lang"), F.col("target_lang"))).select("id")


AFFIX = f"regexp_extract(t, {q(f'^({T.EDGE})')}, 1)"


@query("affixes", f"SELECT id, prefix, substr(rest, 1, length(rest) - length(suffix)) AS core, suffix FROM (SELECT *, regexp_extract(rest, {q(f'({T.EDGE})$')}, 1) AS suffix FROM (SELECT id, {AFFIX} AS prefix, substr(t, length({AFFIX}) + 1) AS rest FROM (SELECT id, {TRIM.format('source_text')} AS t FROM bt_translations)))")
def affixes(spark, d):
    return mem(spark, d).select("id", T.affix(F.col("source_text")).alias("a")).select("id", "a.*")


@query("guarded_tokens", None)
def guarded_tokens(spark, d):
    s = F.col("source_text")
    rows = mem(spark, d).select("id", s, T.mask(s, T.LINK, "BTL").alias("l"), T.numbers(s).alias("numbers"))
    rows = rows.withColumn("n", T.mask_numbers(F.col("l.masked")))
    return rows.select("id", F.col("n.masked").alias("masked"), "numbers", (T.unmask(T.unmask(F.col("n.masked"), F.col("n.originals"), "BTN"), F.col("l.originals"), "BTL") == T.scrub(s)).alias("round_trip"))


@query("polished", None)
def polished(spark, d):
    return mem(spark, d).select("id", T.polish(F.col("source_text"), F.col("translated_text")).alias("polished"))


@query("output_cleanup", "SELECT id, " + TRIM.format("regexp_replace(regexp_replace(regexp_replace(translated_text, ' {2,}', ' ', 'g'), " + q(T.SPACE_BEFORE) + r", '\1', 'g'), " + q(rf"(\d+(?:[.,]\d+)?{T.WS}*(?:{T.UNITS}))(\p{{Ll}}{{3,}})") + r", '\1 \2', 'g')") + " AS cleaned FROM bt_translations")
def output_cleanup(spark, d):
    return mem(spark, d).select("id", T.clean_output(F.col("translated_text")).alias("cleaned"))


@query("request_chunks", None)
def request_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk", "text"))


# --- documents, coverage, resolution


@query("document_fields", f"WITH {FIELDS_SQL} SELECT doc_id, field, length(text) AS chars FROM f")
def document_fields(spark, d):
    return C.fields(table(spark, d, "documents")).select("doc_id", "field", F.length("text").cast("long").alias("chars"))


@query("segments", f"WITH {SEGS_SQL} SELECT doc_id, segment, pos, hash FROM seg")
def segments(spark, d):
    return segs(spark, d).select("doc_id", "segment", "pos", "hash")


@query("coverage", f"""WITH {SEGS_SQL}, c AS (SELECT doc_id, count(*) AS segments, count(*) FILTER (WHERE status <> 'missing') AS cached, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) FILTER (WHERE status IN ('missing', 'auto', 'edited')) AS pending FROM found GROUP BY doc_id)
SELECT *, round(100 * cached / segments)::INT AS cached_pct, round(100 * confirmed / segments)::INT AS confirmed_pct, CASE WHEN cached = 0 THEN 'none' WHEN cached < segments THEN 'partial' WHEN confirmed = segments THEN 'fully_confirmed' ELSE 'needs_review' END AS bucket FROM c""")
def coverage(spark, d):
    return C.coverage(C.resolved(segs(spark, d), mem(spark, d)))


@query("missing_segments", f"WITH {SEGS_SQL} SELECT doc_id, segment FROM seg WHERE hash NOT IN (SELECT hash FROM bt_translations WHERE hash IS NOT NULL)")
def missing_segments(spark, d):
    return C.missing(segs(spark, d), mem(spark, d)).select("doc_id", "segment")


@query("segment_details", f"WITH {SEGS_SQL} SELECT doc_id, pos, status, id, translated_text FROM found WHERE status IN ('auto', 'edited', 'missing')")
def segment_details(spark, d):
    return C.needs_work(C.resolved(segs(spark, d), mem(spark, d))).select("doc_id", "pos", "status", "id", "translated_text")


@query("resolved_segments", None)
def resolved_segments(spark, d):
    distinct = segs(spark, d).select("segment", "lang", "target_lang").distinct()
    return R.resolve(distinct, mem(spark, d), table(spark, d, "glossary"), table(spark, d, "do_not_translate"))


@query("fetched_titles", None)
def fetched_titles(spark, d):
    rows = table(spark, d, "content_items").filter("type = 'post_title' and trim(text) <> ''").select(F.col("text").alias("segment"), F.lit("de").alias("lang"), F.lit("en").alias("target_lang")).distinct()
    return R.fetched(rows, R.stub, table(spark, d, "glossary"), table(spark, d, "do_not_translate"))


# --- terms

KEY = ASCII_LOWER.format("trim({})")
GLOSSARY = f"SELECT trim(lang) AS lang, {KEY.format('source')} AS key, trim(source) AS source, min(trim(target)) AS target FROM glossary WHERE trim(source) <> '' AND trim(target) <> '' AND NOT starts_with(trim(source), '#') GROUP BY ALL"
PHRASES = f"SELECT DISTINCT {KEY.format('phrase')} AS key FROM do_not_translate WHERE trim(phrase) <> '' AND NOT starts_with(trim(phrase), '#')"


@query("glossary_entries", GLOSSARY)
def glossary_entries(spark, d):
    return G.glossary_map(table(spark, d, "glossary"))


@query("glossary_lookup", f"SELECT q.type, q.id, q.text, g.target AS glossary_target FROM queue q JOIN (SELECT * FROM ({GLOSSARY}) QUALIFY row_number() OVER (PARTITION BY lang, key ORDER BY length(source) DESC, source) = 1) g ON g.lang = lower(q.lang) AND g.key = {KEY.format('q.text')}")
def glossary_lookup(spark, d):
    return G.translated_terms(table(spark, d, "queue"), "text", "lang", table(spark, d, "glossary")).select("type", "id", "text", "glossary_target")


@query("kept_items", f"SELECT type, id, text FROM content_items WHERE {KEY.format('text')} IN ({PHRASES})")
def kept_items(spark, d):
    return G.whole_matches(table(spark, d, "content_items"), "text", table(spark, d, "do_not_translate"))


TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+')"


@query("phrases_in_documents", f"WITH k AS (SELECT DISTINCT array_to_string({TOKENS.format('key')}, ' ') AS key FROM ({PHRASES})), t AS (SELECT doc_id AS id, {TOKENS.format(ASCII_LOWER.format('trim(text)'))} AS t FROM documents), r AS (SELECT id, array_to_string(t[i:i + n - 1], ' ') AS key FROM t, unnest(range(1, len(t) + 1)) u(i), unnest([1, 2, 3, 4, 5, 6]) v(n) WHERE i + n - 1 <= len(t)) SELECT id, key, count(*) AS times FROM r WHERE key IN (SELECT key FROM k WHERE key <> '') GROUP BY id, key")
def phrases_in_documents(spark, d):
    return G.contained(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "do_not_translate"))


# --- queue

LANGS_SQL = "unnest(['en', 'fr', 'es'])"


@query("site_queue", f"SELECT type, id, {LANGS_SQL} AS lang, text FROM (SELECT DISTINCT type, id, text FROM content_items WHERE trim(text) <> '')")
def site_queue(spark, d):
    return J.site_queue(table(spark, d, "content_items"), TARGETS)


BATCHED = "SELECT *, row_number() OVER (ORDER BY coalesce(type, ''), coalesce(id, 0), coalesce(lang, ''), coalesce(text, '')) AS seq FROM queue"


@query("queue_progress", f"SELECT (seq - 1) // 15 AS batch, count(*) AS items, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS blank, max(seq) AS done FROM ({BATCHED}) GROUP BY 1")
def queue_progress(spark, d):
    return J.progress(J.batches(table(spark, d, "queue")))


@query("changed_fields", f"""WITH e AS (SELECT doc_id AS id, coalesce(is_update AND old IS NOT NULL, false) AS compare, unnest([{{'type':'post_title','was':old.title,'text':new.title}},{{'type':'post_excerpt','was':old.excerpt,'text':new.excerpt}},{{'type':'post_content','was':old.content,'text':new.content}}]) AS f
FROM change_events WHERE doc_id IN (SELECT doc_id FROM documents WHERE post_status = 'publish' AND post_type IN ('post', 'page')))
SELECT type, id, {LANGS_SQL} AS lang, text FROM (SELECT DISTINCT f.type AS type, id, f.text AS text FROM e WHERE trim(f.text) <> '' AND (NOT compare OR f.was IS DISTINCT FROM f.text))""")
def changed_fields(spark, d):
    return J.changed_fields(table(spark, d, "change_events"), table(spark, d, "documents"), TARGETS)


# --- URLs

SLUG = "'/' || coalesce(lang || '/', '') || source || '/' || doc_id || '/?p=' || doc_id"


@query("page_languages", f"SELECT doc_id, CASE WHEN split_part(u, '/', 2) IN ('en', 'fr', 'es') THEN split_part(u, '/', 2) ELSE 'de' END AS language, regexp_replace(u, '^/(?:en|fr|es)(?:/|$)', '/') AS stripped FROM (SELECT doc_id, {SLUG} AS u FROM documents)")
def page_languages(spark, d):
    u = F.concat(F.lit("/"), F.coalesce(F.concat("lang", F.lit("/")), F.lit("")), "source", F.lit("/"), "doc_id", F.lit("/?p="), "doc_id")
    return table(spark, d, "documents").select("doc_id", U.language_of(u, TARGETS, "de").alias("language"), U.without_language(u, TARGETS).alias("stripped"))


@query("alternate_urls", "SELECT doc_id, l AS lang, CASE WHEN l = 'de' THEN '' ELSE '/' || l END || '/' || source || '/' || doc_id || '/' AS url FROM documents, unnest(['de', 'en', 'fr', 'es']) t(l)")
def alternate_urls(spark, d):
    u = F.concat(F.lit("/"), F.coalesce(F.concat("lang", F.lit("/")), F.lit("")), "source", F.lit("/"), "doc_id")
    targets = ("de", *TARGETS)
    rows = table(spark, d, "documents").select("doc_id", u.alias("u"), F.explode(F.array(*[F.lit(x) for x in targets])).alias("lang"))
    return rows.select("doc_id", "lang", U.url_for(F.col("u"), F.col("lang"), targets, "de").alias("url"))


@query("recent_documents", "SELECT doc_id, title, modified FROM documents WHERE contains(lower(title), 'neu') ORDER BY modified DESC, doc_id DESC LIMIT 200")
def recent_documents(spark, d):
    docs = table(spark, d, "documents").filter(F.contains(F.lower("title"), F.lit("neu")))
    return docs.orderBy(F.desc("modified"), F.desc("doc_id")).limit(200).select("doc_id", "title", "modified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}


from lexweave import pipeline_queries  # noqa: E402, F401  (adds its queries to QUERIES)
