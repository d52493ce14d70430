"""The queries of this package over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import breaks, copies, forms, language, leaks, neardup, packing, pairs, quality, residue, variants
from lexweave.llm.common import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breaks.cut_texts(table(spark, sf_dir, "bt_translations")).select("id").distinct()


def p1_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breaks.cut_share(table(spark, sf_dir, "bt_translations"))


def p1_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "bt_translations")
    return breaks.length_spikes(df, df.provider, df.translated_text)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "bt_translations"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_links(table(spark, sf_dir, "bt_translations"))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_members(table(spark, sf_dir, "bt_translations"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_defects(table(spark, sf_dir, "bt_translations"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_rows(table(spark, sf_dir, "bt_translations"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_pairs(table(spark, sf_dir, "bt_translations"), ["source_text", "translated_text"])


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.canonical_rows(table(spark, sf_dir, "bt_translations"), ["source_text", "translated_text"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.later_copies(table(spark, sf_dir, "bt_translations"))


def p6_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_classes(table(spark, sf_dir, "bt_translations")).select("first_id", "copies")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_issues(table(spark, sf_dir, "bt_translations")).select("id", "field", "issue", "lang").distinct()


def p7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "bt_translations"))


def p8_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.requests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "provider_limits"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p8_requests(spark, sf_dir), table(spark, sf_dir, "provider_limits"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.filter(found.exact_run >= leaks.SPAN).select("doc_id", "item_id")


def p9_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps that the masks tell, single substituted words and all, found by the join of masked windows."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most_sent=0)


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_kinds(table(spark, sf_dir, "documents")).select("doc_id", "kind", *quality.STATISTICS)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = quality.document_kinds(table(spark, sf_dir, "documents"))
    return kinds.filter(kinds.kind != "prose").select("doc_id", "kind").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_share": p1_share, "p1_spikes": p1_spikes, "p2_found": p2_found, "p2_links": p2_links, "p2_members": p2_members, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_canonical": p5_canonical, "p6_found": p6_found, "p6_copies": p6_copies, "p7_found": p7_found, "p7_languages": p7_languages, "p8_requests": p8_requests, "p8_fill": p8_fill, "p9_found": p9_found, "p9_overlaps": p9_overlaps, "p10_found": p10_found, "p10_stats": p10_stats}


def sql_form(text: str) -> str:
    """The plain form of a text in SQL."""
    matching, plain = forms.fold_table()
    for a, b in forms.LIGATURES.items():
        text = f"replace({text}, {literal(a)}, {literal(b)})"
    return f"nfc_normalize(translate({text}, {literal(matching)}, {literal(plain)}))"


def literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_words(text: str) -> str:
    return f"regexp_extract_all(lower({sql_form(text)}), {literal(forms.WORD)})"


def sql_canonical(text: str) -> str:
    """Words in their order or sorted fields in SQL, over a column of plain forms in lower case."""
    # Commas and slashes between digits are set aside, twice since neighbours share a digit.
    inside = f"regexp_replace({text}, '([0-9])[,/]([0-9])', '\\1' || chr(1) || '\\2', 'g')"
    inside = f"regexp_replace({inside}, '([0-9])[,/]([0-9])', '\\1' || chr(1) || '\\2', 'g')"
    pieces = f"list_filter(regexp_split_to_array({inside}, '[;|·•\n\r,/]'), lambda p: regexp_matches(p, {literal(forms.WORD)}))"
    shape = r"^[^\p{L}\p{N}:=]*(?:[\p{L}\p{N}'’-]+[^\p{L}\p{N}:=]*){1,4}[:=][^:=]*[\p{L}\p{N}][^:=]*$"
    bad = f"list_filter({pieces}, lambda p: NOT regexp_matches(p, {literal(shape)}) OR regexp_matches(regexp_replace(p, '^[^:=]*[:=]', ''), '[.!?…][\t\n\r\f ]+\\p{{L}}'))"
    tokens = f"list_transform({pieces}, lambda p: translate(array_to_string(regexp_extract_all(p, {literal(forms.WORD + '|[:=]')}), ' '), '=', ':'))"
    fields = f"len({pieces}) >= 2 AND len({bad}) = 0"
    return f"CASE WHEN {fields} THEN chr(2) || array_to_string(list_sort({tokens}), chr(2)) ELSE array_to_string(regexp_extract_all({text}, {literal(forms.WORD)}), ' ') END"


def oracle_sql() -> dict[str, str]:
    pair = "coalesce(source_lang, chr(1)) AS a, coalesce(target_lang, chr(1)) AS b"
    one = lambda f: f"SELECT id, {pair}, '{f}' AS field, {f} AS text, {sql_form(f)} AS form FROM bt_translations WHERE {f} IS NOT NULL"
    forms_ = f"WITH f AS ({one('source_text')} UNION ALL {one('translated_text')})"
    p5 = f"{forms_} SELECT DISTINCT x.id AS id_a, y.id AS id_b, x.field FROM f x JOIN f y ON x.a = y.a AND x.b = y.b AND x.field = y.field AND x.form = y.form AND x.text <> y.text AND x.id < y.id WHERE regexp_matches(x.form, {literal(variants.SEEN)})"
    p5_canonical = f"{forms_}, c AS (SELECT a, b, field, form FROM f GROUP BY ALL HAVING count(DISTINCT text) > 1) SELECT DISTINCT id, field, form AS canonical FROM f JOIN c USING (a, b, field, form)"
    runs = lambda table, key: f"SELECT DISTINCT {key}, array_to_string(w[i:i + 7], ' ') AS run FROM (SELECT {key}, {sql_words('text')} AS w FROM {table}), unnest(range(1, len(w) + 1)) u(i) WHERE i + 7 <= len(w)"
    p9 = f"SELECT DISTINCT doc_id, item_id FROM ({runs('documents', 'doc_id')}) d JOIN ({runs('benchmark', 'item_id')}) b USING (run)"
    plain = f"SELECT id, {pair}, lower({sql_form('source_text')}) AS t, source_text, previous_source_text FROM bt_translations"
    records = f"c AS (SELECT *, {sql_canonical('t')} AS canon FROM ({plain}))"
    p6 = f"WITH {records}, f AS (SELECT *, min(id) OVER (PARTITION BY a, b, canon) AS first_id FROM c WHERE canon IS NOT NULL) SELECT DISTINCT first_id, id FROM f WHERE id <> first_id"
    p6_copies = f"WITH {records} SELECT min(id) AS first_id, count(*) AS copies FROM c WHERE canon IS NOT NULL GROUP BY a, b, canon"
    sets = f"s AS (SELECT id, a, b, canon, field, list_distinct({sql_words('text')}) AS w FROM (SELECT id, a, b, canon, 1 AS field, source_text AS text FROM c UNION ALL SELECT id, a, b, canon, 2, previous_source_text FROM c)), l AS (SELECT *, len(w) AS n FROM s WHERE len(w) >= {neardup.LEAST_WORDS}), e AS (SELECT id, a, b, canon, field, n, unnest(w) AS w FROM l)"
    p2 = f"WITH {records}, {sets}, m AS (SELECT x.id AS id_a, y.id AS id_b, x.field, y.field AS f2, x.n + y.n AS n, count(*) AS shared FROM e x JOIN e y ON x.w = y.w AND x.a = y.a AND x.b = y.b AND x.id < y.id AND x.canon IS DISTINCT FROM y.canon GROUP BY ALL) SELECT DISTINCT id_a, id_b FROM m WHERE 4 * shared >= 3 * (n - shared)"
    units = f"SELECT coalesce(provider, '') AS source, unnest([{{'unit': 'chars', 'length': length(translated_text)}}, {{'unit': 'bytes', 'length': strlen(translated_text)}}]) AS u, regexp_matches(translated_text, {literal(breaks.ENDED)}) AS ended FROM bt_translations WHERE translated_text IS NOT NULL"
    by = f"by_ AS (SELECT source, u.unit AS unit, u.length AS length, count(*) AS all_texts, count(*) FILTER (WHERE NOT ended) AS open_texts FROM ({units}) GROUP BY ALL)"
    p1 = f"WITH {by} SELECT x.source, x.unit, x.length, x.open_texts, x.all_texts FROM by_ x LEFT JOIN by_ y ON y.source = x.source AND y.unit = x.unit AND y.length <> x.length AND abs(y.length - x.length) <= {breaks.AROUND} GROUP BY ALL HAVING x.open_texts >= {breaks.SPIKE_LEAST} AND x.open_texts > {breaks.SPIKE_TIMES} * (coalesce(sum(y.open_texts), 0) / {2 * breaks.AROUND}.0 + 1)"
    return {"p1_spikes": p1, "p2_found": p2, "p5_found": p5, "p5_canonical": p5_canonical, "p6_found": p6, "p6_copies": p6_copies, "p9_found": p9}
