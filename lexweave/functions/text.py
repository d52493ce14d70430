"""Normalization, classification, affixes and guards of segments, as Column expressions.

All patterns name Unicode blanks and word characters explicitly, so that every engine reads them alike.
"""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks in the Unicode sense, inside and as a character class.
WS_IN = r"\s\x0B\x{0085}\p{Z}"
WS = f"[{WS_IN}]"
NOT_WS = f"[^{WS_IN}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
TOKEN = r"[\p{L}\p{N}_]+"

ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# Frequent entities, enough for texts that hold no other.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#039;": "'", "&#8217;": "’", "&#8211;": "–", "&#8230;": "…", "&hellip;": "…", "&shy;": "­", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
# Spaces before these signs go, three dots first.
SPACE_BEFORE = rf"{WS}+(\.\.\.|[.…,;:!?])"
# Physical units after a number.
UNITS = "uF|uf|µF|mF|nF|pF|mA|uA|µA|mV|kV|kHz|MHz|GHz|mW|kW|Hz|Ω|ohm|°C|°F|[VAW%]"
JOINER = rf"{WS}\+{WS}"
NUMBER = rf"(?:(?<![\p{{L}}\p{{N}}_])|(?<=[vV]))(?:\d+(?:\.\d+){{2,}}|\d+(?:[.,]\d+)?(?:{WS}*(?:{UNITS}))?)(?![\p{{L}}\p{{N}}_])"
# Endings of bare host names.
HOST_ENDS = "com|net|org|de|eu|io|info|biz|app|dev|shop|blog|cloud|edu|gov|uk|us|fr|it|nl|at|ch"
HOST = rf"(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+(?:{HOST_ENDS})"
# The shapes of addresses, links and shortcodes.
MAIL = r"(?:mailto:)?[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
# The signs that end a sentence or bracket and not the link before them.
LINK_END = r"[^\s<>\"'.,;:!?)\]]"
LINK_SEGMENT = (rf"(?i)^{MAIL}$", r"(?i)^(?:https?://|ftp://|www\.)\S+", rf"(?i)^{HOST}(?:/\S*)?$")
LINK = rf"(?i:{MAIL}|(?:https?://|ftp://|www\.)[^\s<>\"']*{LINK_END}|(?<![\w.@]){HOST}(?:/(?:[^\s<>\"']*{LINK_END})?)?)"
SHORTCODE = rf"\[[a-zA-Z][\p{{L}}\p{{N}}_-]*(?:{WS}+[^\]]*)?\](?:(?s:.)*?\[/[a-zA-Z][\p{{L}}\p{{N}}_-]*\])?"
# Command line tools that open a command.
TOOLS = "npm|npx|yarn|pnpm|git|composer|wp|docker|curl|ssh|pip|python|node|cargo|make|sudo"
NUMBER_UNIT = rf"^\d+([.,]\d+)?{WS}*[A-Za-zΩ°%]{{1,4}}$"
CAPITALS = r"^[A-Z0-9][A-Z0-9+-]*$"
EDGE = rf"[\p{{P}}\p{{S}}{WS_IN}]+"
# Words and phrases that tell English and German.
ENGLISH = "the and with for from this that are was were have been can used into about their there which when what will would could should also only than then them these those over under after before between through during without because while where or an of to in on at by as is it be no not named module error message failed missing invalid cannot undefined found warning exception please click select file path line return import class function".split()
ENGLISH_ERRORS = ("no module named", "modulenotfounderror", "traceback (most recent call last)", "permission denied", "command not found", "syntaxerror", "filenotfounderror", "nameerror", "typeerror", "attributeerror", "importerror")
# A phrase counts between the edges of words; after the bracket of the third one a word has to follow.
ERROR_PHRASE = "(?:^|[^\\p{L}\\p{N}_])(?:" + "|".join(x.replace("(", "\\(").replace(")", "\\)") + ("[\\p{L}\\p{N}_]" if x.endswith(")") else "(?:[^\\p{L}\\p{N}_]|$)") for x in ENGLISH_ERRORS) + ")"
GERMAN = "der die das und für mit nicht auch oder ein eine einer eines ist sind von zu den dem des auf aus bei nach über unter wenn wie noch schon werden wurde wurden kann können sich als aber nur mehr sehr hier dort diese dieser dieses einen einem".split()
UMLAUT = "[äöüÄÖÜß]"
# Markers of provider errors; the second list holds one more.
PURGE_MARKERS = ("MYMEMORY WARNING", "PLEASE SELECT TWO-LETTER ISO", "RFC3066", "INVALID LANGUAGE PAIR", "QUERY LENGTH LIMIT", "YOU USED ALL AVAILABLE FREE TRANSLATIONS")
ERROR_MARKERS = (*PURGE_MARKERS, "IS NOT SUPPORTED")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_ws(t: Column) -> Column:
    """Without the blanks and line breaks that ASCII knows at either end."""
    return F.regexp_replace(t, r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$", "")


def decode_entities(t: Column) -> Column:
    """Entities of the forms ``&name;`` and ``&#n;`` in one pass; unknown ones stay."""
    frequent = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), t)
    # Few texts hold an entity besides the frequent ones; only they are taken apart.
    rest = reduce(lambda c, e: F.replace(c, F.lit(e), F.lit("")), ENTITIES, t)
    return F.when(~t.contains("&"), t).when(rest.rlike(ENTITY), _decoded(t)).otherwise(frequent)


def _decoded(t: Column) -> Column:
    found, between = F.regexp_extract_all(t, F.lit(f"({ENTITY})"), F.lit(1)), F.split(t, ENTITY, -1)
    return F.array_join(F.transform(between, lambda x, i: F.when(i == 0, x).otherwise(F.concat(_entity(F.get(found, i - 1)), x))), "")


def _entity(e: Column) -> Column:
    body = F.substring(e, F.lit(2), F.length(e) - 2)
    number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10)).when(body.startswith("#"), F.substring(body, F.lit(2), F.length(body))).cast("long")
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    sign = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    # One literal of all names of the standard, which the optimizer folds.
    names = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")})), "map<string,string>")
    return F.coalesce(F.when(valid, sign), F.when(number.isNull(), F.try_element_at(names, body)), e)


def unify_ellipsis(t: Column) -> Column:
    """One form of the ellipsis; no-break spaces become blanks, soft hyphens go."""
    return F.translate(F.replace(t, F.lit("…"), F.lit("...")), "\u00a0\u00ad", " ")


def join_broken_words(t: Column) -> Column:
    t = F.regexp_replace(t, r"\x{00AD}[\r\n]+", "")
    t = F.regexp_replace(t, r"(\p{L})-[\r\n]+(\p{Ll})", "$1$2")
    return F.regexp_replace(t, r"(\p{L})[\r\n]+(\p{Ll})", "$1$2")


def breaks_to_blank(t: Column) -> Column:
    return F.regexp_replace(t, r"[ \t\f\x0B\p{Zs}]*[\r\n]+[ \t\f\x0B\p{Zs}]*", " ")


def collapse_blanks(t: Column) -> Column:
    return F.regexp_replace(t, " {2,}", " ")


def no_blank_before_sign(t: Column) -> Column:
    return F.regexp_replace(t, SPACE_BEFORE, "$1")


def capitalize_sentences(t: Column) -> Column:
    """First letter of a text and of each sentence in capitals; single tokens without sentence signs stay."""
    return let(t, _capitalized)


def _capitalized(t: Column) -> Column:
    pieces = F.regexp_extract_all(t, F.lit(rf"(?s).*?[.!?…]{WS}+|.+$"), F.lit(0))
    first = lambda x: F.concat(F.regexp_extract(x, r"(?s)^(\P{L}*)", 1), F.upper(F.regexp_extract(x, r"(?s)^\P{L}*(\p{Ll})", 1)), F.regexp_replace(x, r"(?s)^\P{L}*\p{Ll}?", ""))
    later = lambda x: F.concat(F.upper(F.regexp_extract(x, r"^(\p{Ll})", 1)), F.regexp_replace(x, r"^\p{Ll}", ""))
    done = F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, first(x)).otherwise(later(x))), "")
    return F.when(t.rlike(rf"{WS}|[.!?…]"), done).otherwise(t)


def autocorrect(t: Column, join_words: bool = True, collapse: bool = True, signs: bool = True, capitals: bool = True) -> Column:
    """The correction rules in their order, each with its switch; line breaks always become blanks."""
    t = breaks_to_blank(join_broken_words(t) if join_words else t)
    t = collapse_blanks(t) if collapse else t
    t = no_blank_before_sign(t) if signs else t
    return capitalize_sentences(t) if capitals else t


def normalize(t: Column, correct: bool = True) -> Column:
    """The text under which a segment is stored; null stays null."""
    t = F.regexp_replace(decode_entities(t), r"[\t\f]+", " ")
    t = t if correct else F.regexp_replace(t, r"[\r\n]+", " ")
    t = unify_ellipsis(trim_ws(t))
    return autocorrect(t) if correct else t


def canonical_source(t: Column) -> Column:
    """Form under which near-duplicate rows of a review meet."""
    return unify_ellipsis(trim_ws(F.regexp_replace(decode_entities(t), f"{WS}+", " ")))


def matches(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern))


def is_opaque_id(t: Column) -> Column:
    return let(trim_ws(t), _opaque)


def _opaque(t: Column) -> Column:
    return (F.length(t) >= 16) & t.rlike("^[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+$") & (matches(t, "[0-9a-fA-F]") / F.length(t) >= 0.55)


def is_code(t: Column) -> Column:
    """Commands, paths, dense code signs and opaque ids."""
    return let(trim_ws(t), _code)


def _code(t: Column) -> Column:
    signs = matches(t, r"[{}();=\[\]<>$|\\/`]")
    dense = (F.length(t) >= 8) & (signs >= 4) & t.rlike(r"\p{L}") & (signs / F.length(t) >= 0.12)
    glued = (matches(t, ";") >= 2) & t.rlike("[{}=()]")
    opening = t.rlike(rf"^(?:\$|#|>|PS(?:{WS}+C:)?|C:\\){WS}+{NOT_WS}") | t.rlike(rf"(?i)^(?:{TOOLS}){WS}+{NOT_WS}") | t.rlike(rf"^[A-Za-z]:\\{NOT_WS}+")
    return opening | dense | glued | _opaque(t)


def is_technical(t: Column) -> Column:
    """Part numbers, versions and codes that every language writes alike."""
    return let(trim_ws(t), _technical)


def _technical(t: Column) -> Column:
    parts = F.filter(F.split(t, rf"[,\-/_.:{WS_IN}]+"), lambda p: p != "")
    shape = (F.length(t) >= 2) & (F.length(t) <= 40) & t.rlike(rf"^[A-Za-z0-9](?:[A-Za-z0-9,\-/_.:{WS_IN}]*[A-Za-z0-9])?$") & t.rlike("[A-Za-z]") & t.rlike("[0-9]")
    plain = F.forall(parts, lambda p: ~p.rlike("^[A-Za-z]{4,}$") & (~p.rlike("^[A-Za-z]{3}$") | p.rlike("^[A-Z]{3}$")))
    single = (F.length(t) <= 12) & t.rlike("^(?:[A-Za-z]{1,4}[0-9][A-Za-z0-9]*|[0-9]+[A-Za-z]{1,4})$")
    return _opaque(t) | (shape & plain & F.when(t.rlike(rf"[,\-/_.:{WS_IN}]"), F.size(parts) >= 2).otherwise(single))


def is_link(t: Column) -> Column:
    return let(trim_ws(t), lambda x: reduce(lambda a, b: a | b, [x.rlike(p) for p in LINK_SEGMENT]))


def is_shortcode(t: Column) -> Column:
    return trim_ws(t).rlike(rf"^{SHORTCODE}{WS}*$")


def is_number_unit(t: Column) -> Column:
    return t.rlike(NUMBER_UNIT)


def is_capital_code(t: Column) -> Column:
    return (F.length(t) <= 5) & t.rlike(CAPITALS)


def is_translatable(t: Column) -> Column:
    """Whether a segment is worth a translation; the do-not-translate phrases are a join of their own."""
    no = is_link(t) | is_shortcode(t) | is_code(t) | is_number_unit(t) | is_capital_code(t) | t.rlike(rf"^[\d{WS_IN}.,:;+()/%€$-]+$")
    return (F.length(t) >= 2) & t.rlike(r"\p{L}") & ~no


def hits(t: Column, words: list[str]) -> Column:
    """Tokens of a text that a word list holds."""
    return F.size(F.filter(F.regexp_extract_all(F.lower(t), F.lit(TOKEN), F.lit(0)), lambda w: w.isin(words)))


def looks_english(t: Column) -> Column:
    low = F.lower(t)
    error = low.rlike(ERROR_PHRASE)
    need = F.when(F.length(t) < 48, 2).otherwise(4)
    return ~t.rlike(UMLAUT) & (error | ((F.length(t) >= 12) & (hits(t, ENGLISH) >= need)))


def looks_german(t: Column) -> Column:
    return t.rlike(UMLAUT) | ((F.length(t) >= 24) & (hits(t, GERMAN) >= 4))


def looks_like(t: Column, lang: Column) -> Column:
    low = F.lower(lang)
    return F.when(low == "en", looks_english(t)).when(low == "de", looks_german(t)).otherwise(F.lit(False))


def already_in_target(t: Column, source: Column, target: Column) -> Column:
    return F.coalesce((source != target) & looks_like(t, target) & ~looks_like(t, source), F.lit(False))


def has_artifacts(t: Column) -> Column:
    return t.contains("⟦") | t.contains("⟧")


def is_provider_error(t: Column, markers: tuple[str, ...] = ERROR_MARKERS) -> Column:
    upper = F.upper(t)
    return reduce(lambda a, b: a | b, [upper.contains(x) for x in markers])


def affix(t: Column) -> Column:
    """``prefix``, ``core``, ``suffix``: edge punctuation, symbols and blanks peeled off."""
    return let(trim_ws(t), _affix)


def _affix(t: Column) -> Column:
    prefix = F.regexp_extract(t, f"^({EDGE})", 1)
    rest = F.substring(t, F.length(prefix) + 1, F.length(t))
    suffix = F.regexp_extract(rest, f"({EDGE})$", 1)
    return F.struct(prefix.alias("prefix"), F.substring(rest, F.lit(1), F.length(rest) - F.length(suffix)).alias("core"), suffix.alias("suffix"))


def affix_split(t: Column) -> Column:
    """``affix`` where something was peeled and a core with a letter is left, else null."""
    return let(affix(t), _split)


def _split(a: Column) -> Column:
    return F.when(((a["prefix"] != "") | (a["suffix"] != "")) & (F.length(a["core"]) >= 2) & a["core"].rlike(r"\p{L}"), a)


def align_edges(source: Column, translated: Column) -> Column:
    """``translated`` with the edges of its source."""
    both = F.struct(affix(source).alias("s"), affix(translated).alias("t"), translated.alias("raw"))

    def aligned(b: Column) -> Column:
        s, t, raw = b["s"], b["t"], b["raw"]
        return F.when(t["core"] == "", trim_ws(raw)).when((s["prefix"] == t["prefix"]) & (s["suffix"] == t["suffix"]), raw).otherwise(F.concat(s["prefix"], t["core"], s["suffix"]))

    return let(both, aligned)


def scrub(t: Column) -> Column:
    return let(t, lambda x: F.when(has_artifacts(x), trim_ws(F.regexp_replace(F.translate(x, "⟦⟧", ""), rf"{WS}{{2,}}", " "))).otherwise(x))


def clean_output(t: Column) -> Column:
    t = no_blank_before_sign(collapse_blanks(t))
    return trim_ws(F.regexp_replace(t, rf"(\d+(?:[.,]\d+)?{WS}*(?:{UNITS}))(\p{{Ll}}{{3,}})", "$1 $2"))


def numbers(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0))


def mask(t: Column, pattern: str | Column, prefix: str, first: Column | None = None) -> Column:
    """``masked`` and ``originals``: each match of ``pattern`` replaced by a token numbered from ``first``, else 0."""
    pattern, first = F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0) if first is None else first
    found = F.regexp_extract_all(t, pattern, F.lit(0))
    between = F.split(t, pattern, -1)
    joined = F.array_join(F.transform(between, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(f"__{prefix}"), (i - 1 + first).cast("string"), F.lit("__"), x))), "")
    return F.struct(joined.alias("masked"), found.alias("originals"))


def mask_numbers(t: Column) -> Column:
    """Numbers masked, then the plus signs between blanks, numbered on."""
    return let(mask(t, NUMBER, "BTN"), lambda n: let(mask(n["masked"], JOINER, "BTN", F.size(n["originals"])), lambda p: F.struct(p["masked"].alias("masked"), F.concat(n["originals"], p["originals"]).alias("originals"))))


def unmask(t: Column, originals: Column, prefix: str) -> Column:
    """Tokens replaced by their originals, also where a provider changed blanks, case or brackets; literal, highest number first."""
    numbered = F.reverse(F.transform(originals, lambda o, i: F.struct(o.alias("o"), i.alias("i"))))

    def back(text: Column, p: Column) -> Column:
        token = F.concat(F.lit(prefix + r"\s*"), p["i"].cast("string"))
        shapes = F.concat(F.lit(r"(?i)__\s*"), token, F.lit(r"\s*__|⟦\s*"), token, F.lit(r"\s*⟧|\[\s*"), token, F.lit(r"\s*\]|\(\s*"), token, F.lit(r"\s*\)|\b"), token, F.lit(r"\b"))
        literal = F.replace(F.replace(p["o"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        # What lost its number but kept brackets around the original.
        bare = F.concat(F.lit(r"⟦\s*\Q"), p["o"], F.lit(r"\E\s*⟧|\[\s*\Q"), p["o"], F.lit(r"\E\s*\]"))
        return F.regexp_replace(F.regexp_replace(text, shapes, literal), bare, literal)

    return scrub(F.aggregate(numbered, t, back))


def restore_numbers(source: Column, translated: Column) -> Column:
    """``translated`` with the numbers it lost put at its end, once each."""
    both = F.struct(numbers(source).alias("s"), translated.alias("t"))

    def restored(b: Column) -> Column:
        there = lambda n: F.rlike(b["t"], F.concat(F.lit(r"(?:(?<![\p{L}\p{N}_])|(?<=[vV]))\Q"), n, F.lit(r"\E(?![\p{L}\p{N}_])")))
        lost = F.array_distinct(F.filter(b["s"], lambda n: ~there(n)))
        return let(lost, lambda x: F.when(F.size(x) > 0, F.concat(F.rtrim(b["t"]), F.lit(" "), F.array_join(x, " "))).otherwise(b["t"]))

    return let(both, restored)


def drop_repeated_tail(t: Column) -> Column:
    """Without the last number while it stands at the end and occurs before, until nothing changes."""

    def cut(b: Column) -> Column:
        last = F.element_at(b["n"], -1)
        shorter = F.regexp_replace(b["t"], F.concat(F.lit(rf"{WS}+\Q"), last, F.lit(rf"\E{WS}*$")), "")
        repeats = F.size(F.filter(b["n"], lambda n: n == last)) >= 2
        return F.when(repeats, F.regexp_replace(shorter, r"[ \t\n\r\x00\x0B]+$", "")).otherwise(b["t"])

    step = lambda x: let(F.struct(x.alias("t"), numbers(x).alias("n")), cut)
    # Each step that changes something takes one number away.
    return let(F.struct(t.alias("t"), numbers(t).alias("n")), lambda b: F.when(F.size(b["n"]) < 2, b["t"]).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(b["n"])), b["t"], lambda x, _: step(x))))


def polish(source: Column, translated: Column) -> Column:
    """Placeholders scrubbed, numbers restored, output cleaned, edges aligned."""
    return let(scrub(translated), lambda a: let(restore_numbers(source, a), lambda b: let(clean_output(drop_repeated_tail(b)), lambda c: align_edges(source, c))))


def line_list(t: Column) -> Column:
    """Lines of a setting, without blanks and comments, longest first."""
    lines = F.filter(F.transform(F.split(t, r"\r\n|\n|\r"), lambda x: trim_ws(x)), lambda x: (x != "") & ~x.startswith("#"))
    return F.array_sort(lines, lambda a, b: F.length(b) - F.length(a))


def id_list(t: Column) -> Column:
    """Positive ids of a setting, separated by blanks or commas."""
    return F.array_distinct(F.filter(F.transform(F.split(t, rf"[{WS_IN},]+"), lambda x: x.try_cast("long")), lambda i: i > 0))


def chunks(t: Column, most: int = 450) -> Column:
    """Sentences packed into requests of at most ``most`` characters; a longer sentence is cut there, as the provider takes no more."""
    start = F.struct(F.lit("").alias("b"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["b"] == "", p).otherwise(F.concat(acc["b"], F.lit(" "), p))
        fits = F.length(joined) <= most
        done = F.when(fits | (acc["b"] == ""), acc["out"]).otherwise(F.array_append(acc["out"], acc["b"]))
        return F.struct(F.when(fits, joined).otherwise(p).alias("b"), done.alias("out"))

    packed = lambda x: F.aggregate(F.split(x, rf"(?<=[.!?…]){WS}+"), start, step, lambda a: F.when(a["b"] == "", a["out"]).otherwise(F.array_append(a["out"], a["b"])))
    cut = lambda x: F.filter(F.transform(packed(x), lambda c: F.substring(trim_ws(c), 1, most)), lambda c: c != "")
    return let(trim_ws(t), lambda x: F.when(F.length(x) <= most, F.filter(F.array(x), lambda c: c != "")).otherwise(cut(x)))


def segment_hash(source: Column, target: Column, text: Column) -> Column:
    """Identity of a segment in a language pair."""
    return F.sha2(F.concat(source, F.lit("\x00"), target, F.lit("\x00"), text), 256)
