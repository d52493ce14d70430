"""Language prefixes and exclusions of URLs, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_path(url: Column, home: str = "") -> Column:
    """Path below the site's home, with one slash before it."""
    path = F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.lit(""))
    home = home.rstrip("/")
    below = F.when(path.startswith(home), F.substring(path, F.lit(len(home) + 1), F.length(path))).otherwise(path) if home else path
    return F.concat(F.lit("/"), F.regexp_replace(below, "^/+", ""))


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def language_of(url: Column, targets: Sequence[str], source: str, cookie: Column | None = None, home: str = "") -> Column:
    """First target language whose prefix the path bears, else a valid cookie, else the source language."""
    first = F.regexp_extract(relative_path(url, home), "^/([^/]+)(?:/|$)", 1)
    out = F.when(first.isin(list(targets)), first)
    if cookie is not None:
        out = out.when(cookie.isin(list(targets)), cookie)
    return out.otherwise(F.lit(source))


def without_language(url: Column, targets: Sequence[str], home: str = "") -> Column:
    """Path without a target language's prefix, with its query."""
    path = F.regexp_replace(relative_path(url, home), f"^/(?:{'|'.join(targets)})(?:/|$)", "/") if targets else relative_path(url, home)
    q = query(url)
    return F.concat(F.lit(home.rstrip("/")), path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def url_for(url: Column, lang: Column, targets: Sequence[str], source: str, home: str = "") -> Column:
    """The URL of the same page in another language."""
    path = F.regexp_replace(without_language(url, targets, home), r"\?.*$", "")
    below = F.substring(path, F.lit(len(home.rstrip("/")) + 1), F.length(path))
    slashed = F.when(below.endswith("/"), below).otherwise(F.concat(below, F.lit("/")))
    q = query(url)
    return F.concat(F.lit(home.rstrip("/")), F.when(lang == source, slashed).otherwise(F.concat(F.lit("/"), lang, slashed)), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def alternates(url: Column, targets: Sequence[str], source: str, home: str = "") -> Column:
    """Array of ``lang``, ``url``: the page in the source language and every target, and ``x-default`` for the source."""
    langs = [*dict.fromkeys((source, *targets))]
    one = lambda name, lang: F.struct(F.lit(name).alias("lang"), url_for(url, F.lit(lang), targets, source, home).alias("url"))
    return F.array(*[one(x, x) for x in langs], one("x-default", source))


def switcher(url: Column, targets: Sequence[str], source: str, labels: Mapping[str, str], cookie: Column | None = None, home: str = "") -> Column:
    """Array of ``lang``, ``label``, ``url``, ``is_current``: one entry for each language of the site; unknown ones are labelled by their code."""
    current = language_of(url, targets, source, cookie, home)
    return F.array(*[F.struct(F.lit(x).alias("lang"), F.lit(labels.get(x, x.upper())).alias("label"), url_for(url, F.lit(x), targets, source, home).alias("url"), (current == x).alias("is_current")) for x in dict.fromkeys((source, *targets))])


def is_translated(url: Column, text: Column, targets: Sequence[str], source: str, excluded: Sequence[str] = (), home: str = "") -> Column:
    """Whether a page's text is to be translated: a target language, a path that isn't excluded, a text that isn't blank."""
    return F.coalesce((language_of(url, targets, source, home=home) != source) & ~is_excluded(url, excluded, targets, home) & (F.trim(text) != ""), F.lit(False))


def is_excluded(url: Column, prefixes: Sequence[str], targets: Sequence[str], home: str = "") -> Column:
    """Whether the page lies at or below one of the excluded paths; the root excludes nothing."""
    path = F.regexp_replace(F.regexp_replace(without_language(url, targets, home), r"\?.*$", ""), "(?<=.)/+$", "")
    cut = [p for p in ("/" + x.strip().strip("/") for x in prefixes if x.strip() and not x.strip().startswith("#")) if p != "/"]
    out = F.lit(False)
    for p in cut:
        out = out | (path == p) | path.startswith(p + "/")
    return out
