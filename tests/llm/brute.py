"""Plain versions of the definitions, for small tables."""

import re
import unicodedata
from collections import defaultdict

from lexweave.llm.forms import LIGATURES, fold_table

MATCH, PLAIN = fold_table()
TABLE = {ord(c): (PLAIN[i] if i < len(PLAIN) else None) for i, c in enumerate(MATCH)}


def form(t):
    for a, b in LIGATURES.items():
        t = t.replace(a, b)
    return unicodedata.normalize("NFC", t.translate(TABLE))


def words(t):
    return re.findall(r"[^\W_]+", form(t).lower())


def variants(rows, fields):
    """rows: dicts. Pairs of ids whose field looks the same and differs."""
    out = set()
    for f in fields:
        by = defaultdict(list)
        for r in rows:
            if r[f] is not None:
                by[r["source_lang"], r["target_lang"], form(r[f])].append(r)
        for group in by.values():
            out |= {(min(a["id"], b["id"]), max(a["id"], b["id"]), f) for a in group for b in group if a[f] != b[f] and a["id"] != b["id"] and form(a[f]).strip()}
    return out


def canonical(t):
    s = form(t).lower()
    pieces = [p for p in re.split(r"[;|·•\n\r]|(?<!\d)[,/]|[,/](?!\d)", s) if re.search(r"[^\W_]", p)]
    signs = [re.split("[:=]", p) for p in pieces]
    good = len(pieces) > 1 and all(len(x) == 2 and 1 <= len(words(x[0])) <= 4 and words(x[1]) and not re.search(r"[.!?…]\s+\w", p) and re.search(r"\w[\W_]*$", x[0]) for x, p in zip(signs, pieces, strict=True))
    return ("fields", *sorted((tuple(words(a)), tuple(words(b))) for a, b in signs)) if good else ("words", *words(t))


def copies(rows):
    first, out = {}, set()
    for r in sorted(rows, key=lambda r: r["id"]):
        if r["source_text"] is not None:
            k = r["source_lang"], r["target_lang"], canonical(r["source_text"])
            if first.setdefault(k, r["id"]) != r["id"]:
                out.add((first[k], r["id"]))
    return out


def near(rows):
    texts = [(r["id"], (r["source_lang"], r["target_lang"]), canonical(r["source_text"] or ""), set(words(t))) for r in rows for t in (r["source_text"], r["previous_source_text"]) if t]
    texts = [x for x in texts if len(x[3]) >= 18]
    return {(min(a[0], b[0]), max(a[0], b[0])) for a in texts for b in texts if a[0] < b[0] and a[1] == b[1] and a[2] != b[2] and 4 * len(a[3] & b[3]) >= 3 * len(a[3] | b[3])}


def leaks(docs, items, n=8):
    runs = defaultdict(set)
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            runs[tuple(w[k : k + n])].add(i)
    out = set()
    for d, t in docs:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in runs.get(tuple(w[k : k + n]), ())}
    return out
