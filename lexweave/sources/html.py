"""Text segments of HTML documents, and their replacement."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Elements and class names whose content is no text to translate.
SKIPPED_TAGS = frozenset(("script", "style", "code", "pre", "textarea", "svg", "kbd", "samp", "tt", "var"))
SKIPPED_CLASSES = ("wp-block-code", "wp-block-preformatted", "hljs", "crayon-", "syntaxhighlighter", "language-")
VOID_TAGS = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def unescape(text: str) -> str:
    """Entities of the forms ``&name;`` and ``&#n;``; others stay."""
    return _ENTITY.sub(lambda m: html.unescape(m.group()), text)


class TextNodes(HTMLParser):
    """Positions and texts of the text nodes outside skipped elements."""

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=False)
        self.starts = [0]
        for line in source.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.length, self.open, self.skipped = len(source), [], 0
        self.spans: list[list[int]] = []
        self.feed(source)
        self.close()
        if self.spans and self.spans[-1][1] < 0:
            self.spans[-1][1] = self.length

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _end(self) -> None:
        if self.spans and self.spans[-1][1] < 0:
            self.spans[-1][1] = self._at()

    def _text(self) -> None:
        if not self.skipped and (not self.spans or self.spans[-1][1] >= 0):
            self.spans.append([self._at(), -1])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._end()
        if tag in VOID_TAGS:
            return
        names = (dict(attrs).get("class") or "").lower()
        skip = tag in SKIPPED_TAGS or any(x in names for x in SKIPPED_CLASSES)
        self.open.append((tag, skip))
        self.skipped += skip

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._end()

    def handle_endtag(self, tag: str) -> None:
        self._end()
        if tag in [t for t, _ in self.open]:
            while self.open:
                name, skip = self.open.pop()
                self.skipped -= skip
                if name == tag:
                    return

    def handle_data(self, data: str) -> None:
        self._text()

    def handle_entityref(self, name: str) -> None:
        self._text()

    def handle_charref(self, name: str) -> None:
        self._text()

    def handle_comment(self, data: str) -> None:
        self._end()

    def handle_decl(self, decl: str) -> None:
        self._end()

    def handle_pi(self, data: str) -> None:
        self._end()

    def unknown_decl(self, data: str) -> None:
        self._end()


def text_nodes(source: str) -> list[tuple[int, int]]:
    if "<" not in source:
        return [(0, len(source))] if source else []
    return [(a, b) for a, b in TextNodes(source).spans if b > a]


@F.pandas_udf(ArrayType(StringType()))
def texts(source: pd.Series) -> pd.Series:
    """Unescaped texts of the text nodes in document order; blank ones left out, none for null."""
    return pd.Series([[x for x in (unescape(s[a:b]) for a, b in text_nodes(s)) if x.strip()] if s else [] for s in source])


@F.pandas_udf(StringType())
def replaced(source: pd.Series, keys: pd.Series, values: pd.Series) -> pd.Series:
    """``source`` with each text node whose trimmed text is among ``keys`` replaced; its outer blanks stay."""
    out = []
    for s, k, v in zip(source, keys, values, strict=True):
        if not s:
            out.append(s)
            continue
        known, parts, at = dict(zip(k, v, strict=True)), [], 0
        for a, b in text_nodes(s):
            raw = s[a:b]
            new = known.get(unescape(raw).strip())
            if new is not None:
                lead, tail = raw[: len(raw) - len(raw.lstrip())], raw[len(raw.rstrip()) :]
                parts += [s[at:a], lead, html.escape(new, quote=False), tail]
                at = b
        out.append("".join([*parts, s[at:]]))
    return pd.Series(out)


def segments(source: Column) -> Column:
    """Distinct trimmed texts of an HTML document, in the order of their first place."""
    return F.array_distinct(F.transform(texts(source), lambda x: F.trim(x)))
