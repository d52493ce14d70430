"""Requests to translation services and what their answers hold; the call itself is a function that is passed in."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.config import provider_target
from lexweave.functions.text import ERROR_MARKERS
from lexweave.sources.html import unescape

#: Takes a provider's code and the fields of a request, gives the status and body of the answer.
Call = Callable[[str, dict[str, str]], tuple[int, str]]
# Where each service puts the translation in its answer.
PATHS = {"mymemory": "$.responseData.translatedText", "deepl": "$.translations[0].text", "google": "$.data.translations[0].translatedText", "libretranslate": "$.translatedText"}
MOST_CHARS = 450


@dataclass(frozen=True)
class Provider:
    """One service; ``translate`` gives a text or raises an error with the reason."""

    slug: str
    call: Call

    def fields(self, text: str, source: str, target: str) -> dict[str, str]:
        """The fields of a request, named and coded as the service wants them."""
        if self.slug == "deepl":
            return {"text": text, "source_lang": source.upper(), "target_lang": provider_target(target)}
        if self.slug == "mymemory":
            return {"q": text, "langpair": f"{source}|{target}"}
        return {"q": text, "source": source, "target": target, "format": "text"}

    def translate(self, text: str, source: str, target: str) -> str:
        if self.slug != "mymemory":
            return self._one(text, source, target)
        return " ".join(self._one(part, source, target) for part in _parts(text.strip())).strip()

    def _one(self, text: str, source: str, target: str) -> str:
        code, body = self.call(self.slug, self.fields(text, source, target))
        try:
            answer = json.loads(body)
        except ValueError:
            answer = None
        if not 200 <= code < 300 or not isinstance(answer, dict):
            said = answer.get("error") if isinstance(answer, dict) else None
            raise RuntimeError(str(said) if said else f"{self.slug} failed with status {code}")
        found = answer
        for step in PATHS[self.slug][2:].replace("[", ".[").split("."):
            found = found[int(step[1:-1])] if step.startswith("[") and isinstance(found, list) and found else found.get(step) if isinstance(found, dict) else None
        if not isinstance(found, str) or not found.strip():
            raise RuntimeError(f"{self.slug} gave no translation")
        if self.slug == "mymemory" and (answer.get("responseStatus") not in (200, "200") or any(x in found.upper() for x in ERROR_MARKERS)):
            raise RuntimeError(f"{self.slug} gave a message in place of a translation")
        return unescape(found) if self.slug in ("mymemory", "google") else found


def _parts(text: str) -> list[str]:
    """Requests of at most ``MOST_CHARS`` characters, whole sentences where they fit."""
    import re

    out, held = [], ""
    for x in re.split(r"(?<=[.!?…])\s+", text) if len(text) > MOST_CHARS else [text]:
        joined = f"{held} {x}" if held else x
        if len(joined) > MOST_CHARS and held:
            out.append(held)
            joined = x
        held = joined
    return [x.strip()[:MOST_CHARS] for x in [*out, held] if x.strip()]


def provider(slug: str, call: Call) -> Provider:
    """The service of that code, the first one where the code is unknown."""
    return Provider(slug if slug in PATHS else "mymemory", call)


def answer_text(body: Column, slug: Column) -> Column:
    """The translation in an answer's body; null where there is none."""
    out = F.lit(None).cast("string")
    for name, path in PATHS.items():
        out = F.when(slug == name, F.get_json_object(body, path)).otherwise(out)
    return out
