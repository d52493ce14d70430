"""Settings of a site and the labels of languages and providers."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Languages and providers by code.
LANGUAGES = {"de": "German", "en": "English", "fr": "French", "es": "Spanish", "it": "Italian", "nl": "Dutch", "pl": "Polish", "pt": "Portuguese", "ru": "Russian", "uk": "Ukrainian", "cs": "Czech", "sv": "Swedish", "da": "Danish", "fi": "Finnish", "no": "Norwegian", "ja": "Japanese", "zh": "Chinese", "ar": "Arabic", "tr": "Turkish", "hu": "Hungarian"}
PROVIDERS = {"mymemory": "MyMemory (free)", "libretranslate": "LibreTranslate (free / self-hosted)", "deepl": "DeepL (API key)", "google": "Google Cloud Translation (API key)"}
# Target codes that one provider spells its own way.
PROVIDER_TARGETS = {"en": "EN-US", "pt": "PT-PT", "zh": "ZH"}


@dataclass(frozen=True)
class Settings:
    source_lang: str = "de"
    target_langs: tuple[str, ...] = ("en",)
    provider: str = "mymemory"
    autocorrect: bool = True
    join_words: bool = True
    collapse: bool = True
    signs: bool = True
    capitals: bool = True
    excluded_types: tuple[str, ...] = ()
    excluded_ids: tuple[int, ...] = ()
    excluded_paths: tuple[str, ...] = ()

    @classmethod
    def of(cls, stored: dict) -> Settings:
        """Stored values over the defaults; unknown languages and providers fall back, targets exclude the source."""
        known = {f.name for f in fields(cls)}
        base = cls(**{k: v for k, v in stored.items() if k in known})
        source = base.source_lang if base.source_lang in LANGUAGES else "de"
        targets = tuple(dict.fromkeys(x for x in base.target_langs if x in LANGUAGES and x != source)) or (("en",) if source != "en" else ("fr",))
        provider = base.provider if base.provider in PROVIDERS else "mymemory"
        return cls(**{**{f.name: getattr(base, f.name) for f in fields(cls)}, "source_lang": source, "target_langs": targets, "provider": provider})

    @property
    def all_langs(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.source_lang, *self.target_langs)))


def provider_target(lang: str) -> str:
    return PROVIDER_TARGETS.get(lang, lang.upper())
