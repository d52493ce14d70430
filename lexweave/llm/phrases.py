"""Many phrases searched in one pass over a text."""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick


class Phrases:
    """Aho-Corasick automaton of lower case phrases."""

    def __init__(self, phrases: Iterable[str]) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for x in phrases:
            self.automaton.add_word(x)
        self.automaton.make_automaton()

    def within(self, text: str) -> bool:
        """Whether ``text``, in lower case, holds any of the phrases."""
        return next(self.automaton.iter(text), None) is not None
