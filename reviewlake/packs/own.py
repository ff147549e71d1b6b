"""Languages of the user's own."""

from __future__ import annotations

from dataclasses import dataclass

from reviewlake.packs.rules import Rule


@dataclass(frozen=True)
class LanguagePack:
    """What the scan, the detection and the review need to know of a language.

    ``like`` names a built-in language whose metrics it takes where it has none of
    its own.  ``patterns`` maps a metric to (flags, pattern).
    """

    language: str
    extensions: tuple[str, ...]
    rules: tuple[Rule, ...] = ()
    like: str = ""
    comment_prefixes: tuple[str, ...] = ()
    comment_literal: str = ""
    duplicate_skip: str = ""
    maintainability: float | None = None
    patterns: tuple[tuple[str, str, str], ...] = ()

    def pattern(self, metric: str) -> tuple[str, str] | None:
        return next(((flags, p) for name, flags, p in self.patterns if name == metric), None)


def extensions_of(own: tuple[LanguagePack, ...]) -> dict[str, str]:
    return {(e if e.startswith(".") else f".{e}").lower(): p.language for p in own for e in p.extensions}
