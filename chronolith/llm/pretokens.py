"""Pre-tokens by the public pattern, identical to what a tokenizer library cuts.

Libraries carry different Unicode versions, so they disagree on the class of
some code points. Characters outside the ranges below, on which all agree, are
classed by the library itself and replaced by a stand-in of that class before
the pattern runs; spans are then taken from the original text.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

#: Ranges on which the libraries agree (tests compare every code point of them).
AGREED = "\\x00-\u0557\u2000-\u2070\u20a0-\u20bf\u2190-\u2426\u3000-\u303f\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fef\uac00-\ud7a3\uff01-\uff5e"
STAND_IN = {"L": "x", "N": "0", "O": "\u00a7"}


class Splitter:
    """``split(text)`` lists the matches of ``pattern``; ``kind`` classes one odd character as L, N or O."""

    def __init__(self, pattern: str, kind: Callable[[str], str]):
        self.pattern, self.kind = regex.compile(pattern), kind
        self.odd = regex.compile(f"[^{AGREED}]")
        self.known: dict[str, str] = {}

    def _stand_in(self, match) -> str:
        c = match[0]
        if c not in self.known:
            self.known[c] = STAND_IN[self.kind(c)]
        return self.known[c]

    def split(self, text: str) -> list[str]:
        if text.isascii() or not self.odd.search(text):
            return self.pattern.findall(text)
        return [text[a:b] for a, b in (m.span() for m in self.pattern.finditer(self.odd.sub(self._stand_in, text)))]
