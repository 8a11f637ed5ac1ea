"""Memoised tokenising of whole texts by pieces between which no token can reach.

In text where each white-space character is a single space or newline between two
others, a space before a word, or a newline, always starts a new pre-token of the GPT-2
style pattern, so a text's ids are the joined ids of its pieces " word" and "\\nword".
Any other text is split by the pattern itself, and so are all texts where the pattern is
another one.  Pieces repeat, so their ids are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import public_tokenizers
import regex


class PieceMemo:
    """``encode`` maps a list of pieces to their ids (bytes of little-endian uint32 each).

    At most two generations of ``limit`` pieces are kept: what is not used for a whole generation goes.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], pattern: str, limit: int = 300_000) -> None:
        self.encode, self.split, self.limit = encode, regex.compile(pattern).findall, limit
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.usual = pattern == public_tokenizers.PATTERN

    def _look_up(self, pieces: list[str]) -> bytes:
        return b"".join(self.each(pieces))

    def each(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        known = self.known
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:
            if len(known) > self.limit:
                self.old, self.known = known, {}
                known = self.known
            lacking, old = set(pieces).difference(known), self.old
            known.update((p, old[p]) for p in lacking if p in old)
            missing = list(lacking.difference(known))
            known.update(zip(missing, self.encode(missing), strict=True))
            return list(map(known.__getitem__, pieces))

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text; null and empty texts have none."""
        if not text:
            return b""
        return self._look_up(self._pieces(text))

    def _pieces(self, text: str) -> list[str]:
        single = self.usual and not any(map(text.__contains__, ("  ", " \n", "\n ", "\n\n", "\0")))
        if single and not text[0].isspace() and not text[-1].isspace() and len(text.split()) == text.count(" ") + text.count("\n") + 1:
            return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return self.split(text)
