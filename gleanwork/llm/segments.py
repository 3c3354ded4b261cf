"""Cutting text at white space into segments whose tokens do not depend on their neighbours.

Byte-level vocabularies split a text with a pattern of which only a white-space run looks
ahead, and only at the character behind it. A cut in front of a white-space run is
therefore a cut between two matches, whatever stands on either side: the tokens of a text
are those of its segments, one after the other. Segments repeat a lot, so a bounded table
of them saves most of the work; it changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Unicode's White_Space, which is narrower than Python's `\s` and `str.split`.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A white-space run with the word behind it, or the white space at a text's end.
SEGMENTS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
WORDS = re.compile(f"[^{WHITE}]+").findall
#: Characters that `str.split` takes for white space and Unicode does not.
ONLY_PYTHON = re.compile("[\x1c-\x1f]").search


def words(text: str) -> list[str]:
    """The runs of a text that hold no white space."""
    return WORDS(text) if ONLY_PYTHON(text) else text.split()


class Memo(dict):
    """A table of results of bounded size, so a worker's memory is bounded.

    It holds two generations: when the young one is full it becomes the old one, whose
    entries come back when they are asked for. Common keys so survive the rare ones.
    """

    #: Longer keys are computed anew: they seldom repeat and would fill the table.
    KEY_LENGTH = 40

    def __init__(self, compute: Callable, entries: int = 400_000):
        super().__init__()
        self.compute, self.half, self.old = compute, entries // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(key) > self.KEY_LENGTH:
            return
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def take(self, keys: set) -> dict:
        """The values of the keys, None for those that are not held."""
        young, old = self.get, self.old.get
        return {key: young(key) or old(key) for key in keys}
