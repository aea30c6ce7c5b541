"""Texts cut into units whose tokens do not depend on their neighbours, and what has been worked out for units.

In the byte-level pattern a single line end between other characters stands alone, and a single space belongs to what
follows it. So a text in which no white space stands beside white space, or at an end, is cut at line ends and spaces.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

#: A line end; or characters up to the next space or line end, with the space before them.
CUT = re.compile("\n| ?[^ \n]+").findall


def single_spaced(text: str) -> bool:
    """Whether a text may be cut: all its white space is one character between two words each."""
    words = text.split()
    return len(text) - len("".join(words)) == len(words) - 1


class Ragged:
    """Arrays of different lengths in one."""

    def __init__(self, dtype: type):
        self.values, self.ends = np.zeros(0, dtype), np.zeros(1, np.int64)

    def add(self, values: np.ndarray, lengths: Sequence[int]) -> None:
        self.values = np.concatenate([self.values, values.astype(self.values.dtype, copy=False)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths, dtype=np.int64)])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of these numbers one after another, and their lengths."""
        starts, lengths = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        total = np.cumsum(lengths)
        return self.values[np.repeat(starts - total + lengths, lengths) + np.arange(total[-1] if len(total) else 0)], lengths

    def keep(self, numbers: np.ndarray) -> None:
        values, lengths = self.of(numbers)
        self.values, self.ends = values, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


class Units:
    """Numbers of at most about `limit` units with what is known of them: ragged arrays and strings. Beyond the limit, units
    that have been used once are forgotten, and, if too many are left, the less used ones."""

    def __init__(self, limit: int, **kinds: type):
        self.limit = limit
        self.numbers: dict[str, int] = {}
        self.uses = np.zeros(0, np.int64)
        self.shown: list[str] = []
        self.arrays = {name: Ragged(kind) for name, kind in kinds.items()}

    def missing(self, cut: list[list[str]]) -> list[str]:
        """The units of texts that are not known; room is made for them."""
        if len(self.shown) > self.limit:
            self._shrink()
        return list(set().union(*cut).difference(self.numbers))

    def add(self, new: list[str], shown: list[str], **arrays: tuple[np.ndarray, Sequence[int]]) -> None:
        self.numbers.update(zip(new, range(len(self.shown), len(self.shown) + len(new)), strict=True))
        self.shown += shown
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        for name, (values, lengths) in arrays.items():
            self.arrays[name].add(values, lengths)

    def of(self, cut: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the units of texts, which must be known."""
        found = [np.fromiter(map(self.numbers.__getitem__, units), np.int64, len(units)) for units in cut]
        self.uses += np.bincount(np.concatenate(found), minlength=len(self.uses)) if found else 0
        return found

    def _shrink(self) -> None:
        names = list(self.numbers)
        stay = np.flatnonzero((self.uses > 1) & (np.fromiter(map(len, names), np.int64, len(names)) <= 64))
        if len(stay) > self.limit // 2:
            stay = np.sort(stay[np.argsort(-self.uses[stay], kind="stable")[: self.limit // 2]])
        self.numbers = {names[k]: n for n, k in enumerate(stay.tolist())}
        self.shown = [self.shown[k] for k in stay.tolist()]
        self.uses = self.uses[stay] // 2
        for array in self.arrays.values():
            array.keep(stay)
