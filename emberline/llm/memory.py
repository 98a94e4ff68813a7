"""What a Python worker remembers between tasks: one heavy tool at a time, and codes of pieces of text within a bound of bytes."""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Callable

_held: dict = {}


def held(key, make: Callable):
    """This worker's tool for ``key``. A worker that serves another operator lets the tool of the last one go first."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """For operators without a tool: what an earlier operator left in this worker goes."""
    _held.clear()


class Slots(dict):
    """Numbers keys as they come, and lists those that came since the list was last taken."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class Codes:
    """Codes of numbered keys, in two generations: what was not asked for while the younger one filled is forgotten."""

    def __init__(self):
        self.slots, self.codes, self.size = Slots(), [], 0
        self.old: tuple[dict[str, int], list] = {}, []

    def learn(self, make: Callable[[list[str]], list[bytes | None]]) -> list[bytes | None]:
        """The codes by number, after those of keys that are new have been made."""
        fresh, self.slots.fresh = self.slots.fresh, []
        at, codes = self.old
        known = [None if (i := at.get(k)) is None else codes[i] for k in fresh]
        made = iter(make([k for k, c in zip(fresh, known, strict=True) if c is None]))
        self.codes.extend([next(made) if c is None else c for c in known])
        self.size += 2 * sum(map(len, fresh)) + 230 * len(fresh)
        return self.codes

    def turn(self, most: int) -> None:
        if self.size > most // 2:
            self.old = self.slots, self.codes
            self.slots, self.codes, self.size = Slots(), [], 0


class Pieces:
    """Encodes whole texts piece by piece, each distinct piece once as long as it is remembered.

    A text is cut before single spaces that a visible character follows, where a byte-level pre-tokenizer always starts
    a match; ``split`` cuts a piece further into words (a space and letters are one), ``encode`` turns words into their codes. Pieces take up to
    three quarters of ``most`` bytes, words the rest.
    """

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]], most: int):
        self.split, self.coded, self.most = split, encode, most
        self.pieces, self.words = Codes(), Codes()  # pieces without the space in front

    def _known(self, word: str) -> bytes | None:
        """The code of a space and a piece that has one."""
        i = self.pieces.slots.get(word[1:], -1) if word[0] == " " else -1
        return self.pieces.codes[i] if 0 <= i < len(self.pieces.codes) else None

    def _learn(self, pieces: list[str]) -> list[bytes]:
        cut = {p: w for p in pieces if not (p[:1] == " " and p[1:].isalpha()) and len(w := self.split(p)) != 1}
        alone = [p for p in pieces if p not in cut]
        found = dict(zip(alone, self.coded(alone), strict=True))
        for w in set(itertools.chain.from_iterable(cut.values())):
            if w not in found:
                found[w] = self._known(w)
        rest = [w for w, code in found.items() if code is None]
        places = list(map(self.words.slots.__getitem__, rest))
        codes = self.words.learn(self.coded)
        found.update((w, codes[i]) for w, i in zip(rest, places, strict=True))
        return [b"".join(map(found.__getitem__, cut[p])) if p in cut else found[p] for p in pieces]

    def _after_space(self, pieces: list[str]) -> list[bytes | None]:
        """Codes of pieces with their space; none for white space, which stays with what is before it."""
        made = self._learn([" " + p for p in pieces if p and not p[0].isspace()])
        if len(made) == len(pieces):
            return made
        rest = iter(made)
        return [next(rest) if p and not p[0].isspace() else None for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's code: its words' codes in order."""
        number, starts, places = self.pieces.slots.__getitem__, [], []
        for t in texts:
            start, *rest = t.split(" ")
            starts.append(start)
            places.append(array("i", map(number, rest)))
        code = self.pieces.learn(self._after_space).__getitem__
        out: list = []
        for start, at in zip(self._learn(starts), places, strict=True):
            try:
                out.append(start + b"".join(map(code, at)))
            except TypeError:
                out.append(None)
        for i, made in enumerate(out):
            if made is None:
                out[i] = b"".join(self._learn(self._runs(texts[i])))
        self.pieces.turn(self.most // 4 * 3)
        self.words.turn(self.most // 4)
        return out

    @staticmethod
    def _runs(text: str) -> list[str]:
        """The text cut at its places alone, so that white space stays with what is before it."""
        start, *rest = text.split(" ")
        runs = [[start]]
        for p in rest:
            if not p or p[0].isspace():
                runs[-1].append(p)
            else:
                runs.append(["", p])
        return [" ".join(r) for r in runs]
