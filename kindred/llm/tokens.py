"""Token ids of whole texts from a public byte-level BPE vocabulary, by the tokenizers library.

The vocabulary's splitting pattern never joins characters across a single space between two characters that aren't
white space, so a text may be cut there and each piece (with its leading space) encoded alone with the same
result. Pieces recur, so their ids are kept in a bounded cache of two generations: most of a text is then a dictionary lookup,
and a piece that was met in neither of the last two generations is forgotten.
Pieces of letters with at most one closing mark go straight to the library's BPE model, all others through its full
encoder.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from kindred.llm.worker import CACHES

#: Pieces of a generation (two are kept, about 200 bytes a piece), and longest piece that is kept.
CACHE_PIECES, CACHE_CHARS = 200_000, 48
#: White space other than space and newline, as the cutting rule must see it.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
#: Spaces and newlines side by side.
ADJACENT = ("  ", " \n", "\n ", "\n\n")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters, then marks other than the apostrophe: two parts of the vocabulary's splitting pattern.
_PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ]+)([!-&(-/:-@\[-`{-~]*)\Z")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next letter from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Encodes texts to numpy arrays of ids; one per Python worker and vocabulary."""

    _made: dict[tuple[str, int], Encoder] = {}

    def __init__(self, vocabulary: str, pieces: int = CACHE_PIECES):
        self._most = pieces
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._full = Tokenizer.from_file(vocabulary)
        self._full.encode_special_tokens = True
        self._full.no_padding()
        self._full.no_truncation()
        self._model = self._full.model
        self._letters = _byte_letters()
        self._space = self._letters[32]
        self._newline = [t.id for t in self._model.tokenize(self._letters[10])]
        self._clear()

    @classmethod
    def of(cls, vocabulary: str | None = None, pieces: int = CACHE_PIECES) -> Encoder:
        key = vocabulary or default_vocabulary(), pieces
        if key not in cls._made:
            cls._made[key] = cls(*key)
        CACHES["tokens"] = cls._made.clear
        return cls._made[key]

    def _clear(self) -> None:
        self._flat, self._ends = array("I"), array("q", [0])
        self._inner, self._first, self._marks = _Places(self, " "), _Places(self, ""), _Marks(self._model)

    def _turn(self) -> None:
        """Begin a new generation: this one becomes the old one, and the ids of what only the last one held go."""
        old = self._inner, self._first
        self._inner, self._first = (_Places(self, lead, was, self._flat, self._ends) for lead, was in zip((" ", ""), old, strict=True))
        for was in old:
            was.forget()
        self._flat, self._ends = array("I"), array("q", [0])

    def _add(self, piece: str) -> int:
        """Encode one piece and give its place among the kept ones."""
        lead = piece[:1]
        m = _PLAIN.match(piece, 1) if lead == " " or lead == "\n" else _PLAIN.match(piece)
        if m:
            word, marks = m[1], m[2]
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self._letters)
            if lead == " ":
                word = self._space + word
            ids = self._inner.known(m[1]) if lead == " " else None
            if ids is None:
                ids = [t.id for t in self._model.tokenize(word)]
            if lead == "\n":
                ids = self._newline + ids
            self._flat.extend(ids)
            if marks:
                self._flat.extend(self._marks[marks])
        else:
            self._flat.extend(self._full.encode(piece, add_special_tokens=False).ids)
        self._ends.append(len(self._flat))
        return len(self._ends) - 2

    def _add_word(self, word: str) -> int:
        """Encode a space and ASCII letters."""
        self._flat.extend([t.id for t in self._model.tokenize(self._space + word)])
        self._ends.append(len(self._flat))
        return len(self._ends) - 2

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts one after another, and n + 1 offsets; ``end`` closes each text."""
        if len(self._inner) + len(self._first) > self._most or len(self._flat) > 32 * self._most:
            self._turn()
        places: list[int] = []
        counts = []
        stop = None
        if end is not None:
            stop = len(self._ends) - 1
            self._flat.append(end)
            self._ends.append(len(self._flat))
        for text in texts:
            was = len(places)
            if text:
                if text[0] in " \n" or text[-1] in " \n" or any(c in text for c in ADJACENT) or any(c in text for c in OTHER_SPACE):
                    pieces = _CUT.split(text)
                else:  # white space is single spaces and newlines between other characters: a newline opens a piece too
                    pieces = text.replace("\n", " \n").split(" ")
                places.append(self._first[pieces[0]])
                places.extend(map(self._inner.__getitem__, pieces[1:]))
            if stop is not None:
                places.append(stop)
            counts.append(len(places) - was)
        where = np.array(places, np.int64)
        ends = np.frombuffer(self._ends, np.int64)
        starts, lengths = ends[where], ends[where + 1] - ends[where]
        after = np.cumsum(lengths)
        total = int(after[-1]) if len(after) else 0
        ids = np.frombuffer(self._flat, np.uint32)[np.repeat(starts - (after - lengths), lengths) + np.arange(total)] if total else np.zeros(0, np.uint32)
        cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return ids, np.concatenate([[0], after])[cuts]


class _Places(dict):
    """piece -> place of its ids in this generation; takes a missing piece over from the old one, or encodes it with the given lead."""

    def __init__(self, owner: Encoder, lead: str, old: _Places | None = None, flat: array | None = None, ends: array | None = None):
        self._owner, self._lead = owner, lead
        self._old, self._old_flat, self._old_ends = old or {}, flat, ends

    def forget(self) -> None:
        self._old, self._old_flat, self._old_ends = {}, None, None

    def known(self, piece: str) -> array | None:
        """The ids of a piece that either generation holds."""
        place, flat, ends = self.get(piece), self._owner._flat, self._owner._ends
        if place is None:
            place, flat, ends = self._old.get(piece), self._old_flat, self._old_ends
        return None if place is None else flat[ends[place] : ends[place + 1]]

    def __missing__(self, piece: str) -> int:
        place = self._old.get(piece)
        if place is not None:
            owner, ends = self._owner, self._old_ends
            owner._flat.extend(self._old_flat[ends[place] : ends[place + 1]])
            owner._ends.append(len(owner._flat))
            self[piece] = place = len(owner._ends) - 2
            return place
        if piece.isascii() and piece.isalpha() and self._lead:
            place = self._owner._add_word(piece)
        else:
            place = self._owner._add(piece if piece[:1] == "\n" else self._lead + piece)
        if len(piece) <= CACHE_CHARS:
            self[piece] = place
        return place


class _Marks(dict):
    """ASCII marks -> their ids."""

    def __init__(self, model):
        self._model = model

    def __missing__(self, marks: str) -> list[int]:
        ids = [t.id for t in self._model.tokenize(marks)]
        if len(self) < 10_000 and len(marks) <= CACHE_CHARS:
            self[marks] = ids
        return ids


def groups_by_size(texts: list[str | None], most: int = 1 << 19):
    """(from, to) runs of the list of at most ``most`` characters, or of one longer text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)
