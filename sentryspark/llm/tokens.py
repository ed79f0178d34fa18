"""Token ids of whole texts, with the ids of seen words kept per Python worker.

Both vocabularies split a text at white space before they merge, so a text whose white space is
only single blanks and single line ends can be encoded word by word: one split, one look-up per
word. The ids are always the tokenizer's own. A new word of Latin letters, with ASCII punctuation
after it or none, is two of the pieces that the tokenizer splits off before it merges: the letters go
to its merge model directly, the punctuation is kept apart. Any other new word is encoded whole.
A text with a word that has other white space in it, is empty (from a run of blanks) or holds a
special token's mark is encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

# Parameter: words of a generation kept per worker, about 200 bytes each. When it is full, the words
# used since move to the next one and the generation before is given up.
CACHE_WORDS = 200_000
SPECIAL_MARK = "<|"
# A word that a line end or a text's start precedes (see ``WordEncoder.parts``), or a blank; letters
# that stay one letter when composed or lower-cased; punctuation without the apostrophe, which
# can begin a contraction.
SIMPLE = re.compile(
    "([\r\n]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")

_ENCODERS: dict[tuple[str, bool], "WordEncoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, blank_leads: bool) -> "WordEncoder":
    """The worker's encoder for a vocabulary file; ``blank_leads``: a word's blank is part of it."""
    key = (path, blank_leads)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, blank_leads)
    return _ENCODERS[key]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for the letters from 256 on in turn.
    """
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(byte if byte in kept else next(others)) for byte in range(256)]


class OddWord(Exception):
    """A part whose text has to be encoded whole."""


class WordEncoder(dict):
    """Ids of the parts of texts, looked up or made on first sight."""

    def __init__(self, path: str, blank_leads: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.blank_leads = blank_leads
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.letter = byte_letters()
        self.blank = self.letter[ord(" ")]
        self.packed = [number.to_bytes(4, "little") for number in range(self.tokenizer.get_vocab_size())]

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(item.ids, dtype="<u4").tobytes() for item in found]

    def parts(self, text: str) -> list[str]:
        """Parts of a text at its blanks and line ends.

        With leading blanks a part stands for: a blank and the word; the word after a line end
        (starts with it); the first word of a text (marked by a carriage return, which makes
        part of no kept word).
        """
        if not self.blank_leads:
            return text.replace("\n", " ").split(" ")
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = "\r" + keys[0]
        return keys

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None and key.isascii() and key.isalpha():
            ids = self._plain(key)
        elif ids is None:
            simple = SIMPLE.fullmatch(key)
            if simple is None or (simple[1] and not self.blank_leads):
                ids = self._other(key)
            elif simple[3]:
                ids = self[simple[1] + simple[2]] + self._mark(simple[3])
            else:
                ids = self._letters(simple[1], simple[2])
        self[key] = ids
        return ids

    def _mark(self, text: str) -> bytes:
        if text not in self.marks:
            self.marks[text] = self._ids([text])[0]
        return self.marks[text]

    def _plain(self, word: str) -> bytes:
        """Ids of a word of ASCII letters, which are their bytes' letters."""
        if self.blank_leads:
            word = self.blank + word
        else:
            lowered = word.lower()
            if lowered != word:
                return self[lowered]
        packed = self.packed
        return b"".join([packed[token.id] for token in self.merge(word)])

    def _letters(self, lead: str, word: str) -> bytes:
        if not self.blank_leads:
            lowered = word.lower()
            if lowered != word:
                return self[lowered]
        raw = word.encode() if lead or not self.blank_leads else b" " + word.encode()
        spelled = "".join(map(self.letter.__getitem__, raw))
        packed = self.packed
        ids = b"".join([packed[token.id] for token in self.merge(spelled)])
        return self._mark(lead) + ids if lead == "\n" else ids

    def _other(self, key: str) -> bytes:
        word = key[1:] if self.blank_leads and key[:1] in ("\r", "\n") else key
        if SPECIAL_MARK in word or word.split() != [word]:
            raise OddWord(key)
        if self.blank_leads and key[0] not in "\r\n":
            word = " " + word
        return self._ids(["\n" + word if self.blank_leads and key[0] == "\n" else word])[0]

    def forget(self) -> None:
        """Give up the kept words."""
        self.clear()
        self.older = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self) > CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        look = self.__getitem__
        found = []
        for text in texts:
            try:
                found.append(b"".join(map(look, self.parts(text))))
            except OddWord:
                found.append(self._ids([text])[0])
        return found


def slices(texts: list[str], characters: int = 4_000_000) -> list[tuple[int, int]]:
    """Ranges of ``texts`` of bounded total length, for work that holds a range in memory."""
    cuts, start, held = [], 0, 0
    for number, text in enumerate(texts):
        held += len(text)
        if held >= characters:
            cuts.append((start, number + 1))
            start, held = number + 1, 0
    if start < len(texts):
        cuts.append((start, len(texts)))
    return cuts
