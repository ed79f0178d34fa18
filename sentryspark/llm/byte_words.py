"""Words of UTF-8 texts by one byte table: lower-case A-Z, blank the ASCII separators, split.

A word is a longest run of ASCII letters, digits and code points from 128 on. All bytes of such a
code point are 128 or more and the table leaves them alone, so no text has to be decoded.
"""

from __future__ import annotations

import string
import zlib

_KEPT = (string.digits + string.ascii_lowercase).encode()
_LOWER = bytes(range(256)).lower()  # of bytes: A-Z alone
TABLE = bytes(byte if byte >= 128 or byte in _KEPT else 32 for byte in _LOWER)
# Parameter: checksums of words kept per worker, about 120 bytes each, before they start anew.
CHECKSUMS_KEPT = 1_000_000


def words_of(raw: bytes | None) -> list[bytes]:
    """The words of a text's UTF-8 bytes; null has none."""
    return raw.translate(TABLE).split() if raw else []


class Checksums(dict):
    """crc32 of words, computed once for each."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CHECKSUMS_KEPT:
            self.clear()
        value = self[word] = zlib.crc32(word)
        return value


def run_checksums(words: list[bytes], longest: int, known: Checksums) -> list[int]:
    """crc32 of all runs of 1 to ``longest`` words joined by a blank.

    The checksum of a run seeds that of the run one word longer, so no run is ever spelled out.
    """
    level = found = list(map(known.__getitem__, words))
    tails = [b" " + word for word in words] if longest > 1 else []
    for size in range(2, longest + 1):
        level = list(map(zlib.crc32, tails[size - 1:], level))
        found = found + level
    return found
