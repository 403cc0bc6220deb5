"""Token ids of whole texts by a public byte-level BPE, with a bounded memory of words seen."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np

# The letters and numbers among the characters of ordinary texts.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: Where a pre-token ends, in texts of those characters.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_NUMBERS}{_LETTERS}]+|\s+(?!\S)|\s+")
# Texts with any other character go to the library whole, so that Unicode tables can't differ.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7E\xA1-\xAC\xAE-ɏ]")
#: Words in each of the two generations that one worker remembers.
REMEMBERED = 250_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where printable."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts, as the tokenizers library gives them without adding special tokens; those in a text are one id.

    A pre-token has the same ids alone as in its text, so ordinary texts are cut into
    pre-tokens and only those not met lately go through the library's model. Memory is bounded:
    words of the older generation are forgotten when the younger is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Texts with an added token go to the library whole, too.
        self.whole = re.compile("|".join([_OTHER.pattern, *map(re.escape, added)]))
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
            found = array("I", [t.id for t in tokens]).tobytes()
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """An array of unsigned 32-bit ids for each text; null counts as empty."""
        out = []
        for text in texts:
            if not text:
                out.append(np.zeros(0, dtype=np.uint32))
            elif self.whole.search(text):
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32))
            else:
                if len(self.known) > REMEMBERED:
                    self.known, self.older = {}, self.known
                words, known = _PIECES.findall(text), self.known
                for word in words:
                    if word not in known:
                        known[word] = self._word(word)
                out.append(np.frombuffer(b"".join(map(known.__getitem__, words)), dtype=np.uint32))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


def with_end(ids: np.ndarray, end: int = 0) -> np.ndarray:
    return np.append(ids, np.uint32(end)).astype("<u4")


def crc32(ids: np.ndarray) -> int:
    """Unsigned checksum of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
