"""Token ids of whole texts by the ``tokenizers`` library, with its work done once per distinct word."""

from __future__ import annotations

import re
from struct import Struct

from tokenizers import Tokenizer

from helixmart.llm.common import only, remembered

#: Words of ASCII and Latin-1 letters, maybe with a comma or full stop: their normal form and cuts are plain.
_PLAIN = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,]?)\Z").match
_LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
_IDS = [Struct(f"<{n}I").pack for n in range(64)]


def _byte_alphabet() -> dict[int, str]:
    """Latin-1 letters -> the printable characters by which byte-level vocabularies write their UTF-8 bytes."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    return {ord(c): "".join(spare.get(b, chr(b)) for b in c.encode()) for c in _LETTERS}


_ALPHABET = _byte_alphabet()


def _packed(ids: list[int]) -> bytes:
    n = len(ids)
    return _IDS[n](*ids) if n < 64 else Struct(f"<{n}I").pack(*ids)


class _Known(dict):
    """word -> packed ids; a word that is not in it is looked up in the older generation or encoded."""

    def __init__(self, tokenizer: Tokenizer, short: bool, older: dict):
        super().__init__({"": b""})
        self.whole, self.model, self.short, self.older = tokenizer.encode, tokenizer.model.tokenize, short, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if not self.short:
                ids = _packed(self.whole(word, add_special_tokens=False).ids)
            elif word.isascii() and word.isalpha():
                low = word.lower()
                ids = _packed([t.id for t in self.model(low)]) if low == word else self[low]
            elif m := _PLAIN(word):
                letters, mark = m.groups()
                if mark:
                    ids = self[letters] + _packed([t.id for t in self.model(mark)])
                else:
                    ids = _packed([t.id for t in self.model(letters.lower().translate(_ALPHABET))])
            else:
                ids = _packed(self.whole(word, add_special_tokens=False).ids)
        self[word] = ids
        return ids


class WordEncoder:
    """``encode(text)`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.

    The file's tokenizer normalises and cuts at white space before anything else, so the ids of a text are
    those of its space-separated words in turn, and every word is encoded once and remembered. The memory has
    two generations of ``limit`` words each, so it is bounded and common words stay. Plain words go straight to
    the library's model, all others through the whole tokenizer. Whether the short way holds for the file is
    tried on a sample of words.
    """

    def __init__(self, path: str, limit: int = 400_000):
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        tries = [*_LETTERS, "the", "straße", "École", "ab", "a.", "Über,", "Ab,"]
        short, whole = _Known(self.tokenizer, True, {}), _Known(self.tokenizer, False, {})
        self.short = all(short[w] == whole[w] for w in tries)
        self.known = _Known(self.tokenizer, self.short, {})

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if len(self.known) > self.limit:
            older, self.known = self.known, _Known(self.tokenizer, self.short, {})
            older.older = {}
            self.known.older = older
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, WordEncoder] = {}
remembered("encoders", _ENCODERS.clear)


def encoder(path: str, limit: int = 400_000) -> WordEncoder:
    """The worker's encoder for a tokenizer file, with the memory that the caller asks for."""
    only("encoders")
    if path not in _ENCODERS or _ENCODERS[path].limit != limit:
        _ENCODERS[path] = WordEncoder(path, limit)
    return _ENCODERS[path]
