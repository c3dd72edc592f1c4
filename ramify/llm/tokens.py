"""Token ids of whole texts, inside tasks.

A text is cut at spaces and line feeds. No token of the vocabularies in use here
spans white space, so the ids of a text are those of its words one after another,
and a word met before costs one dictionary lookup. New words go to the tokenizers
library.
"""

from __future__ import annotations

import os
import struct

MOST_WORDS = 800_000  # a worker remembers so many before it starts over
LONG_WORD = 100  # longer ones are encoded but not remembered

_encoders: dict[str, WordEncoder] = {}


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Word -> packed ids; works out the ids of a word at its first lookup.

    ``letters`` maps lower-case letters to what pre-tokenization makes of them. A word of
    such letters only is one piece and goes straight to the merges. None turns this off.
    """

    def __init__(self, tokenizer, letters: dict[int, str] | None):
        super().__init__()
        self._tokenizer, self._merge, self._letters = tokenizer, tokenizer.model.tokenize, letters

    def __missing__(self, word: str) -> bytes:
        if self._letters is not None and word.isalpha() and word.islower() and _latin(word):
            packed = _pack([t.id for t in self._merge(word if word.isascii() else word.translate(self._letters))])
        elif self._letters is not None and len(word) > 1 and word[-1] in ".," and word[:-1].isalpha() and _latin(word):
            # Letters and punctuation are separate pieces.
            packed = self[word[:-1]] + self[word[-1]]
        else:
            packed = _pack(self._tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= LONG_WORD:
            self[word] = packed
        return packed


class WordEncoder:
    """Whole text -> token ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._letters = _plain_letters(tokenizer)
        self._words = _Words(tokenizer, self._letters)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if self._letters is not None and _latin(text):
            text = text.lower()
        if len(self._words) > MOST_WORDS:
            self._words.clear()
        return b"".join(map(self._words.__getitem__, text.replace("\n", " ").split(" ")))


def _plain_letters(tokenizer) -> dict[int, str] | None:
    """The letters up to U+00FF as the merges see them, if case is lost and words are pieces.

    Only then are the ids of "The" those of "the", and those of "the," its and the comma's.
    """

    def ids(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    def pieces(text: str) -> list[str]:
        return [piece for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] if tokenizer.pre_tokenizer else [text]

    small = [c for c in map(chr, range(256)) if c.isalpha() and c.islower()]
    letters = {ord(c): pieces(c)[0] for c in small}
    word = "".join(small)
    direct = [t.id for t in tokenizer.model.tokenize(word.translate(letters))]
    alike = ids(word) == direct == ids(" " + word) and ids("ÀÉÑÜZ") == ids("àéñüz") and ids("Ab, ab.") == ids("ab") + ids(",") + ids("ab") + ids(".")
    whole = all(len(pieces(c)) == 1 for c in small) and pieces(word) == [word.translate(letters)]
    return letters if alike and whole else None


def _latin(text: str) -> bool:
    """Only characters up to U+00FF: normal forms and lower case are then one to one."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
