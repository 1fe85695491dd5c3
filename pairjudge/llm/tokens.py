"""Token ids of whole texts with the word-level BPE vocabulary.

That vocabulary drops white space and never lets a token cross it, so the ids of a text are those of
its space-separated words in turn. Words repeat; each task keeps the ids of the words it has seen.
"""

from __future__ import annotations

import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
END = 0
#: Words that a task remembers; beyond it the memory starts afresh. Changes speed only.
REMEMBERED = 1_000_000

#: Byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}

#: Marks that may follow a word; not the apostrophe, which begins a token with the letters after it.
_MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "'<|>")


class Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        core = word.rstrip(_MARKS)
        # Letters, then marks: a token ends between them, unless the letters' normal form ends in a combining mark.
        if len(core) < len(word) and core.isalpha() and unicodedata.normalize("NFC", core).lower().isalpha():
            ids = self[core] + self[word[len(core):]]
        elif word.isalpha() and (word.isascii() or max(word) < "Ā"):  # one run of letters, the same in any normal form
            spelled = word.lower()
            if not spelled.isascii():
                spelled = spelled.encode("utf-8").decode("latin-1").translate(_BYTE_LEVEL)
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()
        else:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=1)
def words(vocabulary: str = VOCABULARY) -> Words:
    """The tokenizer of this Python worker; ``vocabulary`` is a file name of the public vocabularies."""
    return Words(public_tokenizers.path(vocabulary))


def document_ids(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of the whole text, then the end id."""
    return np.append(np.frombuffer(words(vocabulary).text(text or ""), dtype="<u4"), np.uint32(END)).astype("<u4")
