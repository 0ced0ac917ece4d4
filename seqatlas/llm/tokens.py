"""Token ids of whole texts by the tokenizers library, with cached pieces.

Both vocabularies split a text at single spaces before they merge anything, so the ids of a
text are the ids of its pieces joined. Pieces repeat, and a cache of bounded size keeps them.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array

from seqatlas.llm.common import process_cache

_TAIL = re.compile(r"(.*?)([.,!?;:%&*#$|]*)", re.S)


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones are themselves, the others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def vocabulary(name: str) -> str:
    """The file of a public vocabulary; the folder is ``SEQATLAS_TOKENIZERS`` or the installed package."""
    folder = os.environ.get("SEQATLAS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent(dict):
    """A cache of two generations: when the younger is full, it becomes the older one."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers, without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def plain(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def merged(self, word: str) -> bytes:
        """Ids of a run of letters (with its space) that is one piece before merging: the library's model alone."""
        spelled = word if word.isascii() and word.isalpha() else "".join(map(self.letters.__getitem__, word.encode()))
        return self.packed([t.id for t in self.model.tokenize(spelled)])

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def special(self, text: str) -> bool:
        return any(m in text for m in self.marks)


class WordEncoder(Encoder):
    """The lower-casing vocabulary with word ends, which drops white space."""

    def __init__(self, path: str):
        super().__init__(path)
        self.words = Recent(self._word, 500_000)
        self.tails = Recent(self.plain, 50_000)
        self.pieces = Recent(self._piece, 400_000)

    def _word(self, word: str) -> bytes:
        # Lower-cased and composed, so that normalising changes nothing.
        return self.merged(word) if max(word) < "İ" and unicodedata.is_normalized("NFC", word) else self.plain(word)

    def _piece(self, piece: str) -> bytes:
        word, tail = _TAIL.fullmatch(piece).groups()
        if not word.isalpha() or not word.lower().isalpha():
            return self.plain(piece)
        if max(word) < "İ":
            word = word.lower()
        return self.words[word] + self.tails[tail] if tail else self.words[word]

    def __call__(self, text: str) -> bytes:
        if self.special(text):
            return self.plain(text)
        pieces = self.pieces
        return b"".join([pieces[w] for w in text.replace("\n", " ").split(" ")])


class _Whole(Exception):
    """A piece next to more white space: the text has to be encoded whole."""


class ByteEncoder(Encoder):
    """The byte-level vocabulary, where a single space belongs to the word that follows."""

    def __init__(self, path: str):
        super().__init__(path)
        self.words = Recent(self.merged, 500_000)
        self.tails = Recent(self.plain, 50_000)
        self.first = Recent(self._first, 50_000)
        self.rest = Recent(self._rest, 400_000)

    def _split(self, lead: str, piece: str) -> bytes:
        # A cut is right only at a single space or line end between characters that are not white space.
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Whole
        word, tail = _TAIL.fullmatch(piece).groups()
        if word.isalpha():
            return self.words[lead + word] + self.tails[tail] if tail else self.words[lead + word]
        return self.plain(lead + piece)

    def _first(self, piece: str) -> bytes:
        return self._split("", piece)

    def _rest(self, piece: str) -> bytes:
        return self._split(" ", piece)

    def __call__(self, text: str) -> bytes:
        if not text or self.special(text):
            return self.plain(text)
        line_end, first, rest, parts = self.tails["\n"], self.first, self.rest, []
        try:
            for i, line in enumerate(text.split("\n")):
                pieces = line.split(" ")
                if i:
                    parts.append(line_end)
                parts.append(first[pieces[0]])
                parts += [rest[w] for w in pieces[1:]]
        except _Whole:
            return self.plain(text)
        return b"".join(parts)


def encoder(kind: type[Encoder], path: str) -> Encoder:
    """One encoder for each process and vocabulary."""
    made = process_cache().setdefault("encoders", {})
    if (kind.__name__, path) not in made:
        made[kind.__name__, path] = kind(path)
    return made[kind.__name__, path]
