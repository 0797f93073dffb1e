"""Token ids of texts by a given byte-level BPE vocabulary, with a table of the words seen so far."""

from __future__ import annotations

import re
from array import array
from functools import cache

from tokenizers import Tokenizer

#: Words whose ids a worker keeps; further ones are encoded each time.
KEPT_WORDS = 1_500_000
#: A word with its leading space, or white space: byte-level BPE never merges across these pieces.
PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Letters, then signs: two pieces of the vocabulary's own splitting rule.
LETTERS_SIGNS = re.compile(r"( ?[^\W\d_]+)?([^\w\s']+)?")
#: White space for Python, but not for the vocabulary's rule.
ODD_SPACES = re.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder(dict):
    """Little-endian unsigned 32-bit ids by piece of text."""

    def __init__(self, path: str, literal_specials: bool = False):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal_specials
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        added = () if literal_specials else (t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.specials = tuple(added)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        parts = LETTERS_SIGNS.fullmatch(piece)
        if parts and (parts[1] is None or parts[1].lstrip(" ").isalpha()):
            if parts[1] and parts[2]:
                value = self[parts[1]] + self[parts[2]]
            else:
                spelled = piece.encode().decode("latin-1").translate(self.letters)
                value = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        else:
            value = self.whole(piece)
        if len(self) < KEPT_WORDS:
            self[piece] = value
        return value

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text, the same as the tokenizer gives; null text has none."""
        if not text:
            return b""
        if ODD_SPACES.search(text) or any(s in text for s in self.specials):
            return self.whole(text)
        return b"".join(map(self.__getitem__, PIECE.findall(text)))


@cache
def encoder(path: str, literal_specials: bool = False) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path, literal_specials)
