"""Token ids of whole texts under a byte-level BPE vocabulary, as the tokenizers library gives them.

A text is cut by the vocabulary's own pattern and each distinct piece of a task is encoded once, so
the cost of long corpora is that of cutting and looking up. Strings of special tokens count as
ordinary text.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array

import tiktoken
from tokenizers import Tokenizer

#: Pieces whose ids a task remembers; beyond that it forgets all and starts anew.
REMEMBERED_PIECES = 500_000
#: Texts of characters below this are cut by a pattern with explicit classes.
PLAIN_BELOW = 0x250


def _class(test) -> str:
    return "".join(f"\\u{c:04x}" for c in range(PLAIN_BELOW) if test(chr(c)))


_LETTERS = _class(lambda c: unicodedata.category(c)[0] == "L")
_NUMBERS = _class(lambda c: unicodedata.category(c)[0] == "N")
_BLANKS = _class(lambda c: c in "\t\n\x0b\x0c\r \x85\xa0")
PLAIN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+"
    f"|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
)
_OTHER = re.compile(f"[^\\u0000-\\u{PLAIN_BELOW - 1:04x}]")


class Encoder(dict):
    """Ids of a piece as little-endian 32-bit numbers, by piece; computed when first asked for.

    Ids of the vocabulary are in order of its merges, so a piece can be merged by id alone.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        described = json.loads(self.tokenizer.to_str())
        special = {t["content"] for t in described["added_tokens"]}
        byte = {letter: b for b, letter in _byte_letters().items()}
        ranks = {
            bytes(byte[c] for c in token): i
            for token, i in described["model"]["vocab"].items() if token not in special
        }
        self.merged = tiktoken.Encoding("pieces", pat_str=".+", mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED_PIECES:
            self.clear()
        self[piece] = ids = array("I", self.merged._encode_single_piece(piece)).tobytes()
        return ids

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def text(self, text: str) -> bytes:
        """Ids of a whole text, four bytes each."""
        if _OTHER.search(text):
            return self.library(text)
        return b"".join(map(self.__getitem__, PLAIN.findall(text)))


def _byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in a byte-level vocabulary."""
    seen = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b not in (0xA0, 0xAD)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)
