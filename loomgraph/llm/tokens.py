"""Token ids by the tokenizers library, each distinct pre-token encoded once in a task.

The two vocabularies split a text before any merge happens, and a pre-token's ids don't depend on its neighbours. So the
ids of a text are the joined ids of its pre-tokens, and the library is asked only for pre-tokens not seen before. A text that spells
an added token (<|endoftext|>) goes to the library whole, which gives that token's id for it, and so does one with a character that
isn't assigned in Python's Unicode, which is older than the library's.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

#: Distinct pre-tokens held by a worker process, about 165 bytes each: the first, among which are the frequent ones.
HELD = 500_000

#: The white space of Unicode, as the library's patterns see it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: A text is split with the smallest alphabet that holds it, as a short character class is a fast one.
ALPHABETS = (0x7F, 0x24F, sys.maxunicode)


@lru_cache(3)
def _classes(last: int) -> tuple[str, str, str]:
    """The letters, the numbers and the unassigned characters of Python's Unicode up to a code point, as ranges for a character class."""
    found: dict[str, list[list[int]]] = {"L": [], "N": [], "Cn": []}
    for c in range(last + 1):
        kind = unicodedata.category(chr(c))
        if (runs := found.get(kind if kind == "Cn" else kind[0])) is not None:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return tuple("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found[k]) for k in ("L", "N", "Cn"))


class Pieces(dict):
    """The ids of pre-tokens seen so far, as little-endian unsigned 32-bit integers; ids(texts) gives those of whole texts.

    They are those of the library's encode_batch(texts, add_special_tokens=False). With special_as_text, the spelling of an added token
    in a text is ordinary text, so that no text can bring in an id with a meaning of its own.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [] if special_as_text else list(self.tokenizer.get_added_tokens_decoder().values())
        # those that are looked for in the normalised text could be spelled in other ways, too: then the library gets every text
        self.special = re.compile("" if any(t.normalized for t in added) else "|".join(re.escape(t.content) for t in added) or "(?!)").search
        self.merge = self.tokenizer.model.tokenize
        self.lower = self.tokenizer.normalizer is not None
        self.splits = [re.compile(self.pattern(*_classes(last)[:2])).findall for last in ALPHABETS]
        self.beyond = re.compile(f"[^\\x00-\\u{ALPHABETS[1]:04x}]").search
        # to the library, which may know a newer Unicode, they can be letters or numbers
        self.unknown = re.compile(f"[{_classes(ALPHABETS[2])[2]}]").search
        self.missed = 0
        self.letters = str.maketrans(dict(enumerate(_byte_letters())))

    def pattern(self, letters: str, numbers: str) -> str:
        tails = "'s|'t|'re|'ve|'m|'ll|'d"
        if self.lower:
            return f"{tails}|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+"
        return f"{tails}| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

    def split(self, text: str) -> list[str]:
        return self.splits[0 if text.isascii() else 2 if self.beyond(text) else 1](text)

    def normal(self, text: str) -> str:
        """The library lower-cases character by character, so a last sigma is an ordinary one."""
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def __missing__(self, piece: str) -> bytes:
        """The library's merges, on the letters by which it writes bytes."""
        found = array("I", [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()
        self.missed += 1
        if len(self) < HELD:
            self[piece] = found
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.missed > 5 * HELD:  # the texts have changed
            self.clear()
            self.missed = 0
        return [self._whole(t) if self.special(t) or not t.isascii() and self.beyond(t) and self.unknown(t) else b"".join(map(self.__getitem__, self.split(self.normal(t) if self.lower else t))) for t in texts]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def _byte_letters() -> list[str]:
    """Visible Latin-1 characters stand for themselves, the other bytes in turn for characters from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


@lru_cache(4)
def pieces(path: str, special_as_text: bool = False) -> Pieces:
    """One for each worker process, so that later tasks find what earlier ones have encoded."""
    return Pieces(path, special_as_text)
