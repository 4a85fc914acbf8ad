"""Fast encoders for public tokenizer files, giving the ids that the tokenizers
library gives.

The library's own encoder reads 1.6 million characters a CPU second, slower than the
limits allow, so merging is done by tiktoken over a rank table compiled from the same
file. Texts on which the two could differ (a special token's string, a character
that this Python's Unicode tables do not know, a word-final capital sigma, the
terminator character, a mark or composed character that the library's normaliser treats
in another way than Python's) are encoded by the library itself.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer, normalizers

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Closes each word for the merges that end words; never inside a word.
END = "\x00"


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def character_class(test) -> str:
    """The characters that pass ``test`` as ranges for a regular expression's brackets."""
    found, start = [], None
    for code in [*range(0xD800), *range(0xE000, sys.maxunicode + 1), None]:
        inside = code is not None and test(chr(code))
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            last = (code if code is not None else sys.maxunicode + 1) - 1
            found.append(f"\\U{start:08x}-\\U{last:08x}")
            start = None
    return "".join(found)



@lru_cache
def unassigned() -> re.Pattern:
    """Characters this Python knows no category for; other libraries may know it."""
    return re.compile(f"[{character_class(lambda c: unicodedata.category(c) == 'Cn')}]")


@lru_cache
def unsure() -> re.Pattern:
    """Unassigned characters and those that the library normalises in another way."""
    return re.compile(f"[{unassigned().pattern[1:-1]}{re.escape(unlike())}]")


@lru_cache
def unlike() -> str:
    """The characters that the library's NFC treats in another way than Python's: marks that
    it orders differently beside four old marks or the first mark that it does not of some
    class, and characters that it composes or decomposes differently."""
    library = normalizers.NFC().normalize_str

    def differ(text: str) -> bool:
        return library(text) != unicodedata.normalize("NFC", text)

    every = [chr(c) for c in range(0x100, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    marks, first = [c for c in every if unicodedata.combining(c)], {}

    def odd(mark: str, beside) -> bool:
        return any(differ(f"a{mark}{m}") or differ(f"a{m}{mark}") for m in beside)

    found = [c for c in marks if odd(c, "\u0301\u0323\u0334\u0345")]
    rest = [c for c in marks if c not in set(found)]
    for c in rest:
        first.setdefault(unicodedata.combining(c), c)
    found += [c for c in rest if odd(c, first.values())]
    found += [c for c in every if unicodedata.decomposition(c) and (differ(c) or differ(unicodedata.normalize("NFD", c)))]
    return "".join(found)


def latin(text: str) -> bool:
    """Whether all characters are Latin-1, where every Unicode version agrees."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def load(name_or_path: str) -> tuple[dict, str]:
    path = name_or_path if "/" in name_or_path else public_tokenizers.path(name_or_path)
    with open(path, encoding="utf-8") as f:
        return json.load(f), path


class Encoder:
    """ids(text) -> uint32 array."""

    def __init__(self, name_or_path: str):
        self.spec, path = load(name_or_path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in self.spec["added_tokens"]]

    def slow(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def plain(self, text: str) -> bool:
        return not any(s in text for s in self.special) and (latin(text) or not unassigned().search(text))


class ByteEncoder(Encoder):
    """Byte-level BPE whose ids follow the order of its merges."""

    def __init__(self, name_or_path: str = BYTE_BPE):
        super().__init__(name_or_path)
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in self.spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if not self.plain(text):
            return self.slow(text)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


class WordEncoder(Encoder):
    """BPE with word ends, over lower-cased NFC words; white space is dropped."""

    def __init__(self, name_or_path: str = WORD_BPE):
        super().__init__(name_or_path)
        letters, vocab = byte_letters(), self.spec["model"]["vocab"]
        suffix = self.spec["model"]["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            body = token.removesuffix(suffix)
            return bytes(letters[c] for c in body) + END.encode() * (len(body) < len(token))

        base = [vocab[c] for c in letters] + [vocab[c + suffix] for c in letters]
        merges = [m if isinstance(m, list) else m.split(" ") for m in self.spec["model"]["merges"]]
        order = [c for c in letters] + [c + suffix for c in letters] + [a + b for a, b in merges]
        ranks: dict[bytes, int] = {}
        target = []
        for token in order:
            if raw(token) not in ranks:
                ranks[raw(token)] = len(target)
                target.append(vocab[token])
        assert base == target[: len(base)]
        self.target = np.array(target, np.uint32)
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})
        contractions = "'s|'t|'re|'ve|'m|'ll|'d"
        self.latin = re.compile(self._pattern(contractions, 0x100))
        self.any = None
        self.contractions = contractions

    @staticmethod
    def _pattern(contractions: str, limit: int) -> str:
        def of(kind):
            return character_class(lambda c: ord(c) < limit and unicodedata.category(c)[0] == kind)

        space = character_class(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f")
        letter, number = of("L"), of("N")
        return f"{contractions}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+"

    def words(self, text: str) -> list[str]:
        norm = unicodedata.normalize("NFC", text).lower()
        if latin(norm):
            return self.latin.findall(norm)
        self.any = self.any or re.compile(self._pattern(self.contractions, sys.maxunicode + 1))
        return self.any.findall(norm)

    def ids(self, text: str) -> np.ndarray:
        if END in text or "Σ" in text or not self.plain(text) or not latin(text) and unsure().search(text):
            return self.slow(text)
        found = self.words(text)
        if not found:
            return np.zeros(0, np.uint32)
        return self.target[self.fast.encode_ordinary(END.join(found) + END)]


@lru_cache
def byte_encoder(name_or_path: str = BYTE_BPE) -> ByteEncoder:
    return ByteEncoder(name_or_path)


@lru_cache
def word_encoder(name_or_path: str = WORD_BPE) -> WordEncoder:
    return WordEncoder(name_or_path)
