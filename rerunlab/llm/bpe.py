"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton starts as one state with an arc for each byte. Each merge (a, b) -> ab,
taken in order, adds a gadget: wherever an arc a leads to the state after a, an arc
ab now leads on to where b led from there, and the state after a is replaced by a
copy without b. What is left accepts one sequence of tokens for each string: the one
that merging gives. The state after a token is set by the token alone, so a gadget
is two entries: the arc ``made`` with its two halves, and the arc ``cut`` from the
state after a. A state's arcs follow from those of the states it was copied from, as
they stood when copied; there are too many (tokens times tokens) to write all down, so an
arc's presence is entered in a table when first asked for.

Words are read by a second table, compiled once: transitions by byte over the beginnings of
all labels, with the state to fall back to and, for each state, the arcs whose labels
end there, longest first. Reading a pre-split word takes one transition a byte; after
each byte the automaton is in the state of the one token that ends the prefix's encoding:
the first of the arcs ending there that leaves the state of the prefix before it. Decoding
emits the arcs' labels, bytes.

Defined results: a null text counts as empty and gives no ids. Strings of special
tokens in a text become their ids. Bytes that do not form UTF-8 decode to U+FFFD.
Repeated rows are encoded each for itself. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .vocab import BYTE_BPE, byte_letters, character_class, latin, load

#: Bytes of words with their ids, and arcs, a worker remembers before it starts anew;
#: longer words are not remembered.
WORD_BYTES, ARCS, LONGEST = 112 << 20, 2_000_000, 100
START = -1


class Automaton:
    """The tokenization automaton of a list of merges."""

    def __init__(self, base: dict[bytes, int], merges: list[tuple[bytes, bytes]], ids: dict[bytes, int]):
        self.arcs: dict[bytes, int] = dict(base)
        self.made: dict[int, tuple[int, int, int]] = {}
        self.cut: dict[int, int] = {}
        for step, (a, b) in enumerate(merges):
            if a in self.arcs and b in self.arcs:  # else no path leads there
                self._gadget(step, self.arcs[a], self.arcs[b], a + b, ids[a + b])
        self.labels = {i: label for label, i in self.arcs.items()}
        self.table: dict[int, bool] = {}  # presence of the arcs asked for so far
        self._compile()

    def _gadget(self, step: int, a: int, b: int, label: bytes, made: int) -> None:
        """Arc ``made`` runs beside a then b; the state after a loses arc b."""
        if label not in self.arcs and self._row(a, b):
            self.arcs[label] = made
            self.made[made] = (a, b, step)
        self.cut.setdefault(a << 20 | b, step)

    def _copies(self, token: int) -> list[tuple[int, int]]:
        """The states that the state after ``token`` was copied from, with the step up to
        which their cuts were copied."""
        out, until = [(token, 1 << 60)], 1 << 60
        while (parts := self.made.get(token)) is not None:
            token, until = parts[1], min(until, parts[2])
            out.append((token, until))
        return out

    def allows(self, state: int, token: int) -> bool:
        """Whether an arc ``token`` leaves the state after ``state``."""
        if state == START:
            return True
        key = state << 20 | token
        found = self.table.get(key)
        if found is None:
            found = self._row(state, token)
            if len(self.table) >= ARCS:
                self.table.clear()
            self.table[key] = found
        return found

    def _row(self, state: int, token: int) -> bool:
        """An arc is there if neither it nor, when it was made, the arc that it was made
        beside had been cut from the state."""
        copies, until = self._copies(state), 1 << 60
        while True:
            for origin, before in copies:
                step = self.cut.get(origin << 20 | token)
                if step is not None and step < before and step <= until:
                    return False
            parts = self.made.get(token)
            if parts is None:
                return True
            token, until = parts[0], min(until, parts[2])

    def _compile(self) -> None:
        """``moves`` (state and byte to state), ``back`` (the state of the longest beginning of
        a label that ends a state's string) and ``ends`` (token and length of the labels
        that do, longest first)."""
        moves: dict[int, int] = {}
        back, ends, depth = [0], [()], [0]
        own: dict[int, int] = {}
        for label, token in self.arcs.items():
            at = 0
            for b in label:
                to = moves.get(at << 8 | b)
                if to is None:
                    to = moves[at << 8 | b] = len(depth)
                    depth.append(depth[at] + 1)
                at = to
            own[at] = token
        back += [0] * (len(depth) - 1)
        ends += [()] * (len(depth) - 1)
        for key, to in sorted(moves.items(), key=lambda m: depth[m[1]]):  # shorter strings first
            at, b = key >> 8, key & 0xFF
            fall = back[at]
            while at and (fall << 8 | b) not in moves and fall:
                fall = back[fall]
            back[to] = moves.get(fall << 8 | b, 0) if at else 0
            ends[to] = ends[back[to]]
            if to in own:
                ends[to] = ((own[to], depth[to]), *ends[to])
        self.moves, self.back, self.ends = moves, back, ends

    def run(self, word: bytes) -> list[int]:
        """The tokens of the one accepted path that spells ``word``."""
        moves, back, ends, table, allows = self.moves, self.back, self.ends, self.table, self.allows
        state, length, at, i = [START], [0], 0, 0
        for b in word:
            i += 1
            to = moves.get(at << 8 | b)
            while to is None:
                if not at:
                    raise ValueError("no path spells this word")
                at = back[at]
                to = moves.get(at << 8 | b)
            at = to
            for token, n in ends[at]:
                if n == i or table.get(key := state[i - n] << 20 | token) or key not in table and allows(state[i - n], token):
                    state.append(token)
                    length.append(n)
                    break
            else:
                raise ValueError("no path spells this word")
        out, i = [], len(word)
        while i:
            out.append(state[i])
            i -= length[i]
        return out[::-1]


class Coder:
    """Encoder and decoder for a byte-level vocabulary file."""

    def __init__(self, name_or_path: str = BYTE_BPE):
        spec, path = load(name_or_path)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.automaton = Automaton({raw(c): ids[raw(c)] for c in letters}, [(raw(a), raw(b)) for a, b in pairs], ids)
        self.labels = [b""] * (1 + max(max(ids.values()), *self.special.values(), 0))
        for i, label in self.automaton.labels.items():
            self.labels[i] = label
        for text, i in self.special.items():
            self.labels[i] = text.encode()
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.narrow, self.wide, self.path = re.compile(self._pattern(0x100)), None, path
        self.words: dict[str, bytes] = {}
        self.remembered = 0  # bytes

    def _pattern(self, limit: int, more: dict[str, str] | None = None) -> str:
        """Words: contractions, then runs of letters, numbers or other characters with a
        blank before them, then white space; the last blank goes with the next word."""
        more = more or {}

        def of(kind):
            return character_class(lambda c: ord(c) < limit and (unicodedata.category(c)[0] == kind or more.get(c) == kind))

        letter, number = of("L"), of("N")
        space = character_class(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f")
        return f" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"

    def _wide(self) -> re.Pattern:
        """For characters past Latin-1. The kind of those that this Python does not know
        is taken from the library's own splitter."""
        if self.wide is None:
            import regex
            from tokenizers import Tokenizer

            split = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
            new = [c for c in map(chr, range(0x370, 0x110000)) if not 0xD800 <= ord(c) <= 0xDFFF and unicodedata.category(c) == "Cn" and regex.match(r"[\p{L}\p{N}]", c)]
            kinds = {}
            for c in new:
                first = split(f"a{c}1")[0][1][1]
                kinds[c] = "L" if first == 2 else "N" if len(split(f"a{c}1")) == 2 else ""
            self.wide = re.compile(self._pattern(0x110000, kinds))
        return self.wide

    def split(self, text: str) -> list[str]:
        return (self.narrow if latin(text) else self._wide()).findall(text)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.split_special and any(s in text for s in self.special):
            parts = self.split_special.split(text)
            return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in parts)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        words, run = self.words, self.automaton.run
        found = self.split(text)
        missing = set(found).difference(words)
        for w in missing:
            ids = run(w.encode())
            words[w] = struct.pack(f"<{len(ids)}I", *ids)
        out = b"".join(map(words.__getitem__, found))
        for w in missing:
            if len(w) > LONGEST:
                del words[w]
            else:
                self.remembered += 2 * len(w) + len(words[w]) + 150  # with the entry's own bytes
        if self.remembered > WORD_BYTES:
            words.clear()
            self.remembered = 0
        return out

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 bytes of the text that the ids' labels spell."""
        out = b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            out.decode()
        except UnicodeDecodeError:
            return out.decode(errors="replace").encode()
        return out


@lru_cache
def coder(name_or_path: str = BYTE_BPE) -> Coder:
    return Coder(name_or_path)


def encoded(docs: DataFrame, vocabulary: str = BYTE_BPE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([c.decode(i).decode() for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, vocabulary: str = BYTE_BPE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = c.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
