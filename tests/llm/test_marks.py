"""Combining marks through the word encoder."""

from __future__ import annotations

import random
import unicodedata

import numpy as np
from rerunlab.llm import vocab


def test_pairs_of_marks_equal_the_library():
    e, r = vocab.word_encoder(), random.Random(1)
    marks = [chr(c) for c in range(0x100, 0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.combining(chr(c))]
    starters = ["a", "E", "ü", "한", "ǅ", "क", "ᄀ", "ᅡ", "ẛ", "Å"]
    texts = ["ạ࣋"]
    for c in marks:
        for _ in range(25):
            m = r.choice(marks)
            texts.append(r.choice(starters) + r.choice([c + m, m + c, c + m + r.choice(marks)]))
    texts += ["".join(r.choice(marks if r.random() < 0.6 else starters) for _ in range(r.randint(2, 8))) for _ in range(20_000)]
    texts += [unicodedata.normalize("NFD", chr(c)) + m for c in range(0xC0, 0x2000) if unicodedata.decomposition(chr(c)) for m in ("", "̣", "́")]
    for t, want in zip(texts, e.library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.array_equal(e.ids(t), np.array(want.ids, np.uint32)), [hex(ord(c)) for c in t]
    assert sum(vocab.unsure().search(c) is not None for c in marks) < 200  # the others stay fast
