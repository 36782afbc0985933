"""The backtracking encoder against the library, beyond ordinary texts."""

import random
import sys
import time
import unicodedata

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from rankloom.llm.bpe import encoder

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, texts):
    coder = encoder(PATH)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, ascii(text)
        assert coder.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False), ascii(text)


def test_every_code_point_in_context(library):
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    same(library, [f"a{chr(c)}B" for c in points] + [f"x {chr(c)} y{chr(c)}" for c in points[::7]])


def test_strings_of_combining_marks(library):
    marks = [chr(c) for c in range(sys.maxunicode) if unicodedata.combining(chr(c))]
    r = random.Random(1)
    same(library, ["e" + "".join(r.choices(marks, k=3)) for _ in range(20_000)])
    same(library, ["".join(r.choices(marks, k=3)) for _ in range(5_000)])


def test_odd_spaces_and_special_strings(library):
    signs = ["\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", "\x00", "\x01", " ", "\n", "Σ", "ς", "İ", "ǅ", "ﬁ", "a", "'S", "'ll", "7", "٣", "_", "<|endoftext|>", "<|startoftext|>", "日本", "😀", "é"]
    r = random.Random(2)
    same(library, ["".join(r.choices(signs, k=r.randint(1, 12))) for _ in range(20_000)])


def test_long_words_take_linear_time(library):
    r = random.Random(3)
    coder = encoder(PATH)
    took = []
    for n in (80_000, 320_000):
        word = "".join(r.choices("abcdeéz", k=n))
        began = time.process_time()
        ids = coder.encode(word)
        took.append(time.process_time() - began)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
    assert took[1] < 12 * max(took[0], 0.05)
    for word in ("a" * 100_000, "ab" * 50_000, "!" * 50_000, "́" * 5_000):
        same(library, [word])
