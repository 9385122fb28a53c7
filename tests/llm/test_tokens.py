"""The word tokenizer against the library, and the salts of repeated keys."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pairloom.llm import packing
from pairloom.llm.substring import _spread

FILE = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_those_of_the_library(monkeypatch):
    whole, rng = Tokenizer.from_file(FILE), random.Random(3)
    texts = ["", " ", "ÀÉÎ don't 12ab ß ÿÞ", "ΑΣ Σ ς", "a\x1cb c", "x\xa0y", "İstanbul <|startoftext|> a", "é café", "'S 'll it's", "×÷ µ ª º ñ", "«foo» “bar”…", "日本語 テスト", "ſ ŉ ĳ", "a" * 5000]
    letters = [*map(chr, range(33, 127)), *map(chr, range(0xA0, 0x180)), *" \t\n'" * 20]
    texts += ["".join(rng.choices(letters, k=60)) for _ in range(500)]
    for chunk, runs in ((1 << 20, 150_000), (20, 40)):
        monkeypatch.setattr(packing, "CHUNK", chunk)
        monkeypatch.setattr(packing, "CACHE_RUNS", runs)
        tok = packing.WordTokenizer(FILE)
        for t in texts:
            assert tok.text(t) == np.asarray(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)
    assert tok.text(None) == b""


def test_one_row_a_batch_meets_the_others_of_its_key():
    key, o, at = np.array([5, 5, 5, 7, 5, 5]), np.array([3, 1, 1, 1, 1, 1]), np.array([0, 4, 9, 4, 4, 4])
    tag = np.array([0, 1, 1, 1, 1, 2])
    on, salt, size = _spread([key], o, (at << 32) | tag)
    rows = sorted(zip(key[on].tolist(), o[on].tolist(), at[on].tolist(), tag[on].tolist(), (salt > 0).tolist(), size.tolist(), strict=True))
    # Alike rows go on once; rows of one doc_id, position and other texts tie; later ones are sure.
    assert rows == [(5, 1, 4, 1, False, 4), (5, 1, 4, 2, False, 4), (5, 1, 9, 1, True, 4), (5, 3, 0, 0, True, 4), (7, 1, 4, 1, False, 1)]
    assert [len(x) for x in _spread([key[:0]], o[:0], at[:0])] == [0, 0, 0]
