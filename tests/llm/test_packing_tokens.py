"""The token step of the packing: ids equal to those of whole texts, and Python's work goes with the distinct words."""

import random
import sys
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stowage.llm import packing as PK

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_work_in_python_goes_with_distinct_words():
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("etaoinshr", k=8)) for _ in range(2000)})
    runs = [w + m for w in chain(words, map(str.capitalize, words), map(str.upper, words)) for m in ("", ",", ".", "!", "?", ";", ":", "...")]
    memo, events = PK._Memo(PATH), 0

    def seen(frame, event, arg):
        nonlocal events
        events += event in ("call", "c_call")

    texts = pa.array([" ".join(runs)])
    sys.setprofile(seen)
    try:
        ids = next(PK.token_ids(texts, memo))
    finally:
        sys.setprofile(None)
    assert events < len(runs)
    assert ids.tolist() == Tokenizer.from_file(PATH).encode(texts[0].as_py(), add_special_tokens=False).ids


def test_other_runs_are_encoded_many_at_once(monkeypatch):
    memo, calls = PK._Memo(PATH), 0
    tokenizer = memo.tokenizer

    class Counted:
        def __getattr__(self, name):
            nonlocal calls
            calls += 1
            return getattr(tokenizer, name)

    memo.tokenizer = Counted()
    text = " ".join(f"x-{i}" for i in range(2000))
    assert next(PK.token_ids(pa.array([text]), memo)).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert calls < 20


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("bytes_known", [0, 1 << 20])
def test_ids_of_odd_texts(monkeypatch, kind, bytes_known):
    monkeypatch.setattr(PK, "MEMO_BYTES", bytes_known)
    rng, tokenizer, memo = random.Random(7), Tokenizer.from_file(PATH), PK._Memo(PATH)
    low = [chr(i) for i in range(0x140)]  # every character about where plain words end, and all blanks and marks
    odd = [" ", "  ", "\n", "\t\r\n", "\x0b", "\x0c", "\x85", " ", " ", "'s", "it's", "...", "#1", "a,b", "<|endoftext|>", "é", "́", "ΑΣ", "İ", "ß", "ŉ", "漢字", "ab", "Ab", "AB.", "12", "\U0001f600", "﻿", "\x00"]
    rows = [None, "", " ", "\n\n", "end", "x " * 5000, "漢" * 3000, *low, *(c + "." for c in low), *(f"a{c}b {c}" for c in low), *("".join(rng.choices(low + 9 * odd, k=rng.randrange(60))) for _ in range(1500)), None, ""]
    for lo in range(0, len(rows), 400):
        part = rows[lo : lo + 400]
        for texts in (pa.array(part, kind), pa.array([*rows[:9], *part, "after"], kind).slice(9, len(part))):
            got = list(PK.token_ids(texts, memo))
            assert [x.tolist() for x in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
            assert all(x.dtype == np.dtype("<u4") for x in got)
    for texts in ([None], ["", None], [""] * 3):
        assert [len(x) for x in PK.token_ids(pa.array(texts, kind), memo)] == [0] * len(texts)
    assert list(PK.token_ids(pa.array([], kind), memo)) == []
