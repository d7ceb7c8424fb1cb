"""Cached encoding against the tokenizers library on whole texts."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm.tokenizing import PieceEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
MADE = {f: (Tokenizer.from_file(public_tokenizers.path(f)), PieceEncoder(public_tokenizers.path(f), k, 40, 60)) for f, k in FILES.items()}
TEXTS = ["", " ", "a", " a", "a ", "a  b", "a \n b", "a\nb", "\n\na b\t c", "It's we'll I'D they've", "naïve Éa ÉA é x ́", "日本 語 text", "<|endoftext|> a <|endoftext|>b", "a\x1cb \x1d c", "x y z w", "ΑΣ Σ ΑΣ.", "İstanbul ıI", "1234 5 6,7", "a" * 3000, "  lead", "trail  ", "!!? ...a.b", "ſt ǅ µ ß ŉ", "\r\n a\r b", "'s 't", "a 's"]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("text", TEXTS)
def test_fixed(name, text):
    t, e = MADE[name]
    for _ in range(2):
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list("aAbé .,'\n\t s12<|\x1c ́Σσ")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any(text):
    for t, e in MADE.values():
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
