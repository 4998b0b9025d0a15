import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelflow.llm import textkit as tk

TOKEN = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8), st.integers(1, 30))
def test_tokens_are_those_of_the_pattern(texts, most):
    low = tk.lowered(pa.array(texts, pa.string()))
    got = []
    for i, j, buf, offs in tk.chunked(low, most):
        s, e, first, h = tk.tokens(buf, offs)
        raw = [bytes(buf[a:b]).decode() for a, b in zip(s, e)]
        assert h.tolist() == (tk.word_hash(*raw) if raw else [])
        got += [raw[first[r] : first[r + 1]] for r in range(j - i)]
    assert got == [TOKEN.findall(x) for x in low.to_pylist()]


def test_hashes_tell_words_apart():
    w = [f"w{i}" for i in range(20_000)]
    assert len(set(tk.word_hash(*w))) == len(w)


def test_grams_agree_with_their_tokens():
    h = np.random.default_rng(0).integers(0, 5, 300).astype(np.uint64)
    g = tk.Grams(tk.mix(h)).of(4)
    for i in range(0, 290, 7):
        for j in range(0, 290, 5):
            assert (g[i] == g[j]) == (h[i : i + 4] == h[j : j + 4]).all()


def test_long_token_and_long_row():
    buf = np.frombuffer(b"a" * 3_000_000 + b" b", np.uint8)
    s, e, first, h = tk.tokens(buf, np.array([0, len(buf)]))
    assert list(e - s) == [3_000_000, 1] and len(set(h.tolist())) == 2
