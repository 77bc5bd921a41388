"""Words, window hashes and token ids against the plainest computation."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from plain_texts import words_of
from hypothesis import given, settings
from hypothesis import strategies as st

from tallmat.llm.tokens import Encoder, tokenizer_path
from tallmat.llm.words import Words, window_starts, windows

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\r\x0cabAB é😀'.0 ", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    found = Words(pa.array(texts, pa.string()))
    want = [w for t in texts for w in words_of(t)]
    assert [found.word(i).decode() for i in range(len(found))] == want
    assert found.counts.tolist() == [len(words_of(t)) for t in texts]
    hashes = found.hashes().tolist()
    assert len(set(hashes)) == len(set(want))
    assert len(set(zip(hashes, want))) == len(set(want))


def test_windows_depend_on_content_only():
    x = np.random.default_rng(0).integers(0, 5, 400).astype(np.uint64)
    h = windows(x, 3)
    keys = [tuple(x[i : i + 3].tolist()) for i in range(398)]
    assert len(set(zip(h.tolist(), keys))) == len(set(keys)) == len(set(h.tolist()))
    assert window_starts(np.array([0, 2, 2, 7]), 3).tolist() == [2, 3, 4]


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_token_ids(name, spaces):
    from tokenizers import Tokenizer

    path = tokenizer_path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = [
        None, "", " ", "  a b", "a  b", "a\n b", "a \nb", "a\n \nb", "a\n\n b  ", "x ", "\tq\t \t w", "don't it's", "<|endoftext|> a",
        "ΑΣ ΑΣΑ σ́", "é ́x", "a\r\n b\x0bc \x1c d", "𝒳 y 😀 z", "\x01 \x01 x\x01", "word " * 3000,
    ]
    encoder = Encoder(path, spaces)
    for part in (texts, texts[::-1]):
        ids, counts = encoder.encode(pa.array(part, pa.string()))
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in part]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_known_stretches_take_little_memory():
    """A task may remember a million of them, in two Python workers of an executor."""
    encoder = Encoder(tokenizer_path("byte_bpe_50k.json"), True)
    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(200)) for i in range(300)])
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    encoder.encode(texts)
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    # 59,700 stretches that follow a space, with their ids
    assert held < 100 * 59_700
