import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import words as W

PATTERNS = {"SPACED": re.compile(rb"[^\x20\x09-\x0d]+"), "ALNUM": re.compile(rb"[0-9a-z\x80-\xff]+"), "LETTERS": re.compile(rb"[a-z\x80-\xff]+")}
texts = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAzZ09 \t\n\x0b.-é😀_"), max_size=40)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(texts, st.integers(1, 60))
def test_words_and_blocks(rows, most):
    seen = 0
    for lo, hi, data, off in W.blocks(pa.array(rows, pa.string()), most):
        assert lo == seen and (hi - lo == 1 or off[-1] <= most)
        seen = hi
        for kind, pattern in PATTERNS.items():
            w = W.Words(data, off, getattr(W, kind))
            got = [(int(d), bytes(w.data[a:b])) for d, a, b in zip(w.doc, w.start, w.end, strict=True)]
            want = [(i, m) for i in range(hi - lo) for m in pattern.findall(re.sub(rb"[A-Z]", lambda x: x[0].lower(), (rows[lo + i] or "").encode()))]
            assert got == want and w.count.tolist() == [sum(d == i for d, _ in want) for i in range(hi - lo)]
            assert (w.hashes() == W.hash_tokens([t for _, t in want])).all()
            assert (w.hashes(prefix=2) == W.hash_tokens([t[:2] for _, t in want])).all()
            assert (w.hashes(suffix=3) == W.hash_tokens([t[-3:] for _, t in want])).all()
    assert seen == len(rows)


def test_hashes_tell_words_apart():
    tokens = [str(i).encode() for i in range(200000)] + [b"x" * n for n in range(1, 2000)]
    assert len(set(W.hash_tokens(tokens).tolist())) == len(tokens)
    # pairs that collide under any polynomial modulo a power of two
    for bits in range(3, 14):
        parity = [bin(i).count("1") % 2 for i in range(1 << bits)]
        pair = [bytes(97 + b for b in parity), bytes(98 - b for b in parity)]
        assert len(set(W.hash_tokens(pair).tolist())) == 2


def test_words_of_several_classes():
    raw = np.frombuffer(b"Ab,cd ...x!", dtype=np.uint8)
    w = W.Words(raw, np.array([0, 4, len(raw)]), W.LETTERS_OR_MARKS, lower=False)
    assert [(int(d), bytes(raw[a:b])) for d, a, b in zip(w.doc, w.start, w.end, strict=True)] == [(0, b"Ab"), (0, b","), (0, b"c"), (1, b"d"), (1, b"..."), (1, b"x"), (1, b"!")]


def test_sliced_and_large_columns():
    column = pa.array(["a b", None, "", "c\nd", "e"]).slice(1, 3)
    for c in (column, column.cast(pa.large_string()), pa.chunked_array([column])):
        data, off = W.buffers(c)
        assert bytes(data) == b"c\nd" and off.tolist() == [0, 0, 0, 3]
    assert W.buffers(pa.array([], pa.string()))[1].tolist() == [0]
    keys, counts = W.merge_counts([(np.array([3, 1]), np.array([1, 2])), (np.array([3]), np.array([5]))])
    assert keys.tolist() == [1, 3] and counts.tolist() == [2, 6]
