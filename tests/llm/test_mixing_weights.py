"""A document refines the weights of each gate, over short blocks, for tokens and spelled words alike."""

import numpy as np
import pyarrow as pa

from catalens.llm import lmscore
from catalens.llm.tokens import Tokens


def test_gates_learn_apart_in_short_documents():
    r = np.random.default_rng(1)
    n = 1500
    gate, bits = r.integers(0, 2, n).astype(np.uint8), r.integers(0, 2, n).astype(np.float32)
    # The second predictor is right under gate 0 and wrong under gate 1.
    x = np.zeros((3, n), np.float32)
    x[1] = 32 * (2 * bits - 1) * np.where(gate == 0, 1, -1)
    weights = np.zeros((2, 3), np.float32)
    fixed = n * np.log(2)
    assert lmscore.mix(x, bits, gate, np.array([n]), weights)[0] < 0.9 * fixed
    # Documents do not learn from each other, whatever their order and length.
    lengths = np.array([100, 900, 0, 500])
    cuts = np.cumsum(lengths) - lengths
    alone = [lmscore.mix(x[:, a : a + m], bits[a : a + m], gate[a : a + m], np.array([m]), weights)[0] for a, m in zip(cuts, lengths, strict=True)]
    assert np.allclose(lmscore.mix(x, bits, gate, lengths, weights), alone)


def test_spelled_words_refine_the_byte_weights():
    letters = np.ones(257, np.int64)
    model = lmscore.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1, letters)
    model.states = [np.zeros(1 << b, np.int8) for b in (*lmscore.TOKEN_BITS, *lmscore.BYTE_BITS)]
    # What the byte contexts hold is always wrong, so weights that learn fall and the later words cost less.
    _, path, slots, _ = model.byte_slots([b"abcdefgh"])
    for k, s in enumerate(slots):
        model.states[2 + k][s] = np.where(path & 1, -60, 60)
    tokens = Tokens(pa.array(["abcdefgh", " ".join(["abcdefgh"] * 40)]))
    symbols = model.symbols(tokens.hashes)
    once, often = lmscore._spelling(model, tokens, symbols[tokens.index])
    end = lmscore._spelling(model, Tokens(pa.array([""])), np.full(1, model.escape))[0]
    assert often - end < 0.9 * 40 * (once - end)
