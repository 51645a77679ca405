"""Ids of words as the tokenizer's library gives them, and packings found by evolution alone."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from linkspan.llm import packing
from linkspan.llm.common import tokenizer_file

NAME = "word_bpe_49k.json"


def test_every_letter_before_a_mark():
    """All letters and low signs but for ideographs and syllables: alone, in words, and before a full stop or comma."""
    own, library = packing.WordEncoder(tokenizer_file(NAME)), Tokenizer.from_file(tokenizer_file(NAME))
    skipped = (range(0x4E00, 0xA000), range(0xAC00, 0xD7A4), range(0xD800, 0xE000))
    wrong = []
    for c in range(0x20000):
        x = chr(c)
        if (x.isalpha() or c < 0x3000) and not any(c in r for r in skipped):
            text = f"a{x}. {x}, {x}a. {x} x{x}{x}, b"
            if own.ids(text) != np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes():
                wrong.append(hex(c))
    assert not wrong


@pytest.mark.parametrize(("low", "high", "gain"), [(900, 2100, 50), (1000, 1700, 100), (1, 4095, -3), (3, 400, 0)])
def test_crossover_alone_is_no_worse_than_best_fit(low, high, gain):
    """Two islands and two epochs from random orders; ``gain``: bins fewer than best fit of falling sizes, at least."""
    rng = random.Random(low)
    sizes = [rng.randint(low, high) for _ in range(4096)]
    falling = sorted(range(4096), key=lambda i: -sizes[i])
    elite = [packing.evolve(sizes, 4096, seed, [])[0] for seed in (1, 2)]
    best = min((packing.evolve(sizes, 4096, 3 + k, elite[::-1] if k else elite)[0] for k in (0, 1)), key=len)
    assert sorted(i for _, held in best for i in held) == list(range(4096))
    assert all(room == 4096 - sum(sizes[i] for i in held) >= 0 for room, held in best)
    assert len(best) <= len(packing.best_fit([], falling, sizes, 4096)) - gain
