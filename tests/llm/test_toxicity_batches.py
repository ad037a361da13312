"""Texts scored many at once: the same as one by one and as all likenesses compared, whether few or most blocks are read."""

import numpy as np
import pytest

from quillmer.llm import toxicity


@pytest.mark.parametrize("spread", [1, 40])
def test_many_texts_at_once_equal_all_likenesses(spread):
    r = np.random.default_rng(spread)
    n, words = 700, 900
    # With a small spread an example holds neighbouring words only, so few blocks can hold a neighbour.
    held = [np.unique(np.append(r.integers(0, 30, 6), np.clip(30 + i + r.integers(-spread * 15, spread * 15 + 1, 12), 30, words - 1))) for i in range(n)]
    row, term = np.repeat(np.arange(n), [len(h) for h in held]), np.concatenate(held)
    count, scale = r.integers(1, 5, len(term)), r.random(words) + 0.5
    index = toxicity.BlockMaxIndex.build(list(range(n)), r.integers(0, 2, n).astype(float), row, term, count, scale)
    full = np.zeros((n, words))
    full[row, term] = (1 + np.log(count)) * scale[term]
    full /= np.sqrt((full * full).sum(1))[:, None]
    many = [(term[row == i], count[row == i]) for i in range(0, n, 9)]
    for x, ready in zip(many, index.ready(many), strict=True):
        q = np.zeros(words)
        q[x[0]] = toxicity.unit(*x, scale)
        want = np.round(full @ q, 12)
        like, near = index.nearest(x[0], *ready, 15)
        assert np.allclose(like, np.sort(want)[::-1][:15], atol=1e-10) and np.allclose([want[index.ids[i]] for i in near], like, atol=1e-10)
        assert index.score(*x, 15, 0.5) == index.score(*x, 15, 0.5, ready)


def test_a_batch_without_terms_and_an_index_without_examples():
    none = np.zeros(0, np.int64)
    index = toxicity.BlockMaxIndex.build([], np.zeros(0), none, none, none, np.zeros(0))
    ready = index.ready([(none, none), (none, none)])
    assert len(ready) == 2 and index.score(none, none, 15, 0.5, ready[0]) == (0.0, [])
