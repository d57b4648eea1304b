from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from kindred.llm import toxicity


def subsequences(word, decay):
    """By hand: the weights of all subsequences of four letters that stretch over at most seven."""
    out = Counter()
    for at in combinations(range(len(word)), 4):
        if at[-1] - at[0] < toxicity.STRETCH:
            out[tuple(word[i] for i in at)] += decay ** (at[-1] - at[0] + 1)
    return out


def test_kernel_equals_enumeration():
    rng = np.random.default_rng(4)
    words = [[0, *rng.integers(1, 5, n).tolist(), 0] for n in (2, 3, 5, 8, 12, 12, 1, 0, 30)]
    code, first = np.concatenate([np.array(w, np.int32) for w in words]), np.concatenate([[0], np.cumsum([len(w) for w in words])])
    marks = toxicity._take(code, first, np.arange(2, 6))
    got = toxicity._kernel((code, first), toxicity._features(marks, 0.8), 0.8)
    norm = toxicity.norms(first, 0.8)
    for i, a in enumerate(words):
        for j, b in enumerate(words[2:6]):
            x, y = subsequences(a, 0.8), subsequences(b, 0.8)
            assert got[i, j] == pytest.approx(sum(v * y[k] for k, v in x.items()) / norm[i] / norm[j + 2], abs=1e-5)


def learnt():
    rng = np.random.default_rng(1)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    clean = [" ".join(word() for _ in range(20)) for _ in range(300)]
    toxic = [" ".join([*(word() for _ in range(19)), w]) for w in ("vexjuck", "zwilch", "quoxity") * 20]
    return clean, toxic


def test_op2_all_clean_spans_count_and_ties_repeats_and_long_texts_do():
    clean, toxic = learnt()
    model = toxicity.train(clean + toxic, [False] * len(clean) + [True] * len(toxic), landmarks=100)
    import pyarrow as pa

    flag = lambda t: toxicity.document_scores(pa.array(t, pa.string()), model) > model.threshold
    assert not flag(clean).any() and flag(toxic).all()
    # Twice the same rows in another order: the same verdicts.
    again = toxicity.train(toxic + clean + clean, [True] * len(toxic) + [False] * 2 * len(clean), landmarks=100)
    scores = toxicity.document_scores(pa.array(clean + toxic), again) > again.threshold
    assert scores.tolist() == [False] * len(clean) + [True] * len(toxic)
    assert flag([None, "", " ", "bada " * 100000, "bada " * 100000 + "zwiilch", "v.e.x.j.u.c.k", "zw il ch"]).tolist() == [False] * 4 + [True, True, False]
    assert flag(["zwi" + c + "lch" for c in "abcdefghijklmnopqrstuvwxyz"]).mean() > 0.8


def test_op2_without_both_kinds_of_label():
    clean, toxic = learnt()
    for texts, y in (([], []), (clean, [False] * len(clean)), (toxic, [True] * len(toxic))):
        assert toxicity.train(texts, y).threshold == np.inf
