import random

import pytest

from kindred.llm import blocks, suffix_array
from kindred.llm.blocks import pack_columns, unpack_columns
from kindred.shared import Shared


@pytest.mark.parametrize("base", [20, 100_000])
def test_ranks_are_the_order_of_all_suffixes(spark, base, monkeypatch):
    """DC3 over texts of several blocks, level by level down to `base` symbols, against sorting."""
    monkeypatch.setattr(suffix_array, "BASE", base)
    monkeypatch.setattr(blocks, "WORKER_KEYS", 60)
    rng = random.Random(5)
    ends = iter(range(1, 1000))
    rows, suffixes = [], []
    for block in range(4):
        texts = []
        for _ in range(rng.randint(1, 6)):
            words = [rng.randint(1000, 1003) for _ in range(rng.randint(0, 40))]
            if rng.random() < 0.5 and suffixes:
                words += words[:]
            texts.append([*words, next(ends)])
        rows.append((block, b"", pack_columns(_u([len(t) for t in texts])), pack_columns(_u([s for t in texts for s in t])), len(texts), sum(map(len, texts))))
        at = 0
        for t in texts:
            suffixes += [(tuple(t[i:]), block, at + i) for i in range(len(t))]
            at += len(t)
    state = spark.createDataFrame([(b, bytearray(t), bytearray(x), bytearray(s), n, m) for b, t, x, s, n, m in rows], suffix_array.STATE)
    work = Shared(spark, "ranks")
    ranks = {r["block"]: unpack_columns(bytes(r["ranks"]), 1)[0].tolist() for r in suffix_array.suffix_ranks(work, work.written(state, "state"), 4).collect()}
    expected = {(b, i): n + 1 for n, (_, b, i) in enumerate(sorted(suffixes))}
    assert {(b, i): r for b, x in ranks.items() for i, r in enumerate(x)} == expected


def _u(x):
    import numpy as np

    return np.array(x, np.uint64)
