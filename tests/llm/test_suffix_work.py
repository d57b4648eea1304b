"""How much work the suffix array's rounds make: keys asked about, workers of a level, numbers that a sort compares."""

import numpy as np
import pytest

from kindred.llm import blocks, suffix_array
from kindred.llm.blocks import Docs, pack, pack_columns, unpack_columns
from kindred.shared import Shared

U = np.uint64


def docs(lengths, tokens):
    vocabulary, places = blocks._pack_tokens(tokens)
    return Docs({"doc_ids": pack(np.arange(len(lengths))), "lengths": pack(np.array(lengths)), "vocabulary": vocabulary, "tokens": places})


@pytest.mark.parametrize("length", [5, 6, 13, 50])
def test_suffixes_that_begin_alike_have_the_same_least_fingerprint(length):
    rng = np.random.default_rng(length)
    word = rng.integers(1, 1 << 63, 3000).astype(U)
    word[2000 : 2000 + length] = word[100 : 100 + length]
    word[1500 : 1500 + length] = word[100 : 100 + length]
    word[2900:] = 7  # one word again and again
    d = docs([700, 0, 3, 900, 1397], word)
    assert (d.tokens == word).all()
    at, begin, hi = suffix_array._least(d, length)
    assert at.tolist() == np.flatnonzero(d.left() >= length).tolist()
    key = dict(zip(at.tolist(), hi[np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(at))))].tolist()))
    same = {}
    for i in at.tolist():
        same.setdefault(tuple(word[i : i + length].tolist()), set()).add(key[i])
    assert all(len(x) == 1 for x in same.values())
    if length == 50:
        assert len(set(hi.tolist())) < len(word) / 6  # of triples there were two for three words


def test_workers_of_a_level_follow_its_symbols(spark, monkeypatch):
    """Blocks of few symbols don't make as many workers: rows between them grew as blocks times workers at every level."""
    monkeypatch.setattr(suffix_array, "BASE", 50)
    monkeypatch.setattr(blocks, "WORKER_KEYS", 200)
    seen, ask = [], suffix_array.ask

    def asked(work, name, state, keys_of, workers, *rest):
        seen.append(workers)
        return ask(work, name, state, keys_of, workers, *rest)

    monkeypatch.setattr(suffix_array, "ask", asked)
    n, words = 12, np.random.default_rng(1).integers(100, 102, 20).astype(U)
    rows = []
    for b in range(n):
        symbols = np.append(words, U(b + 1))
        rows.append((b, bytearray(), bytearray(pack_columns(np.array([21], U))), bytearray(pack_columns(symbols)), 1, 21))
    work = Shared(spark, "few")
    found = suffix_array.suffix_ranks(work, work.written(spark.createDataFrame(rows, suffix_array.STATE), "state"), n, 101).collect()
    order = sorted((tuple([*words.tolist(), b + 1][i:]), b, i) for b in range(n) for i in range(21))
    ranks = {r["block"]: unpack_columns(bytes(r["ranks"]), 1)[0].tolist() for r in found}
    assert {(b, i): ranks[b][i] for b in range(n) for i in range(21)} == {(b, i): k + 1 for k, (_, b, i) in enumerate(order)}
    assert seen and max(seen) < n and seen == sorted(seen, reverse=True)


def test_keys_take_one_number_where_they_fit():
    rng = np.random.default_rng(2)
    for bits in [(21, 21, 21), (18, 18, 25), (25, 30, 0), (22, 22, 22), (31, 31, 31), (18, 18, 42), (40, 40, 40), (42, 42, 42)]:
        which = rng.integers(0, 2, 4000).astype(U)
        parts = [rng.integers(0, 1 << b, 4000).astype(U) if b else np.zeros(4000, U) for b in bits]
        for p, b in zip(parts, bits):  # many equal ones, and the largest
            p[rng.random(4000) < 0.5] = (1 << b) - 1
        hi, lo = (np.where(which == 1, y, x) for x, y in zip(suffix_array.key(*parts, 0, bits), suffix_array.key(*parts, 1, bits)))
        by = np.lexsort((*parts[::-1], which))
        assert sorted(zip(which.tolist(), *(p.tolist() for p in parts))) == [(which[i], *(p[i] for p in parts)) for i in np.lexsort((lo, hi))]
        same = lambda *x: sum(a[by][1:] != a[by][:-1] for a in x) > 0
        assert (same(hi, lo) == same(which, *parts)).all()
        assert sum(bits) > 63 or not lo.any()


def test_blocks_are_gathered_to_larger_ones(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_WORDS", 10)
    assert blocks.grouped({3: 4, 0: 3, 1: 0, 2: 7, 4: 25, 5: 1}) == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 3}
    assert blocks.grouped({}) == {}
