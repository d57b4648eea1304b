"""What is held at once while columns are unpacked and windows are read: little more than the result."""

import tracemalloc

import numpy as np

from kindred.llm import blocks, minhash, recompression


def peak(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def numbers(n, columns):
    return np.random.default_rng(0).integers(0, 1 << 63, (columns, n), dtype=np.uint64)


def test_columns_are_unpacked_to_their_places():
    parts = [numbers(20000, 5) + np.uint64(i) for i in range(16)]
    blobs = [blocks.pack_columns(*p) for p in parts]
    out, most = peak(lambda: blocks.joined_columns(blobs, 5))
    assert all((a == b).all() for a, b in zip(out, np.concatenate(parts, 1)))
    assert most < 1.5 * sum(x.nbytes for x in out)
    assert [len(x) for x in blocks.joined_columns([], 3)] == [0, 0, 0]


def test_signatures_are_unpacked_to_their_places():
    parts = [numbers(3000, 35) + np.uint64(i) for i in range(12)]
    (known, ids, sig), most = peak(lambda: minhash._signed([blocks.pack_columns(*p) for p in parts], 35))
    every = np.concatenate(parts, 1)
    assert (known == every[1]).all() and (ids == every[2]).all() and (sig.view(np.uint64) == every[3:].T).all()
    # The packed numbers, which are random and so as large as these, are made within.
    assert most < 2.6 * sig.nbytes


def test_windows_are_read_in_parts():
    n = 400_000
    symbols = np.random.default_rng(1).integers(1, 50, n + 50).astype(np.uint64)
    now = recompression.Level(symbols, 0)
    lo = np.arange(n)
    out, most = peak(lambda: now.read(lo, lo + 50, np.zeros(n, np.uint64)))
    assert most < 2.5 * sum(x.nbytes for x in out)  # with the windows themselves
    at = np.array([0, 1, 65535, 65536, n - 1])
    for x, y in zip(out, now.read(at, at + 50, np.zeros(len(at), np.uint64))):
        assert (x[at] == y).all()


def test_pairs_of_keys_are_ordered():
    rng = np.random.default_rng(2)
    for most in (1, 3, 1 << 40):
        for n in (0, 1, 2, 5000):
            hi, lo = (rng.integers(0, most, n).astype(np.uint64) << np.uint64(22) for _ in range(2))
            by = np.lexsort((lo, hi))
            for order in (blocks.order_of(hi, lo), blocks.order_by(hi, lo)):
                assert sorted(order) == list(range(n)) and (hi[order] == hi[by]).all() and (lo[order] == lo[by]).all()
