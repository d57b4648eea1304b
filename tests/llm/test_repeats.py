import random
import re

import pytest

from kindred.llm import blocks, recompression, suffix_array

WAYS = [suffix_array.repeated_passages, recompression.repeated_passages]


def brute(rows, length):
    """Spans of words whose windows another row has too."""
    docs = [(i, re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in rows if i is not None]
    owners = {}
    for n, (_, w) in enumerate(docs):
        for k in range(len(w) - length + 1):
            owners.setdefault(tuple(w[k : k + length]), set()).add(n)
    out = []
    for i, w in docs:
        spans = []
        for k in range(len(w) - length + 1):
            if len(owners[tuple(w[k : k + length])]) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        out += [(i, a, b, b - a) for a, b in spans]
    return sorted(out)


def corpus(seed, letters=30):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyzéß日") * rng.randint(1, 3) if letters > 3 else rng.choice("ab")
    passages = [[word() for _ in range(rng.randint(10, 90))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            p = rng.choice(passages)
            w[at:at] = p[rng.randint(0, 8) : len(p) - rng.randint(0, 8)]
        rows.append((i, "  ".join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in w)))
    rows += [rows[3], (100, rows[4][1]), (101, None), (None, rows[5][1]), (102, ""), (103, "a " * 400), (104, "b " + "a " * 300)]
    return rows


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("length,seed,letters", [(50, 1, 30), (35, 2, 3), (12, 3, 30), (6, 4, 30), (50, 5, 3)])
def test_spans_match_brute_force(spark, way, length, seed, letters, monkeypatch):
    rows = corpus(seed, letters)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "t").selectExpr("doc_id", "t as text", "1 as block", "'x' as keys").repartition(3)
    assert sorted(map(tuple, way(df, length).collect())) == brute(rows, length)


@pytest.mark.parametrize("way", WAYS)
def test_many_small_blocks_and_workers(spark, way, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_WORDS", 400)
    monkeypatch.setattr(blocks, "FAN", 3)
    monkeypatch.setattr(blocks, "WORKER_KEYS", 300)
    monkeypatch.setattr(suffix_array, "BASE", 1000)
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, way(df, 40).collect())) == brute(rows, 40)


@pytest.mark.parametrize("way", WAYS)
def test_empty_table(spark, way):
    assert way(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("way", WAYS)
def test_long_document_and_copy(spark, way):
    text = " ".join(f"w{i}" for i in range(60000))
    df = spark.createDataFrame([(1, text), (2, text), (3, "x " * 100)], "doc_id long, text string")
    assert sorted(map(tuple, way(df).collect())) == [(1, 0, 60000, 60000), (2, 0, 60000, 60000)]
