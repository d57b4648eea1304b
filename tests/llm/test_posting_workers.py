"""Posting lists have workers by what they are sent, not by the number of blocks."""

from kindred.llm import minhash


def test_workers_follow_documents_and_lists():
    lists = minhash.COORDINATES - minhash.MATCHES + 1
    for docs in (1 << 10, 1 << 18, 3 << 20, 15 << 20):
        assert docs * lists <= minhash.POSTED * minhash.posting_workers(1, docs, lists)
    assert minhash.posting_workers(0, 0, lists) == 1


def test_groups_are_the_same_with_many_workers(spark, monkeypatch):
    word = lambda d, i: f"w{d % 40}x{i}" if i % 10 else f"own{d}x{i}"
    docs = spark.createDataFrame([(d, " ".join(word(d, i) for i in range(60))) for d in range(120)], "doc_id bigint, text string")
    few = sorted(map(tuple, minhash.near_duplicates(docs, matches=24).collect()))
    monkeypatch.setattr(minhash, "POSTED", 64)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 16)
    assert few and sorted(map(tuple, minhash.near_duplicates(docs, matches=24).collect())) == few
