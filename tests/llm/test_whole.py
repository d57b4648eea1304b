import corpus_pipeline
from kindred.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def uneven(spark):
    """A large source, a small one, one of a single block, a document longer than two blocks, and documents without a word."""
    rows = [(i, "a " * 700, "big") for i in range(120)] + [(i, "b " * 500, "small") for i in range(200, 220)] + [(300, "c " * 1000, "one"), (301, "d " * 20000, "long"), (302, "", "one"), (303, None, None)]
    return spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA).repartition(3)


def test_op7_takes_every_word(spark):
    docs = uneven(spark)
    for weights, block_tokens in ((None, 8192), (None, 1000), ({"big": 1, "small": 5}, 1000)):
        got = mixing.mixture(docs, weights, block_tokens).collect()
        expected = docs.where("source in ('big', 'small')") if weights else docs
        count = {r["doc_id"]: len((r["text"] or "").split()) for r in expected.collect()}
        assert {r["doc_id"] for r in got} == set(count)
        covered = {i: sorted((r["start_word"], r["n_words"]) for r in got if r["doc_id"] == i) for i in count}
        for i, pieces in covered.items():
            assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) == count[i]
        # One block a slot, one slot a block, and no gap.
        assert {r["slot"] for r in got} == set(range(len({(r["source"], r["block"]) for r in got})))


def test_op7_keeps_to_weights_when_a_source_has_run_out(spark):
    docs = spark.createDataFrame([(i, "x " * 10, "en", "abc"[i % 3], 1) for i in range(3000)], SCHEMA)
    got = mixing.mixture(docs, {"a": 1, "b": 2, "c": 4}, 10).orderBy("slot").collect()
    assert len(got) == 3000
    # c has run out: of the slots after that, a has a third and b two thirds until b has run out too.
    after = [r["source"] for r in got if r["slot"] > max(x["slot"] for x in got if x["source"] == "c")]
    both = after[: max(i for i, s in enumerate(after) if s == "b")]
    assert len(both) > 600 and abs(both.count("a") / len(both) - 1 / 3) < 0.02


def test_pipeline_mix_takes_every_document(spark):
    docs = uneven(spark)
    assert sorted(r["doc_id"] for r in corpus_pipeline.mix(spark, docs, "").collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_pipeline_near_dedup_tells_rows_of_one_identifier_apart(spark):
    word = lambda k, n=80: [f"{k}{i}" for i in range(n)]
    near = lambda k: " ".join([*word(k)[:-1], "other"])
    text = lambda k: " ".join(word(k))
    rows = [(7, text("a")), (7, text("b")), (3, near("a")), (9, near("b")), (5, text("c")), (4, near("c")), (4, text("d")), (None, text("a")), (8, None), (8, text("e")), (2, text("f")), (2, near("f"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in left.collect()]
    # (7, b) has no near copy with a smaller identifier; (9, b') goes for it. (4, d) stays beside (4, c').
    expected = [(7, text("b")), (3, near("a")), (4, near("c")), (4, text("d")), (None, text("a")), (8, None), (8, text("e"))]
    assert sorted((x for x in left if x[0] != 2), key=str) == sorted(expected, key=str)
    assert len([x for x in left if x[0] == 2]) == 1
