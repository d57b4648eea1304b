"""The pipeline against each stage worked out by hand on small rows: nulls, empty and long texts, repeats, shared identifiers, clashing names."""

import duckdb
import numpy as np
import pyarrow as pa

import corpus_pipeline
from kindred.llm import minhash, packing, toxicity

NAMES = "doc_id long, text string, lang string, source string, n_chars long, `__row` string, `__id` string, slot string, `a.b` string"


def fixture():
    rng = np.random.default_rng(3)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    rows = [(i, text(int(rng.integers(5, 80)))) for i in range(60)]
    for k in range(6):
        near = list(rows[k][1])
        near[-1] = "other"
        rows += [(200 + k, rows[k][1]), (300 + k, near), (10 + k, near)]
    rows += [(400 + i, [*text(20), ("vexjuck", "zwilch")[i % 2]]) for i in range(40)]
    out = [(i, " ".join(w)) for i, w in rows]
    out += [(None, out[3][1]), (None, "nameless words"), (500, None), (501, ""), (502, ""), (503, "long " * 9000), out[5], out[5], (7, out[8][1] + " more")]
    return [(i, t, "en", ("hot", "hot", "s", None)[n % 4], 1, "r", "i", "s", "x") for n, (i, t) in enumerate(out)]


def by_hand(rows, model):
    flagged = toxicity.document_scores(pa.array([r[1] for r in rows], pa.string()), model) > model.threshold
    rows = [r for r, f in zip(rows, flagged) if not f]
    # Exact copies: the smallest identifier stays, null last.
    kept, seen = [], set()
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if r[1] is None or r[1] not in seen:
            seen.add(r[1])
            kept.append(r)
    # Near copies: all pairs of signatures, groups, the smallest identifier stays (no two rows share one here within a group).
    named = [r for r in kept if r[0] is not None]
    w = minhash.words(pa.array([r[1] for r in named], pa.string()))
    sig, has = minhash.signatures(w.hashes, w.first, minhash.COORDINATES, minhash.SHINGLE)
    group = {i: i for i in range(len(named))}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(has)):
        for b in range(a):
            if (sig[a] == sig[b]).sum() >= minhash.MATCHES:
                x, y = sorted((top(has[a]), top(has[b])), key=lambda i: named[i][0])
                group[y] = x
    return [r for i, r in enumerate(named) if top(i) == i]


def test_run_equals_by_hand(spark, tmp_path):
    rows = fixture()
    docs = spark.createDataFrame(rows, NAMES).repartition(4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], int("vexjuck" in (r[1] or "") or "zwilch" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] < 430]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    left = by_hand(rows, model)
    assert len(left) < len(rows) - 60
    documents = pa.table({"doc_id": [r[0] for r in left], "text": [r[1] for r in left]})  # noqa: F841
    found = corpus_pipeline.run(spark, str(tmp_path))
    expected = duckdb.sql(f"select {', '.join(found.columns)} from ({packing.oracle()})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    rows = fixture()
    docs = spark.createDataFrame(rows, NAMES).repartition(3)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_mixing_orders_the_documents(spark):
    docs = spark.createDataFrame([(i, "word " * 4000, "en", "ab"[i % 2], 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    out = [r["source"] for r in corpus_pipeline.mix(spark, docs, "").collect()]
    assert len(out) == 40 and 8 <= out[:20].count("a") <= 12


def test_packed_bins_follow_the_mixture(spark, tmp_path):
    """Written, and read in another order than that of the files: bins come where the document in slot 0 stands, and hold what they held."""
    docs = spark.createDataFrame([(i, "word " * (30 + 1500 * (i % 3 > 0) + i), "en", "abc"[i % 3], 1) for i in range(90)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        corpus_pipeline.mix(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
        order = [r["doc_id"] for f in sorted((tmp_path / "mixed").glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
        mixed = spark.read.parquet(str(tmp_path / "mixed"))
        packed = [tuple(r) for r in corpus_pipeline.pack(spark, mixed, "").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first = [r[4] for r in packed if r[3] == 0]
    assert len(order) == 90 and order != sorted(order)
    assert first == sorted(first, key=order.index) and len(first) > 30
    assert sorted(packed) == sorted(map(tuple, packing.pack_documents(docs).collect()))
    assert [r[:4] for r in packed if r[0] > 1 and r[3]] and all(a[:3] == b[:3] and a[3] + 1 == b[3] for a, b in zip(packed, packed[1:]) if b[3])
