import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import ann, exact, html_extract, minhash, mixing, packing, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, worker string, block string, shard string, score string, digest string, slot string"


def documents(spark, rows=None):
    """Null identifiers, texts and sources, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = np.random.default_rng(5)
    if rows is None:
        words = [f"w{i}" for i in range(400)]
        rows = [(i, " ".join(rng.choice(words, rng.integers(1, 60))), "hot" if i % 3 else f"s{i % 7}") for i in range(80)]
        rows += [(200, None, "hot"), (None, "no name here", "s1"), (201, "", "s2"), (202, " ", None), (203, "long " * 30000, "s3"), (204, rows[0][1], "s1"), (205, rows[0][1], "s2"), rows[1], rows[1], (None, rows[2][1], "s2"), (7, "another seven", None)]
    df = spark.createDataFrame([(i, t, "en", s, 1, "w", "b", "s", "x", "d", "y") for i, t, s in rows], SCHEMA)
    return df.repartition(5)


def by_sql(df, sql):
    documents = df.toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    return sorted(duckdb.sql(sql).fetchall(), key=str)


@pytest.mark.parametrize("make,sql", [(packing.pack_documents, packing.oracle()), (mixing.mixture, mixing.ORACLE), (exact.exact_duplicates, exact.ORACLE)])
def test_equals_sql_on_hard_rows(spark, make, sql):
    df = documents(spark)
    found = make(df)
    columns = ", ".join(found.columns)
    assert sorted(map(tuple, found.collect()), key=str) == by_sql(df, f"select {columns} from ({sql})")


def test_packing_never_overfills(spark):
    p = packing.pack_documents(documents(spark), capacity=50, classes=5)
    bins = p.groupBy("class", "worker", "bin").agg(F.sum("n_words").alias("n"), F.count("*").alias("k"), F.max("slot").alias("s")).collect()
    assert all(b["n"] <= 50 and b["k"] == b["s"] + 1 <= b["class"] for b in bins)


def test_exact_small_fans_and_removal(spark):
    df = documents(spark)
    expected = by_sql(df, exact.ORACLE)
    assert sorted(map(tuple, exact.exact_duplicates(df, fan=2).collect()), key=str) == expected
    left = exact.without_duplicates(df)
    assert left.columns == df.columns
    assert left.count() == df.count() - len(expected)


@pytest.mark.parametrize("workers", [3, 30])
def test_packing_of_several_workers_equals_sql(spark, workers):
    df = documents(spark)
    found = packing.pack_documents(df, worker_docs=workers)
    assert sorted(map(tuple, found.collect()), key=str) == by_sql(df, f"select {', '.join(found.columns)} from ({packing.oracle(worker_docs=workers)})")
    assert found.select("worker").distinct().count() > 1


def test_schedule_keeps_to_weights(spark):
    """Long documents and short ones: the shares of tokens follow the weights until a source runs out."""
    rows = [(i, "long " * 20000, "a") for i in range(5)] + [(100 + i, "short " * 10, "b") for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    m = mixing.mixture(df, {"a": 1, "b": 1}, block_tokens=1000).toPandas()
    begun = m[m.slot < 2 * 75]
    share = begun.groupby("source").n_words.sum()
    assert abs(share["a"] / share.sum() - 0.5) < 0.02
    assert m.groupby("source").n_words.sum().to_dict() == {"a": 100000, "b": 80000}
    weighed = mixing.mixture(df, {"a": 3, "b": 1}, block_tokens=500).toPandas()
    share = weighed[weighed.slot < 250].groupby("source").n_words.sum()
    assert abs(share["a"] / share.sum() - 0.75) < 0.02
    full = m.groupby(["source", "block"]).n_words.sum()
    assert (full.to_numpy() == 1000).sum() == len(full)


HARD_NAMES = {"lang": "__key", "worker": "__tie", "block": "__digest", "shard": "__id", "score": "a.b", "digest": "digest", "slot": "id"}


def renamed(df):
    return df.toDF(*[HARD_NAMES.get(c, c) for c in df.columns])


def test_exact_keeps_columns_of_any_name(spark):
    df = renamed(documents(spark))
    left = exact.without_duplicates(df)
    assert left.columns == df.columns
    quoted = lambda x: [F.col(f"`{c}`") for c in x.columns]
    assert left.select(*quoted(left)).exceptAll(df.select(*quoted(df))).count() == 0
    largest = spark.createDataFrame([((1 << 63) - 1, "t"), (3, "t"), (None, "t")], "doc_id long, text string")
    assert sorted(map(tuple, exact.exact_duplicates(largest).collect()), key=str) == [((1 << 63) - 1, 3), (None, 3)]


def test_sharding_takes_columns_of_any_name(spark):
    df = renamed(documents(spark)).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    out = sharding.shuffled(df, bucket_bytes=1 << 14)
    assert out.count() == df.count() and out.columns == [*df.columns, "shard", "position"]
    plain = lambda x: sorted(str([r[c] for c in df.columns]) for r in x.collect())
    assert plain(out) == plain(df)


def test_sharding_scatters_equal_rows(spark):
    df = spark.createDataFrame([(None, "")] * 20000 + [(i, "x") for i in range(2000)], "doc_id long, text string").repartition(4)
    sizes = [r["count"] for r in sharding.shuffled(df, bucket_bytes=260000).groupBy("shard").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 1.1 * min(sizes)


def test_fisher_yates_by_hand():
    for n in (0, 1, 2, 50):
        generator, expected = np.random.PCG64([7, 3]), list(range(n))
        raw = [int(x) for x in generator.random_raw(n)] if n else []
        for last in reversed(range(1, n)):
            at = (raw[last] * (last + 1)) // (1 << 64)
            expected[last], expected[at] = expected[at], expected[last]
        assert sharding.fisher_yates(n, 7, 3).tolist() == expected
    places = np.array([sharding.fisher_yates(4, 1, b) for b in range(6000)])
    for k in range(4):
        assert (abs(np.bincount(places[:, k], minlength=4) - 1500) < 150).all()


def test_sharding_is_a_permutation(spark):
    df = documents(spark)
    out = sharding.shuffled(df, bucket_bytes=1 << 14)
    kept = [c for c in df.columns if c != "shard"]
    assert sorted(map(str, out.select(kept).collect())) == sorted(map(str, df.select(kept).collect()))
    at = out.groupBy("shard").agg(F.count("*").alias("n"), F.sum("position").alias("p")).collect()
    assert len(at) > 1 and all(r["p"] == r["n"] * (r["n"] - 1) // 2 for r in at)
    once = df.distinct()
    first, again = (sharding.shuffled(x, bucket_bytes=1 << 14) for x in (once, once.repartition(2)))
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))


def test_minhash_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = list(rng.choice(words, 60))
        for k in range(1 + g % 4):
            x = list(base)
            for j in rng.integers(0, 60, k * 2):
                x[j] = str(rng.choice(words))
            rows.append((len(rows), " ".join(x), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (None, rows[0][1], "s"), (102, "two words", "s"), (103, "Two, words!", "s"), rows[3]]
    found = {tuple(r) for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    named = [r for r in rows if r[0] is not None]
    w = minhash.words(pa.array([r[1] for r in named], pa.string()))
    sig, has = minhash.signatures(w.hashes, w.first, minhash.COORDINATES, minhash.SHINGLE)
    ids = [named[i][0] for i in has]
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (sig[a] == sig[b]).sum() >= minhash.MATCHES:
                x, y = sorted((top(ids[a]), top(ids[b])))
                root[y] = x
    assert found == {(i, top(i)) for i in ids if top(i) != i}
    assert (103, 102) in found
    every = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a in range(len(ids)) for b in range(a) if (sig[a] == sig[b]).sum() >= minhash.MATCHES and ids[a] != ids[b]}
    df = documents(spark, rows).coalesce(1)
    got = {(r["doc_a"], r["doc_b"]) for r in minhash.near_duplicate_pairs(df).collect()}
    # All pairs of different signatures; equal ones are linked to their first.
    first = {}
    for i, x in zip(ids, sig):
        first.setdefault(x.tobytes(), i)
    lead = {i: first[x.tobytes()] for i, x in zip(ids, sig)}
    assert got <= every
    assert {(a, b) for a, b in every if lead[a] == a and lead[b] == b} <= got


def test_long_posting_lists_are_cut(spark, monkeypatch):
    """2000 signatures that share a coordinate: the pairs of all, without comparing each with each."""
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 1 << 30, (2000, 64)).astype(np.uint32)
    sig[:, 5] = 7
    for i in range(0, 400, 4):
        sig[i + 1] = np.where(rng.random(64) < 0.8, sig[i], sig[i + 1])
    compared = []
    equal = minhash._equal
    monkeypatch.setattr(minhash, "_equal", lambda s, r, o: compared.append(len(o)) or equal(s, r, o))
    n = len(sig)
    a, b, m = minhash._compared(np.zeros(n, np.uint64), np.arange(n), sig, 32, minhash.every_pair)
    expected = {(i, i + 1) for i in range(0, 400, 4) if (sig[i] == sig[i + 1]).sum() >= 32}
    assert {(min(x, y), max(x, y)) for x, y in zip(a, b)} == expected and len(expected) > 90
    assert sum(compared) < 20 * n


def test_toxicity_held_out_and_edges(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    held = toxicity.scored(docs, model).join(labels.where("doc_id % 2 = 1 and toxic is not null"), "doc_id").select((F.col("score") > model.threshold).alias("p"), (F.col("toxic") == 1).alias("y")).toPandas()
    hit = (held.p & held.y).sum()
    print('found', hit, 'of', held.y.sum(), 'besides', (held.p & ~held.y).sum(), 'of', (~held.y).sum())
    # Some labels are wrong: toxic documents without an insult, and the other way round. Measured when this was written: see the README.
    assert hit / held.y.sum() > 0.85 and (held.p & ~held.y).sum() <= 45
    letters = "abcdefghijklmnopqrstuvwxyz"
    flags = lambda texts: toxicity.document_scores(pa.array(texts), model) > model.threshold
    insults = ["pathetic", "worthless", "idiot", "stupid", "clown", "loser", "scum", "moron", "trash", "disgusting"]
    assert flags(insults).all()
    one = [w[:i] + c + w[i:] for w in insults for i in range(len(w) + 1) for c in letters]
    rng = np.random.default_rng(0)
    two = [w[:i] + letters[rng.integers(26)] + w[i:] for w in one for i in rng.integers(0, len(w) + 1, 1)]
    print("one letter", flags(one).mean(), "two", flags(two).mean())
    assert flags(one).mean() > 0.8 and flags(two).mean() > 0.5
    assert flags(["a i.d.i.o.t here", "you i d i o t", "st*upid", "word " * 200000 + "stuupid"]).all()
    edges = documents(spark, [(1, None, "s"), (2, "", "s"), (None, "you idiot", "s"), (3, " \n", "s")])
    assert toxicity.without_toxic(edges.where("text is null or text <> 'you idiot'"), model).count() == 3
    assert toxicity.toxic_documents(edges, labels.where("false")).count() == 0
    assert toxicity.toxic_documents(edges.where("false"), labels).count() == 0


def test_html(spark):
    page = "<html><nav><a>x</a><a>y</a></nav><p>one two three four five</p><p>six seven</p><footer><a>z</a></footer></html>"
    pages = spark.createDataFrame([(1, "u/5", page, "a"), (2, "u", None, "a"), (3, "u", "", "a"), (None, "u", "<b>unclosed", "a"), (1, "u/5", page, "a"), (4, "u", "<p>" + "w " * 50000, "a")], "page_id long, url string, html string, text string")
    known = spark.createDataFrame([(5, "one two three four five six seven", "t")], "doc_id long, text string, html string")
    out = [(r["page_id"], r["text"], r["n_words"]) for r in html_extract.main_text(pages, known).collect()]
    assert len(out) == 6
    assert out.count((1, "one two three four five\nsix seven", 7)) == 2
    assert (2, "", 0) in out and (3, "", 0) in out and (4, " ".join(["w"] * 50000), 50000) in out
    words, tags = [1.0, 0.0, 4.0, 1.0, 3.0], [-3.0, -0.5, -0.5, -9.0]
    sums = {(a, b): sum(words[a : b + 1]) + sum(tags[a:b]) for a in range(5) for b in range(a, 5)}
    assert html_extract.best_region(words, tags)[2] == max(sums.values())


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((600, 16)).astype(np.float32)
    v[5] = v[6]
    rows = [(i, [float(x) for x in v[i]], "c") for i in range(600)]
    rows += [(None, rows[0][1], "c"), (900, None, "c"), (901, [1.0], "c"), (902, [float("nan")] * 16, "c"), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string").repartition(4)
    found = ann.nearest_neighbours(df, k=10, cell_rows=100).toPandas()
    d = np.sqrt(((v[:, None].astype(float) - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    true = {(i, j) for i in range(600) if i != 7 for j in np.argsort(d[i])[:10]}
    got = set(zip(found.vec_id, found.neighbour_id))
    assert len(true & got) / len(true) > 0.9
    assert (5, 6) in got and not {900, 901, 902} & set(found.vec_id)
    assert ann.nearest_neighbours(df.where("false")).count() == 0


def test_empty_tables(spark):
    e = documents(spark).where("false")
    for f in (packing.pack_documents, mixing.mixture, exact.exact_duplicates, exact.without_duplicates, sharding.shuffled, minhash.near_duplicates):
        assert f(e).count() == 0
