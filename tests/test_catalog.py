import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import json, text
from kindred.operators import collections as C
from kindred.operators import graph, matcher, pairs, vectors
from kindred.plans import catalog
from kindred.sources import files

SF = "/root/testdata/sf0.001"


def normal(rows):
    plain = lambda x: round(float(x), 6) if isinstance(x, float) else x
    return sorted((tuple(plain(x) for x in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        p = f"{SF}/{t}"
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    columns = sorted(found.columns)
    expected = duck.execute(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert normal(map(tuple, found.select(columns).collect())) == normal(expected)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 5), (3, 6), (4, 6), (3, 4), (8, 9), (None, 2)], "a int, b int")
    assert sorted(map(tuple, graph.connected_components(edges).collect())) == [(i, 1) for i in range(1, 7)] + [(8, 8), (9, 8)]


def test_f1_golden(spark):
    y, p = [0, 1, 1, 0, 1, 1, 1, 1, 0, 0], [1, 1, 1, 0, 1, 0, 0, 1, 0, 0]
    df = spark.createDataFrame(list(zip(y, map(float, p))), "y int, p double")
    assert matcher.f1(df).first()["f1"] == pytest.approx(8 / 11)
    assert matcher.f1(df.where("false")).first()["f1"] is None


def test_text_goldens(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.cleanup(F.lit("tHe;-. a qui,,,.ck. 255 at 43 a fox.---- j to"), ["the", "a", "at", "j", "to"])) == "qui ck        fox "
    assert one(text.djb2(F.lit("foo"))) == 193491849
    assert one(text.tokens(F.lit("st6riNg, I2S É!"))) == ["st", "ring", "i", "s", "É"]
    assert one(text.tokens(F.lit(None).cast("string"))) is None
    assert [one(text.is_number(F.lit(x))) for x in ("0", "-1.5e+3", "01", "1.", "")] == [True, True, False, False, False]
    assert one(json.member(F.lit('{"foo": 5, "bar": false}'), "foo", "double")) == 5.0
    assert one(json.kind(F.lit("[true, 5]"))).startswith("ARRAY")
    assert one(json.length(F.lit("[]"))) == 0
    assert one(json.member(F.lit('{"unclosed'), "x")) is None
    assert one(C.nth(F.array(F.lit(1), F.lit(2)), 5)) is None


def test_files(spark, tmp_path):
    (tmp_path / "specs" / "www.a.com").mkdir(parents=True)
    (tmp_path / "specs" / "www.a.com" / "7.json").write_text('{"name": "Big lens", "n": 5, "tags": ["x"]}')
    specs = files.read_specs(spark, str(tmp_path / "specs"))
    assert [(r["spec_id"], r["site"], r["num"]) for r in specs.collect()] == [("www.a.com//7", "www.a.com", "7")]
    assert [tuple(r) for r in json.string_attributes(specs).select("key", "value").collect()] == [("name", "Big lens")]
    (tmp_path / "l.csv").write_text("left_spec_id,right_spec_id,label\na,b,1\na,a,1\nb,c,0\n")
    assert sorted(map(tuple, files.read_labelled(spark, str(tmp_path / "l.csv")).collect())) == [("a", "b", 1), ("b", "c", 0)]
    (tmp_path / "sw.txt").write_text("a,i,x,i")
    assert {r[0] for r in files.read_stopwords(spark, str(tmp_path / "sw.txt")).collect()} == {"a", "i", "x"}
    vocabulary = spark.createDataFrame([("lens", 0, 2, 0.5)], "token string, position bigint, df bigint, idf double")
    files.write_vocabulary(vocabulary, str(tmp_path / "v"))
    assert files.read_vocabulary(spark, str(tmp_path / "v")).collect() == vocabulary.collect()


def test_matcher_learns_and_self_trains(spark):
    words = [f"w{chr(97 + i)}" for i in range(12)]
    specs = spark.createDataFrame([(f"s//{i:02}", f"{words[i // 2]} {words[i // 2]} item") for i in range(24)], "spec_id string, t string")
    labels = spark.createDataFrame([(f"s//{2 * i:02}", f"s//{2 * i + 1:02}", 1) for i in range(6)] + [(f"s//{2 * i:02}", f"s//{2 * i + 2:02}", 0) for i in range(5)], "spec1 string, spec2 string, relation int")
    members = pairs.cliques(specs, labels)
    roots = pairs.different_roots(members, labels)
    known = pairs.similar_pairs(members).union(pairs.different_pairs(members, roots))
    counts = vectors.counts(vectors.token_rows(specs, "spec_id", "t"))
    vocabulary = vectors.vocabulary(vectors.document_frequency(counts), 24)
    vecs = vectors.vectors(counts, vocabulary, False)
    data = matcher.rows(vectors.pair_features(known, vecs), known)
    m = matcher.Matcher.new(vocabulary.count(), 0.05)
    after, delta = matcher.step(data, m)
    assert delta > 0
    start = m
    m = matcher.fit(data, data, m, epochs=8)
    one_task, matcher.ONE_TASK = matcher.ONE_TASK, 0
    apart = matcher.fit(data, data, start, epochs=8)
    matcher.ONE_TASK = one_task
    assert np.allclose(apart.weights, m.weights) and apart.bias == pytest.approx(m.bias)
    assert matcher.mean_loss(matcher.predict(data, m)) < matcher.mean_loss(matcher.predict(data, after))
    block = specs.select("spec_id", F.lit(1).alias("b"))
    m2, grown = matcher.self_train(members, block, known, known, vecs, m, step_size=0.45, epochs=1)
    assert grown.count() > known.count()
    assert np.isfinite(m2.weights).all()
