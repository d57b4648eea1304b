import pytest
from pyspark.sql import functions as F

from kindred.functions import json, text
from kindred.operators import collections as C
from kindred.operators import graph, matcher, pairs, vectors
from kindred.sources import files

GLOSSARY = """{"glossary": {"title": "example glossary", "GlossDiv": {"title": "S", "GlossList": {"GlossEntry": {"ID": "SGML", "SortAs": "SGML",
 "GlossTerm": "Standard Generalized Markup Language", "Acronym": "SGML", "Abbrev": "ISO 8879:1986", "GlossDef": {"para": "A meta-markup language.", "GlossSeeAlso": ["GML", "XML"]}, "GlossSee": "markup"}}}}}"""


@pytest.fixture
def one(spark):
    return lambda c: spark.range(1).select(c).first()[0]


def test_sentence_of_words_and_numbers(one):
    words = "     nothing word 2 , 9 this I2S a st6riNg, is    TRUE is a 663  string is5   ABle to trueueueue "
    stop = ["this", "i", "a", "is", "able", "to"]
    assert one(text.without(text.tokens(F.lit(words)), stop)) == ["nothing", "word", "s", "st", "ring", "true", "string", "trueueueue"]


def test_nested_json_and_types(one):
    assert one(json.kind(F.lit(GLOSSARY))).startswith("OBJECT<glossary")
    assert one(json.keys(F.lit(GLOSSARY))) == ["glossary"]
    mixed = F.lit("[true, 5, false, -2.27]")
    assert one(json.length(mixed)) == 4
    assert [one(json.element(mixed, i, "string")) for i in range(5)] == ["true", "5", "false", "-2.27", None]
    assert one(json.element(mixed, 3, "double")) == -2.27 and one(json.element(mixed, 0, "boolean")) is True
    thing = F.lit('{"foo" : 5, "bar" : false, "baz" : [true]}')
    assert one(json.keys(thing)) == ["foo", "bar", "baz"]
    assert one(json.strict(thing, "foo", "double")) == 5.0 and one(json.strict(thing, "bar", "boolean")) is False
    assert one(json.strict(thing, "foo", "string")) is None and one(json.strict(thing, "none", "string")) is None
    assert one(json.member(F.lit('{"a":"x","a":"y"}'), "a")) == "y"
    assert one(files.printed_column(F.lit('{"a":[1]}'))).count("\n") >= 2


def test_words_of_a_product(spark):
    spec = '{"<page title>": "Olympus OM-D E-M5 Silver w/14-42 IIR Lens", "memory": "SDHC card", "finder": "electronic EVF, OLED", "ibis": "IBIS stabilization", "n": 5, "tags": ["hidden"]}'
    rows = json.string_attributes(spark.createDataFrame([("s//1", spec)], "spec_id string, json string"))
    vocabulary = vectors.vocabulary(vectors.document_frequency(vectors.counts(vectors.token_rows(rows, "spec_id", "value"))), 1)
    words = {r["token"] for r in vocabulary.collect()}
    assert {"om", "stabilization", "evf", "sdhc", "oled", "silver", "lens", "ibis", "electronic"} <= words and "hidden" not in words


def test_every_step_moves_the_weights(spark):
    x, y = [[0.5, -0.5], [0.2, 0.8], [1, -1], [1.8, -0.8], [5, -2]], [0, 1, 0, 1, 0]
    known = spark.createDataFrame([(i, i + 100, t) for i, t in enumerate(y)], "spec1 int, spec2 int, relation int")
    features = spark.createDataFrame([(i, i + 100, p, float(v)) for i, row in enumerate(x) for p, v in enumerate(row)], "spec1 int, spec2 int, position bigint, x double")
    data, m = matcher.rows(features, known).cache(), matcher.Matcher.new(2)
    for _ in range(4):
        before = m
        m, delta = matcher.step(data, m)
        assert delta > 0 and delta == pytest.approx(matcher.max_delta(before, m))


def test_lists(one):
    a = lambda *x: F.array(*[F.lit(i) for i in x])
    assert one(C.merge_sorted(a(1, 3, 5, 7), a(0, 2, 4, 6, 8, 9, 10))) == list(range(11))
    assert one(F.array_sort(a(1, 9, 2, 4, 3, 7, 6, 5, 8, 0))) == list(range(10))
    head, rest = C.split_at(a(*range(9)), 4)
    assert (one(head), one(rest)) == ([0, 1, 2, 3], [4, 5, 6, 7, 8])
    assert one(F.transform(a(*range(10)), lambda x: x + 1)) == list(range(1, 11))
    first, left = C.pop(a(4, 5))
    assert (one(first), one(left)) == (4, [5]) and one(C.pop(a(4))[1]) == []
    assert one(C.push(a(1), F.lit(0))) == [0, 1] and one(C.push_list(a(1), a(2, 3))) == [1, 2, 3]
    m = F.create_map(F.lit("k"), F.lit(1), F.lit("j"), F.lit(2))
    assert one(C.map_get(m, "k")) == 1 and one(C.map_get(m, "z")) is None and one(C.map_delete(m, "k")) == {"j": 2}


def test_upserts_and_sets(spark):
    rows = spark.createDataFrame([(5, i) for i in range(5)], "k int, v int")
    assert [tuple(r) for r in C.upserted(rows, "k").collect()] == [(5, 4)]
    assert [tuple(r) for r in C.upserted(rows, "k", 10, F.col("v")).collect()] == [(5, 20)]
    a, b = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string"), spark.createDataFrame([(2, "x"), (2, "b"), (1, "c"), (None, "m"), (3, None)], "k int, v string")
    assert sorted(map(tuple, C.put_distinct(a, b, "k").collect()), key=str) == sorted([(1, "a"), (None, "n"), (2, "b"), (3, None)], key=str)
    c = spark.createDataFrame([(None, "m"), (None, "l")], "k int, v string")
    assert sorted(map(tuple, C.put_distinct(a.where("k = 1"), c, "k").collect()), key=str) == [(1, "a"), (None, "l")]
    sets = [spark.createDataFrame([(i,) for i in x], "k int") for x in (range(5), range(5, 10))]
    assert sorted(r[0] for r in C.set_union(*sets).collect()) == list(range(10))
    assert sorted(map(tuple, C.set_in(b.select("k"), a, "k").collect()), key=str) == sorted([(2, False), (2, False), (1, True), (None, False), (3, False)], key=str)


def test_pairs_that_follow_and_lookup(spark):
    known = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (4, 5, 0)], "spec1 int, spec2 int, relation int")
    assert [tuple(r) for r in matcher.unclosed(known).collect()] == [(1, 3, 1)]
    members = graph.connected_components(known.where("relation = 1"), "spec1", "spec2", "spec_id", "root_id")
    wanted = spark.createDataFrame([(3,), (9,)], "spec_id int")
    assert sorted(map(tuple, pairs.lookup(members, wanted).collect())) == [(3, 1), (9, None)]


def test_files_of_pairs_and_lines(spark, tmp_path):
    (tmp_path / "u.csv").write_text("left_spec_id,right_spec_id\na//1,b//2\n")
    assert [tuple(r) for r in files.read_unlabelled(spark, str(tmp_path / "u.csv")).collect()] == [("a//1", "b//2", None)]
    rows = spark.createDataFrame([("a", "b", 1)], "spec1 string, spec2 string, relation int")
    for _ in range(2):
        files.write_pairs(rows, str(tmp_path / "p"))
    assert [tuple(r) for r in files.read_pairs(spark, str(tmp_path / "p")).collect()] == [("a", "b", 1)] * 2
    files.write_lines(spark.createDataFrame([("one",), ("two",)], "line string"), str(tmp_path / "l"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["one", "two"]


def test_stopwords_from_a_table(spark):
    docs = spark.createDataFrame([(1, "The lens of the cap")], "id int, t string")
    table = spark.createDataFrame([("the",), ("of",), ("the",)], "word string")
    assert sorted(r["token"] for r in vectors.token_rows(docs, "id", "t", table).collect()) == ["cap", "lens"]


def test_hash_of_bytes(one):
    def by_hand(word):
        h = 5381
        for x in word.encode():
            h = (h * 33 + (x - 256 if x > 127 else x)) % (1 << 32)
        return h

    for word in ("foo", "", "é", "日本 lens"):
        assert one(text.djb2(F.lit(word))) == by_hand(word)
    assert one(text.djb2(F.lit(None).cast("string"))) is None
