import json as pyjson

import pytest

from kindred.__main__ import main, options
from kindred.plans import pipeline
from kindred.sources import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Twelve products of two sites, each product twice or three times; labels within and across."""
    root = tmp_path_factory.mktemp("specs")
    names = ["alpha lens", "bravo body", "carbon tripod", "delta strap", "echo flash", "foxtrot case", "golf charger", "hotel filter"]
    ids = {}
    for i, name in enumerate(names):
        for k in range(3):
            site, num = f"www.{'ab'[k % 2]}.com", 10 * i + k
            (root / "specs" / site).mkdir(parents=True, exist_ok=True)
            (root / "specs" / site / f"{num}.json").write_text(pyjson.dumps({"title": f"{name} the {name} mark", "price": 5, "tags": ["x"]}))
            ids.setdefault(i, []).append(f"{site}//{num}")
    lines = ["left_spec_id,right_spec_id,label"]
    for i, group in ids.items():
        lines += [f"{group[0]},{x},1" for x in group[1:]] + [f"{group[0]},{group[0]},1"]
        lines.append(f"{group[0]},{ids[(i + 1) % len(ids)][0]},0")
    (root / "labels.csv").write_text("\n".join(lines) + "\n")
    (root / "stop.txt").write_text("the,mark")
    (root / "user.csv").write_text("left_spec_id,right_spec_id\n" + f"{ids[0][0]},{ids[0][1]}\n{ids[0][0]},{ids[3][0]}\n")
    return root


@pytest.mark.parametrize("mode", ["tfidf", "bow"])
def test_train_then_predict(spark, folder, mode):
    out = str(folder / f"out-{mode}")
    found = pipeline.train(spark, str(folder / "specs"), str(folder / "labels.csv"), str(folder / "stop.txt"), mode, out, epochs=40, rate=0.5)
    words = {r["token"] for r in found.vocabulary.collect()}
    assert "lens" in words and not words & {"the", "mark", "www"}
    assert found.matcher.mode == mode and found.f1 is not None and found.f1 > 0.9
    assert found.report.where("correct").count() > 0.8 * found.report.count()
    known = {tuple(r) for r in found.pairs.collect()}
    assert {tuple(r) for r in files.read_pairs(spark, f"{out}/pairs").collect()} == known
    p = {r["spec2"]: r["p"] for r in pipeline.predict(spark, str(folder / "specs"), str(folder / "user.csv"), f"{out}/vocabulary", f"{out}/model").collect()}
    assert p["www.b.com//1"] > 0.5 > p["www.a.com//30"]
    # The mode says how texts are read, whoever calls: the same weights in the other mode give other numbers.
    m = files.read_model(spark, f"{out}/model")
    m.mode = "bow" if mode == "tfidf" else "tfidf"
    other = {r["spec2"]: r["p"] for r in pipeline.predict(spark, str(folder / "specs"), str(folder / "user.csv"), found.vocabulary, m).collect()}
    assert abs(other["www.a.com//30"] - p["www.a.com//30"]) > 1e-6


def test_model_of_lines_predicts(spark, folder):
    vocabulary = spark.createDataFrame([("lens", 0, 3, 1.0), ("strap", 1, 3, 1.0)], "token string, position bigint, df bigint, idf double")
    (folder / "m.csv").write_text("bow\n0.000100\n1.0\n2\n-3.0\n-3.0\n")
    p = {r["spec2"]: r["p"] for r in pipeline.predict(spark, str(folder / "specs"), str(folder / "user.csv"), vocabulary, str(folder / "m.csv")).collect()}
    assert p["www.b.com//1"] == pytest.approx(0.7310586, abs=1e-6) and p["www.a.com//30"] < 0.001
    with pytest.raises(ValueError):
        pipeline.predict(spark, str(folder / "specs"), str(folder / "user.csv"), vocabulary.limit(1), str(folder / "m.csv"))


def test_shell(spark, folder, capsys):
    out = str(folder / "shell")
    main(["train", "--dir", str(folder / "specs"), "--csv", str(folder / "labels.csv"), "--out", out, "--epochs", "2"])
    assert "F1" in capsys.readouterr().out
    main(["predict", "--dir", str(folder / "specs"), "--csv", str(folder / "user.csv"), "--vocabulary", f"{out}/vocabulary", "--model", f"{out}/model", "--out", f"{out}/p"])
    assert spark.read.csv(f"{out}/p", header=True).count() == 2
    with pytest.raises(SystemExit):
        options().parse_args(["train", "--dir", "x", "--csv", "y", "--out", "z", "--mode", "other"])
