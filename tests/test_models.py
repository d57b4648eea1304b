import numpy as np
import pytest

from kindred.operators.matcher import Matcher
from kindred.sources import files


def test_model_round_trip(spark, tmp_path):
    model = Matcher(np.array([0.1, -1 / 3, 2e-17]), -0.25, 0.0001, "bow")
    files.write_model(spark, model, str(tmp_path / "m"))
    back = files.read_model(spark, str(tmp_path / "m"))
    assert back.weights.tolist() == model.weights.tolist()
    assert (back.bias, back.learning_rate, back.mode) == (model.bias, model.learning_rate, model.mode)


def test_model_of_text_lines(spark, tmp_path):
    path = tmp_path / "model.csv"
    path.write_text("tfidf\n0.000100\n-0.732401\n3\n0.491239\n0.387323\n-0.5\n")
    model = files.read_model_text(spark, str(path))
    assert (model.mode, model.learning_rate, model.bias, model.weights.tolist()) == ("tfidf", 0.0001, -0.732401, [0.491239, 0.387323, -0.5])
    path.write_text("tfidf\n0.000100\n-0.732401\n3\n0.491239\n")
    with pytest.raises(ValueError):
        files.read_model_text(spark, str(path))
