"""python -m kindred train|predict: the ways in, from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import pipeline


def options() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="kindred")
    ways = parser.add_subparsers(dest="way", required=True)
    train, predict = ways.add_parser("train"), ways.add_parser("predict")
    for p in (train, predict):
        p.add_argument("--dir", required=True, help="folder of <site>/<num>.json")
        p.add_argument("--csv", required=True, help="pairs: left_spec_id,right_spec_id, and for train label")
    train.add_argument("--stopwords")
    train.add_argument("--mode", choices=["tfidf", "bow"], default="tfidf")
    train.add_argument("--out", required=True)
    train.add_argument("--epochs", type=int, default=pipeline.M.EPOCHS)
    train.add_argument("--self-training", action="store_true")
    predict.add_argument("--vocabulary", required=True)
    predict.add_argument("--model", required=True)
    predict.add_argument("--out", required=True)
    return parser


def main(args: list[str] | None = None) -> None:
    o = options().parse_args(args)
    spark = SparkSession.builder.appName("kindred").getOrCreate()
    if o.way == "train":
        found = pipeline.train(spark, o.dir, o.csv, o.stopwords, o.mode, o.out, epochs=o.epochs, self_training=o.self_training)
        print(f"F1 on pairs held out: {found.f1}")
    else:
        pipeline.predict(spark, o.dir, o.csv, o.vocabulary, o.model).write.mode("overwrite").csv(o.out, header=True)


if __name__ == "__main__":
    main()
