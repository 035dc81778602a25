import random

from typeloom import evaluation
from typeloom.engine import Engine
from typeloom.settings import QuerySettings
from typeloom.sources.definitions import read_lines

LINES = ["type scala.Int", "type scala.Long", "type scala.Float", "p.a: scala.Int", "p.b: scala.Long", "p.c: scala.Float", "p.d: <methodInvocation1>[scala.Int, scala.Long]"]


def test_benchmark_and_search_over_settings(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))
    e.index("x", read_lines(spark.createDataFrame([(x,) for x in LINES], "value string")))
    e.finalize("x")
    golden = spark.createDataFrame([("Int", "p.a: scala.Int"), ("Float", "p.c: scala.Float"), ("Int => Long", "p.d: <methodInvocation1>[scala.Int, scala.Long]"), ("(", "none")], "query string, relevant_signature string")
    means = evaluation.benchmark(e, golden, str(tmp_path / "out")).first()
    assert means["map"] == 0.75 and means["mean_recall_5"] == 0.75
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "out")).count() == 4
    best, metrics = evaluation.random_search(e, golden, 2)
    assert isinstance(best, QuerySettings) and 0 <= metrics.first()["map"] <= 1


def test_random_settings():
    drawn = [evaluation.draw(random.Random(i), QuerySettings()) for i in range(50)]
    assert all(0 <= s.penalty_weight <= 0.3 and s.frequency_weight >= 1.1 for s in drawn)
    values = [evaluation.normal(rng, 2, 3) for rng in [random.Random(1)] for _ in range(4000)]
    mean = sum(values) / len(values)
    assert abs(mean - 2) < 0.2 and abs((sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5 - 3) < 0.2
