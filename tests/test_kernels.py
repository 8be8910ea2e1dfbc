"""Golden cases of scalars and kernels."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinweave.functions import numbers, text
from kinweave.operators import graph, rules
from kinweave.sources.archive import HERE


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("x")).first()["x"]


def test_trigram_similarity(spark):
    assert one(spark, text.similarity(F.col("a"), F.col("b")), a="word", b="two words") == pytest.approx(4 / 11)
    assert one(spark, text.similarity(F.col("a"), F.col("b")), a="", b="") == 0


@pytest.mark.parametrize(("raw", "want"), [("أحمد بن عليّ", "احمد بن علي"), ("فاطمة", "فاطمه"), ("مـحـمد", "محمد"), ("هدى-سعيد", "هدي سعيد"), (None, None)])
def test_normalise_name(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "a string").select(text.normalise_name(F.col("a")).alias("x"))
    assert df.first()["x"] == want


def test_particle_key(spark):
    assert one(spark, text.particle_key(F.col("a")), a="ابو بن سعيد") == "سعيد"
    assert one(spark, text.compact_key(F.col("a")), a="عبد ١٢") == "عبد12"


def test_interval(spark):
    lower, upper, _ = rules.interval("pf", "pt", "cf", "ct")
    df = spark.sql("SELECT date'1100-01-01' pf, date'1110-01-01' pt, date'1130-01-01' cf, date'1140-01-01' ct").select(lower.alias("l"), upper.alias("u")).first()
    assert df["l"] == pytest.approx(20, abs=0.05) and df["u"] == pytest.approx(40, abs=0.05)


def test_haversine(spark):
    km = one(spark, numbers.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=0.0, b=0.0, c=0.0, d=90.0)
    assert km == pytest.approx(10007.557, abs=0.01)


def test_wilson_bounds(spark):
    low, high = numbers.wilson(F.col("h"), F.col("n"))
    assert one(spark, low, h=0, n=0) == 0 and one(spark, high, h=0, n=0) == 0
    assert one(spark, low, h=8, n=10) == pytest.approx(0.4902, abs=1e-3)


def test_word_similarity(spark):
    best = F.expr(HERE.word_similarity("a", "b"))
    assert one(spark, best, a="word", b="two words") == pytest.approx(0.8) and one(spark, best, a="word", b="") == 0 and one(spark, best, a="red", b="a red fox") == 1


def test_two_triangles_are_two_communities():
    e = pd.DataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)], columns=["a", "b"])
    got = graph.modularity_communities(e)
    assert sorted(map(tuple, got.groupby("community")["node"].apply(sorted))) == [(1, 2, 3), (4, 5, 6)]


def test_bfs_caps_and_says_so(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 50)], "a long, b long")
    root = spark.createDataFrame([(0,)], "id long")
    full, cut = graph.bounded_bfs(star, root, 2, cap=50).collect(), graph.bounded_bfs(star, root, 2, cap=10).collect()
    assert len(full) == 50 and not full[0]["truncated"]
    assert [r["id"] for r in cut] == list(range(10)) and cut[0]["truncated"]


def test_bfs_ends_on_a_cycle(spark):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")
    got = {r["id"]: r["depth"] for r in graph.bounded_bfs(ring, spark.createDataFrame([(1,)], "id long"), 5).collect()}
    assert got == {1: 0, 2: 1, 3: 2}
