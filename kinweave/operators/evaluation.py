"""Resampling intervals that are the same on every run."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.shared import written

# Fixed values of the generator: state = state * MULTIPLIER + INCREMENT in 64 bits, from SEED.
SEED, MULTIPLIER, INCREMENT = 0x9E3779B97F4A7C15, 6364136223846793005, 1442695040888963407
WORD = 1 << 64


def jumped(state: int, steps: int) -> int:
    """The state after so many steps, by doubling."""
    a, c, mul, add = 1, 0, MULTIPLIER, INCREMENT
    while steps:
        if steps & 1:
            a, c = a * mul % WORD, (c * mul + add) % WORD
        mul, add = mul * mul % WORD, (mul + 1) * add % WORD
        steps >>= 1
    return (a * state + c) % WORD


def draws(start: int, n: int, block: int = 1 << 16):
    """The next n states after ``start``, in blocks: a block is the first one's states moved on by the block's length."""
    left, at = n, start
    while left:
        size = min(block, left)
        out = np.empty(size, dtype=np.uint64)
        out[0] = (at * MULTIPLIER + INCREMENT) % WORD
        have, mul, add = 1, MULTIPLIER, INCREMENT
        while have < size:
            more = min(have, size - have)
            out[have : have + more] = out[:more] * np.uint64(mul) + np.uint64(add)
            have, mul, add = have + more, mul * mul % WORD, (mul + 1) * add % WORD
        yield out
        at, left = int(out[-1]), left - size


def nearest_rank(column: str, p: float):
    x = F.sort_array(F.collect_list(column))
    return F.element_at(x, F.round((F.size(x) - 1) * p).cast("int") + 1)


def paired_bootstrap(rows: DataFrame, samples: int, chunk: int = 1 << 18) -> DataFrame:
    """low, high, difference of the mean of ``d`` over rows (i from 0 without gaps, d). No rows: zeros.

    A task's row is ``chunk`` draws of a sample, made from where the generator stands by then; they are counted by index before
    they meet the rows. There are ``samples`` times as many draws as rows, so the join is dealt by index: neither side is ever
    sent through the driver, whatever size the planner takes the draws for.
    """
    rows = written(rows, "rows")
    n = rows.count()
    spark = rows.sparkSession
    if not n:
        return spark.createDataFrame([(0.0, 0.0, 0.0)], "low double, high double, difference double")
    chunks = -(-n // chunk)

    def drawn(batches):
        for pdf in batches:
            for at in pdf["id"].tolist():
                k, c = divmod(at, chunks)
                for states in draws(jumped(SEED, k * n + c * chunk), min(chunk, n - c * chunk)):
                    i, times = np.unique(states % np.uint64(n), return_counts=True)
                    yield pd.DataFrame({"sample": np.full(len(i), k), "i": i.astype(np.int64), "times": times})

    parts = min(samples * chunks, max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    picked = spark.range(0, samples * chunks, 1, parts).mapInPandas(drawn, "sample long, i long, times long")
    means = picked.join(rows.hint("shuffle_hash"), "i").groupBy("sample").agg((F.sum(F.col("times") * F.col("d")) / n).alias("m"))
    observed = rows.agg((F.sum("d") / n).alias("o")).first()["o"]
    return means.agg(F.round(nearest_rank("m", 0.025), 6).alias("low"), F.round(nearest_rank("m", 0.975), 6).alias("high"), F.round(F.lit(observed), 6).alias("difference"))


def document_bootstrap(counts: DataFrame, samples: int, seed: int) -> DataFrame:
    """correct, total, ratio, low, high over documents (document, correct, total). One seeded generator draws all samples in turn,
    so one task draws them; documents come as two numbers each, in order of their name."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("document")
        values = list(zip(pdf["correct"].tolist(), pdf["total"].tolist(), strict=True))
        rng, ratios = random.Random(seed), []
        for _ in range(samples if len(values) > 1 else 0):
            picks = [values[rng.randrange(len(values))] for _ in values]
            total = sum(t for _, t in picks)
            if total:
                ratios.append(sum(c for c, _ in picks) / total)
        ratios.sort()
        c, t = sum(c for c, _ in values), sum(t for _, t in values)
        low, high = (ratios[int(p * (len(ratios) - 1))] if ratios else None for p in (0.025, 0.975))
        return pd.DataFrame([(c, t, c / t if t else None, low, high)], columns=["correct", "total", "ratio", "low", "high"])

    return counts.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "correct long, total long, ratio double, low double, high double")
