"""Cosines of many vectors with many queries: both sides in blocks, a pair of blocks is a product of two matrices.

Scores are whole millionths, rounded half up as the engine rounds; where a product lies too near to a half for its last digits
to be trusted the sum is made again in order. Vectors without length, of another length than the query, null or with nulls
have no score and come last; not-a-number comes first.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.shared import written

#: Rows and queries of a block.
ROWS, ASKED = 4096, 256
#: In place of a score: none at all, and not a number.
NONE, NAN = -2_000_000, 2_000_000
MILLION = 1_000_000


def in_blocks(df: DataFrame, columns: list[str], size: int, by: str | None = None) -> DataFrame:
    """``df`` with ``size`` rows in one at most: arrays of the columns, and ``by``, which is the same for all of them."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in columns}

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                group = batch.column(by).to_numpy(zero_copy_only=False) if by else np.zeros(n)
                cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [n]])
                made = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column(c)) for c in columns]
                yield pa.RecordBatch.from_arrays(made + ([batch.column(by).take(pa.array(cuts[:-1]))] if by else []), columns + ([by] if by else []))

    schema = ", ".join([*(f"{c} array<{k}>" for c, k in kinds.items()), *([f"{by} {df.schema[by].dataType.simpleString()}"] if by else [])])
    if by:
        df = df.repartitionByRange(F.col(by), F.col(columns[0])).sortWithinPartitions(by)
    return written(df.select(*columns, *([by] if by else [])).mapInArrow(run, schema), "blocks", size)


def _by_length(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the places and the matrix of the vectors that have no null."""
    size = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if vectors.flatten().null_count:
        size = np.array([-1 if v is None or None in v else len(v) for v in vectors.to_pylist()])
    out = {}
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        out[n] = at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
    return out


def _one(a: np.ndarray, b: np.ndarray) -> int:
    dot = lambda x, y: np.cumsum(x * y)[-1]  # noqa: E731  in order
    score = dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))
    return int(Decimal(repr(float(score))).scaleb(6).to_integral_value(ROUND_HALF_UP))


def cosines(asked: pa.ListArray, rows: pa.ListArray) -> np.ndarray:
    """Millionths: a line for each query, a column for each row."""
    out = np.full((len(asked), len(rows)), NONE, dtype=np.int64)
    there = _by_length(rows)
    for n, (i, a) in _by_length(asked).items():
        if n in there:
            j, b = there[n]
            with np.errstate(all="ignore"):
                norm = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))
                exact = a @ b.T / norm * MILLION
                whole = np.floor(np.abs(exact) + 0.5)
                near = np.abs(np.abs(exact) + 0.5 - np.round(np.abs(exact) + 0.5)) < 1e-6
                score = np.where(np.isnan(exact), NAN, np.sign(exact) * whole)
            for x, y in np.argwhere(near & (np.abs(whole) > 0) | near & (np.abs(exact) > 0.25)).tolist():
                score[x, y] = _one(a[x], b[y])
            score[norm == 0] = NONE
            out[np.ix_(i, j)] = score.astype(np.int64)
    return out


def _pairs(rows: DataFrame, asked: DataFrame, by: str | None) -> DataFrame:
    """Each block of rows beside each block of queries; nothing is sent through the driver."""
    return rows.join(asked, by) if by else rows.hint("shuffle_replicate_nl").crossJoin(asked)


def each_pair(rows: DataFrame, asked: DataFrame, found, schema: str, by: str | None = None) -> DataFrame:
    """What ``found`` (a pair of blocks as a dictionary of arrays -> record batch) makes of each pair. Four pairs are in a worker at a time at most."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield found({c: batch.column(c)[k].values for c in batch.schema.names if c != by})

    return written(_pairs(rows, asked, by).mapInArrow(run, schema), "found", 4)


def top(rows: DataFrame, asked: DataFrame, key: str, k: int, by: str | None = None) -> DataFrame:
    """query, key, score, place: of each query the k best rows but itself, by score, then key. ``rows``: blocks of key, _r; ``asked``: blocks of query, _v."""
    kind = rows.schema[key].dataType.elementType

    def best(x):
        ids, q = x[key].to_numpy(), x["query"].to_numpy()
        score = cosines(x["_v"], x["_r"])
        nth = np.empty(len(ids), dtype=np.int64)
        nth[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        order = np.where(ids == q[:, None], np.iinfo(np.int64).min, score * len(ids) - nth)
        few = min(k, len(ids))
        at = np.argpartition(-order - 1, few - 1, axis=1)[:, :few]
        line = np.repeat(np.arange(len(q)), few)
        at = at.ravel()
        other = ids[at] != q[line]
        line, at = line[other], at[other]
        got = score[line, at]
        value = pa.array(np.where(got == NAN, np.nan, got / MILLION), mask=got == NONE)
        return pa.RecordBatch.from_arrays([pa.array(q[line]), pa.array(ids[at]), value], ["query", key, "score"])

    scored = each_pair(rows, asked, best, f"query {kind.simpleString()}, {key} {kind.simpleString()}, score double", by)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def first_hits(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """q, first: the place among all rows but the query itself, by score, then id, of the first with the query's label; null if there is none.

    rows: id, vector, label; asked: q, v, l. The best hit of each query is found first; then what stands before it is counted.
    """
    rows = in_blocks(rows.where("id IS NOT NULL"), ["id", "vector", "label"], ROWS)

    def hits(x):
        ids, q = x["id"].to_numpy(), x["q"].to_numpy()
        label = lambda c: np.array([np.nan if y is None else y for y in x[c].to_pylist()], dtype=float)
        other = ids != q[:, None]
        hit = other & (label("label") == label("l")[:, None])
        score = np.where(hit, cosines(x["v"], x["vector"]), NONE - 1)
        most = score.max(axis=1)
        least = np.where(score == most[:, None], ids, np.iinfo(np.int64).max).min(axis=1)
        some, none = other.any(axis=1), pa.array(~hit.any(axis=1))
        pick = pa.array(some)
        made = [pa.array(q), pa.array(most, mask=none.to_numpy(zero_copy_only=False)), pa.array(-least, mask=none.to_numpy(zero_copy_only=False))]
        return pa.RecordBatch.from_arrays([c.filter(pick) for c in made], ["q", "s", "back"])

    best = each_pair(rows, in_blocks(asked, ["q", "v", "l"], ASKED), hits, "q long, s long, back long").groupBy("q").agg(F.max(F.when(F.col("s").isNotNull(), F.struct("s", "back"))).alias("b"))
    best = written(best.select("q", F.col("b.s").alias("s"), F.col("b.back").alias("back")), "best")

    def before(x):
        ids, q, s, at = (x[c].to_numpy() for c in ("id", "q", "s", "back"))
        score = cosines(x["v"], x["vector"])
        n = ((ids != q[:, None]) & ((score > s[:, None]) | (score == s[:, None]) & (ids < -at[:, None]))).sum(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(n)], ["q", "n"])

    counted = each_pair(rows, in_blocks(asked.join(best.where("s IS NOT NULL"), "q"), ["q", "v", "s", "back"], ASKED), before, "q long, n long").groupBy("q").agg((F.sum("n") + 1).alias("first"))
    return best.select("q").join(counted, "q", "left")
