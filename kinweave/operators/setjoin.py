"""Exact similarity self-join of sets: rows meet on the rare tokens that any partner must share."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.text import set_similarity
from kinweave.shared import discard, written


def similar_sets(sets: DataFrame, key: str, tokens: str, threshold: float) -> DataFrame:
    """a, b (a < b), similarity of all pairs with a Jaccard similarity of at least ``threshold`` (over 0). Keys are unique.

    Tokens are ordered by how many sets hold them. Of a set of n tokens any partner shares one of the
    n - ceil(threshold * n) + 1 rarest, so only these are met on; size and exact similarity decide. Empty sets
    pair with nothing. No pair is lost, however common a token is: it is met on only in sets that have no rarer ones to show.
    """
    sets = written(sets.select(F.col(key).alias("k"), F.col(tokens).alias("t"), F.size(tokens).alias("n")).where("n > 0"), "sets")
    place = sets.select("k", "n", F.explode("t").alias("x"))
    counts = place.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    nth = F.row_number().over(Window.partitionBy("k").orderBy("c", "x"))
    index = place.join(counts, "x").withColumn("p", nth).where(F.col("p") <= F.col("n") - F.ceil(threshold * F.col("n") - F.lit(1e-9)) + 1).select("k", "n", "x")
    a, b = (index.select("x", F.col("k").alias(s), F.col("n").alias(f"n{s}")) for s in "ab")
    met = a.join(b, "x").where("a < b").where((F.least("na", "nb") + 1e-9 >= threshold * F.greatest("na", "nb"))).select("a", "b").distinct()
    left, right = (sets.select(F.col("k").alias(s), F.col("t").alias(f"t{s}")) for s in "ab")
    return met.join(left, "a").join(right, "b").select("a", "b", set_similarity(F.col("ta"), F.col("tb")).alias("similarity")).where(F.col("similarity") >= threshold)


#: Sets of a block at most, and the fewest that are worth one of their own.
BLOCK, LEAST = 16384, 256
#: Blocks that are wanted at least, for the sake of tasks.
BLOCKS = 24
#: The most frequent tokens have a bit of their own, so many. This decides cost, never results.
BITS = 8192
#: Bits of a sketch, and what is used of it by the mean size of the sets.
SKETCH, USED = 1024, ((450, 256), (750, 512))
#: Rows and columns of a product, and pairs that are verified at once.
TILE, VERIFIED = (512, 4096), 512


def hashed(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each string, one token a string."""
    digest = lambda x: b"" if x is None else hashlib.blake2b(x.encode(), digest_size=8).digest()
    return np.array([int.from_bytes(digest(x), "little", signed=True) for x in tokens.to_pylist()], dtype=np.int64), np.ones(len(tokens), dtype=np.int64)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then those of the next."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


#: Strings into the codes of their tokens, one string's after another's, and how many each has.
Cut = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def _token_sets(cut: Cut) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """g, t (lists of strings) into g, t (codes of the distinct tokens that ``cut`` makes of them), n. Empty sets go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lists = batch.column("t")
                each = lists.flatten().dictionary_encode(null_encoding="encode")
                made, size = cut(each.dictionary)
                kinds, ids = np.unique(made, return_inverse=True)
                wide = max(len(kinds), 1)
                codes = each.indices.to_numpy(zero_copy_only=False)
                took = size[codes]
                base = np.repeat(np.arange(batch.num_rows) * wide, lists.value_lengths().fill_null(0).to_numpy())
                key = np.repeat(base, took) + ids[_ragged((np.cumsum(size) - size)[codes], took)]
                if batch.num_rows * wide <= 1 << 26:
                    seen = np.zeros(batch.num_rows * wide, dtype=bool)
                    seen[key] = True
                    key = np.flatnonzero(seen)
                else:
                    key = np.unique(key)
                n = np.bincount(key // wide, minlength=batch.num_rows)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(kinds[key % wide], pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("g"), tokens, pa.array(n, pa.int32())], ["g", "t", "n"]).filter(pa.array(n > 0))

    return run


def _marks(frequent: np.ndarray, sizes: np.ndarray, before: np.ndarray, counts: np.ndarray, block: int, cells: list[list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """k, g, t, n into g, n, bits of the frequent tokens, rare tokens, parities of all tokens in SKETCH places, block and the cells that it is in.

    ``sizes`` are all sizes of sets, ascending, ``counts`` the sets of each and ``before`` those of smaller ones: sets of equal size are dealt out by k.
    """
    order = np.argsort(frequent)
    ascending = frequent[order]
    places = pa.array([len(c) for c in cells], pa.int32()), pa.array(np.concatenate([np.array(c, dtype=np.int64) for c in cells]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = lambda m: pa.FixedSizeBinaryArray.from_buffers(pa.binary(m.shape[1]), len(m), [None, pa.py_buffer(np.ascontiguousarray(m))]).cast(pa.binary())
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                rows = batch.num_rows
                n = batch.column("n").to_numpy().astype(np.int64)
                t = batch.column("t").flatten().to_numpy()
                row = np.repeat(np.arange(rows), n)
                near = np.minimum(np.searchsorted(ascending, t), len(ascending) - 1)
                often = ascending[near] == t
                rank = order[near]
                bits = np.zeros(rows * BITS, dtype=np.uint8)
                bits[row[often] * BITS + rank[often]] = 1
                spot = np.where(often, rank, t.view(np.uint64) % np.uint64(SKETCH)).astype(np.int64) % SKETCH
                parity = (np.bincount(row * SKETCH + spot, minlength=rows * SKETCH) & 1).astype(np.uint8)
                rare = np.bincount(row[~often], minlength=rows)
                rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare)]), pa.int32()), pa.array(t[~often], pa.int64()))
                kind = np.searchsorted(sizes, n)
                k = batch.column("k").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                mine = (before[kind] + ((k >> np.uint64(20)) % counts[kind].astype(np.uint64)).astype(np.int64)) // block
                took = places[0].to_numpy()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(took[mine])]), pa.int32()), places[1].take(pa.array(_ragged((np.cumsum(took) - took)[mine], took[mine]))))
                yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("n"), fixed(np.packbits(bits.reshape(rows, BITS), axis=1)), rest, fixed(np.packbits(parity.reshape(rows, SKETCH), axis=1)), pa.array(mine, pa.int64()), lists], ["g", "n", "bits", "rare", "sketch", "block", "cell"])

    return run


class _Side:
    """Sets of a block, by size."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("n").combine_chunks()
        column = lambda c: rows.column(c).combine_chunks() if isinstance(rows.column(c), pa.ChunkedArray) else rows.column(c)
        matrix = lambda c, width: np.frombuffer(b"".join(column(c).to_pylist()), dtype=np.uint8).reshape(-1, width // 8)
        self.n = column("n").to_numpy().astype(np.int64)
        self.bits = matrix("bits", BITS).view(np.uint64)
        self.sketch = matrix("sketch", SKETCH)
        self.rare_n = column("rare").value_lengths().to_numpy().astype(np.int64)
        self.rare_at = np.cumsum(self.rare_n) - self.rare_n
        self.rare = column("rare").flatten().to_numpy()
        groups = column("g").dictionary_encode()
        self.group, self.groups = groups.indices.to_numpy().astype(np.int64), groups.dictionary.to_pylist()

    def signs(self, used: int, last: list) -> np.ndarray:
        """1 for an even and -1 for an odd count in each of ``used`` places, and two columns more."""
        odd = np.bitwise_xor.reduce(np.unpackbits(self.sketch, axis=1).reshape(len(self.n), SKETCH // used, used), axis=1)
        out = np.empty((len(self.n), used + 2), dtype=np.float32)
        np.subtract(1, 2 * odd.astype(np.int8), out=out[:, :used], casting="unsafe")
        out[:, used], out[:, used + 1] = last
        return out


def _common_rare(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many rare tokens the sets of each pair share."""
    out = np.zeros(len(i), dtype=np.int64)
    if not len(i):
        return out
    words = np.unique(np.concatenate([a.rare, b.rare]))
    held = np.sort(np.repeat(np.arange(len(b.n)), b.rare_n) * len(words) + np.searchsorted(words, b.rare))
    own = np.searchsorted(words, a.rare)
    cuts = np.searchsorted(np.cumsum(a.rare_n[i]), np.arange(0, a.rare_n[i].sum() + 1, 1 << 21)[1:]).tolist()
    for lo, hi in zip([0, *(c + 1 for c in cuts)], [*(c + 1 for c in cuts), len(i)], strict=True):
        x, y = i[lo:hi], j[lo:hi]
        if len(x):
            key = np.repeat(y, a.rare_n[x]) * len(words) + own[_ragged(a.rare_at[x], a.rare_n[x])]
            found = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key
            out[lo:hi] = np.bincount(np.repeat(np.arange(len(x)), a.rare_n[x])[found], minlength=len(x))
    return out


def _links(a: _Side, b: _Side, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of sets whose similarity reaches the threshold; of one block with itself, each pair once.

    Each place in which two sketches differ holds a token of only one of the sets, and of these a linked pair has at most
    (1 - threshold) / (1 + threshold) of both sizes: the product of the signs tells which pairs can link. They are then counted exactly.
    """
    used = next((u for most, u in USED if (a.n.mean() + b.n.mean()) / 2 <= most), SKETCH)
    share = 2 * (1 - threshold) / (1 + threshold)
    left = a.signs(used, [share * a.n, 1])
    right = b.signs(used, [1, share * b.n])
    ones = np.ones(BITS // 64, dtype=np.float32)
    doubtful = []

    def reached(common: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (common > 0) & (common / (a.n[i] + b.n[j] - common) >= threshold)

    for top in range(0, len(a.n), TILE[0]):
        end = min(top + TILE[0], len(a.n))
        first = int(np.searchsorted(b.n, threshold * a.n[top] - 1e-6))
        last = int(np.searchsorted(b.n, (a.n[end - 1] + 1e-6) / threshold, "right"))
        for at in range(max(first, top) if same else first, last, TILE[1]):
            product = left[top:end] @ right[at : min(at + TILE[1], last)].T
            pairs = np.flatnonzero(product.ravel() >= used - 0.5)
            i, j = np.divmod(pairs, product.shape[1])
            i, j = i + top, j + at
            if same:
                i, j = i[i < j], j[i < j]
            common = np.empty(len(i), dtype=np.int64)
            for p in range(0, len(i), VERIFIED):
                x, y = i[p : p + VERIFIED], j[p : p + VERIFIED]
                common[p : p + VERIFIED] = np.bitwise_count(a.bits[x] & b.bits[y]).astype(np.float32) @ ones
            sure = reached(common, i, j)
            yield i[sure], j[sure]
            more = ~sure & reached(common + np.minimum(a.rare_n[i], b.rare_n[j]), i, j)
            if more.any():
                doubtful.append((common[more], i[more], j[more]))
            if doubtful and (sum(len(x[0]) for x in doubtful) > 1_000_000):
                common, i, j = map(np.concatenate, zip(*doubtful, strict=True))
                doubtful.clear()
                ok = reached(common + _common_rare(a, b, i, j), i, j)
                yield i[ok], j[ok]
    if doubtful:
        common, i, j = map(np.concatenate, zip(*doubtful, strict=True))
        ok = reached(common + _common_rare(a, b, i, j), i, j)
        yield i[ok], j[ok]


def _counted(a: _Side, b: _Side, same: bool, threshold: float) -> dict[tuple, int]:
    """Links by pair of groups, the smaller group first; those within a group go."""
    wide = len(b.groups)
    sums: dict[int, int] = defaultdict(int)
    for i, j in _links(a, b, same, threshold):
        codes, times = np.unique(a.group[i] * wide + b.group[j], return_counts=True)
        for c, m in zip(codes.tolist(), times.tolist(), strict=True):
            sums[c] += m
    out: dict[tuple, int] = defaultdict(int)
    for c, m in sums.items():
        p, q = a.groups[c // wide], b.groups[c % wide]
        if p != q:
            out[min(p, q), max(p, q)] += m
    return out


def similar_by_group(sets: DataFrame, group: str, tokens: str, threshold: float, cut: Cut = hashed) -> DataFrame:
    """a, b (a < b), pairs: how many pairs of sets of two groups have a Jaccard similarity of at least ``threshold`` (over 0).

    A set is the distinct tokens that ``cut`` makes of the strings in ``tokens``, each a 64-bit code. For sets of few kinds of token, which any prefix
    of tokens would bring together. Sets stand in blocks by size, and two blocks whose sizes can agree meet in a cell, a task's group:
    a product of two matrices of signs tells which pairs can link, and these are counted by bits. Only counts leave a cell.
    No set is left out; sets without tokens or group pair with nothing.
    """
    spark = sets.sparkSession
    kind = sets.schema[group].dataType.simpleString()
    named = sets.where(F.col(group).isNotNull() & (F.size(tokens) > 0)).select(F.col(group).alias("g"), F.col(tokens).cast("array<string>").alias("t"))
    sized = written(named.mapInArrow(_token_sets(cut), f"g {kind}, t array<long>, n int").withColumn("k", F.monotonically_increasing_id()), "sets", 2048)
    # what comes to the driver: the sizes that occur, and BITS tokens
    sizes, counts = (np.array(x, dtype=np.int64) for x in zip(*sorted(map(tuple, sized.groupBy("n").count().collect())), strict=True)) if (there := sized.head(1)) else ([], [])
    if not there:
        return spark.createDataFrame([], f"a {kind}, b {kind}, pairs long")
    often = sized.select(F.explode("t").alias("x")).groupBy("x").count().orderBy(F.desc("count"), "x").limit(BITS)
    frequent = np.array([r["x"] for r in often.collect()], dtype=np.int64)
    total, before = int(counts.sum()), np.cumsum(counts) - counts
    block = min(BLOCK, max(LEAST, -(-total // BLOCKS)))
    firsts = np.arange(0, total, block)
    least, most = (sizes[np.searchsorted(before, x, "right") - 1] for x in (firsts, np.minimum(firsts + block, total) - 1))
    cells: list[list[int]] = [[] for _ in firsts]
    for i in range(len(firsts)):
        for j in range(i, len(firsts)):
            if threshold * least[j] <= most[i] + 1e-6:
                for side in {i, j}:
                    cells[side].append(i * len(firsts) + j)
    wide = len(firsts)
    tasks = min(sum(map(len, cells)), 2000)

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = divmod(key[0].as_py(), wide)
        at = rows.column("block").to_numpy()
        sides = [_Side(rows.filter(pa.array(at == x))) for x in ((i,) if i == j else (i, j)) if (at == x).any()]
        got = _counted(sides[0], sides[-1], i == j, threshold) if len(sides) == len({i, j}) else {}
        kinds = rows.schema.field("g").type
        return pa.table([pa.array([p for p, _ in got], kinds), pa.array([q for _, q in got], kinds), pa.array(list(got.values()), pa.int64())], ["a", "b", "pairs"])

    marked = sized.mapInArrow(_marks(frequent, sizes, before, counts, block, cells), f"g {kind}, n int, bits binary, rare array<long>, sketch binary, block long, cell array<long>")
    dealt = marked.withColumn("cell", F.explode("cell")).repartition(tasks, "cell")
    met = written(dealt.groupBy("cell").applyInArrow(count, f"a {kind}, b {kind}, pairs long"), "pairs", 2048)
    discard(sized)
    return met.groupBy("a", "b").agg(F.sum("pairs").alias("pairs"))
