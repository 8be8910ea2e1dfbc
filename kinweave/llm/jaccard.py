"""Exact Jaccard self-join of documents on word n-grams, through a token-group matrix.

1. Documents with the same shingle set become one node (its smallest doc_id).
2. Similar nodes are partitioned into groups: nodes that share a min-hash meet its smallest holder, and
   where the exact overlap says they link, they join its group. These links are kept.
3. The matrix has a row for each (token, group): each group's union of its members' index tokens. A
   node's index tokens are all but the ceil(threshold x size) - 1 most frequent of its set, in one order of
   all tokens (a bounded count sketch, then hash). A query's overlap with a group is bounded by its matches
   in the matrix plus the tokens that are not indexed; groups whose bound is below the overlap that a link
   needs, or with no member of a fitting size, stay closed.
4. Only qualifying groups are opened: the query meets their members of fitting size and the exact overlap
   decides. Links of 2 and 4 make the components.

Shingles and sets are 64-bit hashes of whole texts; no candidate is capped. The sketch orders tokens and
decides nothing, so results are the same whatever its width.

Null and empty texts, and texts without words, have no shingles and link with nothing, not even one
another. A text with fewer words than n is one shingle. Rows with null doc_id get null components. Rows
that share a doc_id are one node for links; each comes back with its own count. No rows give no rows. Very long
texts are read whole, a slice of a batch at a time; other columns are not read, so they clash with nothing.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.components import components
from kinweave.llm.batches import put_away, slices
from kinweave.llm.sieve import bloom, passes
from kinweave.shared import discard, written

SLICE = 1 << 16
#: Hashes in an outgoing batch.
FLUSH = 1 << 20
#: Rows of an incoming batch of texts.
BATCH_ROWS = 2000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte (upper-case ASCII as lower-case), and which bytes are white space."""
    of = np.random.default_rng(23).integers(1, 2**64, 256, dtype=np.uint64)
    of[65:91] = of[97:123]
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return of, space


BYTES, SPACES = _byte_tables()
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and 64-bit hash of each word: differences of one running polynomial, moved to the same power and mixed."""
    b = np.frombuffer(raw, dtype=np.uint8)
    gap = SPACES[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
    lo, hi = edge[::2], edge[1::2]
    run = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(BYTES[b] * _powers(BASE, len(b)), out=run[1:])
    return lo, _mix((run[hi] - run[lo]) * _powers(BACK, len(b) + 1)[lo] + (hi - lo).astype(np.uint64))


def shingle_sets(texts: list[str | None], n: int = 5, most: int = 1 << 19):
    """Of each text the sorted distinct hashes of its n-word shingles, computed for about ``most`` bytes of text at a time."""
    lo = 0
    while lo < len(texts):
        raws, size = [], 0
        while lo + len(raws) < len(texts) and (not raws or size < most):
            raws.append((texts[lo + len(raws)] or "").encode("utf-8", "replace"))
            size += len(raws[-1]) + 1
        lo += len(raws)
        starts, h = hashed_words(b"\n".join(raws))
        stops = np.cumsum([len(r) + 1 for r in raws])
        of = np.searchsorted(stops, starts, side="right")  # each word's text
        last = np.searchsorted(of, np.arange(len(raws)), side="right")
        first = np.concatenate([[0], last[:-1]])
        whole = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
        for i in range(n):
            whole = _mix(whole * M1 + h[i : len(h) - n + 1 + i] + np.uint64(i + 1)) if len(whole) else whole
        for a, z in zip(first.tolist(), last.tolist(), strict=True):
            if z - a >= n:
                yield np.unique(whole[a : z - n + 1] + np.uint64(n))
            elif z > a:
                few = np.zeros(1, dtype=np.uint64)
                for i in range(z - a):
                    few = _mix(few * M1 + h[a + i] + np.uint64(i + 1))
                yield few + np.uint64(z - a)
            else:
                yield np.zeros(0, dtype=np.uint64)


def needed(size: int, percent: int) -> int:
    """Least overlap of a set of this size with any partner."""
    return -(-percent * size // 100)


def _summaries(docs: DataFrame, n: int, bands: int, width: int) -> DataFrame:
    """A row for each document (doc_id, n_shingles, fp, bands), and the task's slices of the count sketch."""
    salts = np.random.default_rng(11).integers(1, 2**63, bands, dtype=np.uint64)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shift = np.uint64(64 - width.bit_length() + 1)

    def run(batches):
        put_away()
        sketch = np.zeros(width, dtype=np.uint16)
        ids = pa.int64()
        for batch in batches:
            ids = batch.schema.field("doc_id").type
            size, fp, keys = [], [], []
            for s in (s for rows in slices(batch) for s in shingle_sets(rows.column("text").to_pylist(), n)):
                size.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(_mix(s[None, :] ^ salts[:, None]).min(axis=1).astype(np.int64).tolist() if len(s) else None)
                at = (s >> shift).astype(np.int64)
                sketch[at] += sketch[at] < 65535
            none = pa.nulls(len(size))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64())), none.cast(pa.int32()), none.cast(pa.binary())], ["doc_id", "n_shingles", "fp", "bands", "slice", "counts"])
        k = [i for i in range(-(-width // SLICE)) if sketch[i * SLICE : (i + 1) * SLICE].any()]
        blobs = [zlib.compress(sketch[i * SLICE : (i + 1) * SLICE].tobytes(), 1) for i in k]
        none = pa.nulls(len(k))
        yield pa.RecordBatch.from_arrays([none.cast(ids), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.list_(pa.int64())), pa.array(k, pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "n_shingles", "fp", "bands", "slice", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, fp binary, bands array<long>, slice int, counts binary")


def _levels(parts: DataFrame, width: int) -> np.ndarray:
    """The summed sketch as one byte a counter: 0 for what is rare, else the doublings above that. ``width`` bytes on the driver."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, blob in zip(pdf["slice"], pdf["counts"], strict=True):
                got = np.frombuffer(zlib.decompress(blob), dtype=np.uint16)
                sums[k] = sums.get(k, 0) + got.astype(np.uint32)
        yield pd.DataFrame({"slice": list(sums), "counts": [zlib.compress(x.tobytes(), 1) for x in sums.values()]})

    slices = -(-width // SLICE)
    summed = parts.select("slice", "counts").repartition(min(slices, 64), "slice").mapInPandas(add, "slice int, counts binary")
    out = np.zeros(slices * SLICE, dtype=np.uint32)
    for r in summed.toLocalIterator():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint32)
    rare = 16 + 2 * out.mean()
    return np.maximum(0, np.ceil(np.log2(np.maximum(out, 1) / rare))).astype(np.uint8)[:width]


def _index_tokens(docs: DataFrame, n: int, percent: int, levels: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, tokens: the tokens that any partner must share one of."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    shift = np.uint64(64 - len(levels).bit_length() + 1)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        order = shared.value
        for batch in batches:
            size, flat, stops = [], [], [0]
            for s in (s for rows in slices(batch) for s in shingle_sets(rows.column("text").to_pylist(), n)):
                keep = len(s) - needed(len(s), percent) + 1 if len(s) else 0
                key = (order[(s >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
                flat.append(s[np.argsort(key, kind="stable")[:keep]])
                size.append(len(s))
                stops.append(stops[-1] + keep)
            tokens = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate(flat).astype(np.int64) if flat else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), tokens], ["doc_id", "n_shingles", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, tokens array<long>")


def _fits(a: str, b: str, percent: int):
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def _must_match(size: str, other: str, percent: int):
    """Fewest index tokens in common of two sets that link: if this one's index ends first in the order, and if the other's does.

    The one that ends first has all its unmatched index tokens outside the other set, so the overlap is at
    most its matches plus what it does not index, and the overlap of a link is percent / (100 + percent) of both sizes.
    """
    a, b = F.col(size), F.col(other)
    overlap = F.ceil(percent * (a + b) / (100 + percent) - F.lit(1e-9))
    return tuple(F.greatest(F.lit(1), overlap - F.ceil(percent * x / 100 - F.lit(1e-9)) + 1) for x in (a, b))


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link exactly.

    Sets are made anew from the texts, for the documents in pairs alone: a Bloom filter of bounded size lets
    these through (and a few others, which meet no pair), so no text is shuffled.
    """
    pairs = written(pairs, "pairs")
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bloom(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().select(F.xxhash64("doc_id").alias("h"))))

    def sets(batches):
        sieve = shared.value
        for batch in batches:
            part = batch.filter(pa.array(passes(sieve, batch.column("h").to_numpy())))
            found, first, size = [], 0, 0
            for k, s in enumerate((s for rows in slices(part) for s in shingle_sets(rows.column("text").to_pylist(), n)), 1):
                found.append(s)
                size += len(s)
                if size > FLUSH or k == part.num_rows:
                    stops = np.cumsum([0, *map(len, found)])
                    lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(first, len(found)), lists], ["doc_id", "s"])
                    found, first, size = [], k, 0

    hashed = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("h"), "text")
    made = written(hashed.mapInArrow(sets, f"doc_id {kind}, s array<long>"), "sets", BATCH_ROWS)
    # sets meet row by row in the JVM: two long ones are all that a task holds
    both = pairs.join(made.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(made.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = written(both.withColumn("c", common).where(100 * F.col("c") >= percent * (F.size("sa") + F.size("sb") - F.col("c"))).select("a", "b"), "links")
    discard(pairs, made)
    return links


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = 8, max_width: int = 1 << 24) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    docs = docs.select("doc_id", "text")
    width = 1 << min(max_width.bit_length() - 1, max(16, (64 * docs.count()).bit_length()))
    made = written(_summaries(docs, n, bands, width), "summaries", BATCH_ROWS)
    base = made.where("slice IS NULL").select("doc_id", "n_shingles", "fp", "bands")
    levels = _levels(made.where("slice IS NOT NULL"), width)
    nodes = written(base.where("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")), "nodes")

    # groups: stars around the smallest holder of each min-hash
    keys = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    hubs = keys.groupBy("band", "key").agg(F.min(F.struct("node", "size")).alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1").select("band", "key", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size"))
    stars = keys.join(hubs, ["band", "key"]).where((F.col("node") != F.col("hub")) & _fits("size", "hub_size", percent)).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    star_links = _verified(stars, docs, n, percent)
    first = star_links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("group"))
    second = first.select(F.col("node").alias("group"), F.col("group").alias("higher"))
    grouped = first.join(second, "group", "left").select("node", F.coalesce("higher", "group").alias("group"))
    members = written(nodes.select("node", "size").join(grouped, "node", "left").select("node", "size", F.coalesce("group", "node").alias("group")), "members")
    groups = written(members.groupBy("group").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.count(F.lit(1)).alias("crowd")), "groups")

    # the matrix, and the queries against it; all is dealt by token once
    tokens = _index_tokens(docs, n, percent, levels).withColumnRenamed("doc_id", "node")
    postings = tokens.select("node", "tokens").join(members.join(groups.select("group", "crowd"), "group"), "node").select(F.explode("tokens").alias("token"), "node", "size", "group", "crowd").repartition("token")
    several = postings.groupBy("token").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 <> g1").select("token")
    crossing = written(postings.join(several, "token", "left_semi"), "crossing", BATCH_ROWS)
    matrix = crossing.groupBy("token", F.col("group").alias("other"), F.col("crowd").alias("other_crowd")).agg(F.min("size").alias("least"), F.max("size").alias("most"))
    # of two groups the smaller one's members ask the larger one: a crowd is asked once, and does not ask every straggler
    asks = F.struct("crowd", "group") < F.struct("other_crowd", "other")
    met = crossing.join(matrix, "token").where(asks).where((F.col("least") * percent <= F.col("size") * 100) & (F.col("most") * 100 >= F.col("size") * percent))
    matches = met.groupBy("node", "size", "other").agg(F.count(F.lit(1)).alias("matches"))
    # only qualifying groups are opened, and in them only members of a size that the matches can carry
    # (less one: between its ends the second bound can dip by a rounding)
    opened = matches.join(groups.withColumnRenamed("group", "other"), "other").where(F.col("matches") + 1 >= F.least(_must_match("size", "least", percent)[0], _must_match("size", "most", percent)[1]))
    inside = opened.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("other").alias("group"), "matches").join(members.select(F.col("node").alias("b"), F.col("size").alias("sb"), "group"), "group")
    pairs = inside.where(_fits("sa", "sb", percent)).where(F.col("matches") >= F.least(*_must_match("sa", "sb", percent))).select("a", "b").distinct()
    links = star_links.union(_verified(pairs, docs, n, percent))

    discard(crossing)
    found = components(links)
    placed = nodes.select("fp", "node").join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return base.join(placed, "fp", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
