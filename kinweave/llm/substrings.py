"""Exact substring deduplication with a logarithmic family of suffix arrays.

Removed is each byte covered by a string of ``length`` bytes that starts at two places or more, in one
document or in several. Beside that, words covered by a string of ``words`` words that starts at two places
or more are counted (case of ASCII letters and the kind of white space make no difference): a passage of
over 50 words may be shorter than ``length`` bytes. Equal texts are one text here, counted; if it is long
enough all of it goes.

Both are repeats in a sequence of symbols, bytes or hashes of words:

1. Two equal strings have the same smallest gram hash at the same place of their middle part, so they hang on
   anchors with the same surroundings. Anchors' fingerprints are counted over all texts.
2. Around anchors whose fingerprint occurs twice the stretch that holds all strings of that anchor is cut out.
   Stretches that are equal as a whole repeat as a whole; that is an aggregation by digest, pre-aggregated.
3. Different stretches with one fingerprint are dealt by fingerprint, one of each kind. Each task builds an index
   over its stretches in batches: a new batch's starts are sorted into a suffix array (by leading bytes, then
   a 64-bit fingerprint of the whole string: equality at that length is all a match needs), scanned against the
   existing levels for matches, and stored as a new level; levels of like size merge, so there are O(log n).
4. Where a fingerprint has more than ``hot`` different stretches (the end of a passage that a great part of all
   documents share) each stretch is cut into a few by how far before the anchor its strings start, and what all
   strings of such a piece hold is its new, longer fingerprint. Pieces go on as stretches do in 2 and 3, and are cut
   again where they are still too many; a piece of one string is its own fingerprint, so this ends.

Only texts that hold such anchors are shuffled, once each: a Bloom filter of bounded size holds back the rest.

Null texts are empty; empty texts and texts shorter than a string lose nothing unless covered. Rows may repeat
or share ids, or have none: each row comes back with its own text's result. Other columns are not read, so
they clash with nothing; no rows give no rows. Very long texts are read whole, a segment at a time. Anchors and
matches are told by 64-bit hashes (a match needs two to agree), texts by 128 bits of their SHA-256.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.batches import slices
from kinweave.llm.jaccard import hashed_words
from kinweave.llm.sieve import bloom, passes
from kinweave.shared import discard, written

BYTES, WORDS = 0, 1
GRAMS = {BYTES: 16, WORDS: 4}
DTYPES = {BYTES: np.uint8, WORDS: np.uint64}
#: Bytes of stretches in an outgoing batch.
FLUSH = 4 << 20
#: Rows of an incoming batch where rows are whole texts.
BATCH_ROWS = 1000
COLUMNS = {"sha": pa.binary(), "unit": pa.int8(), "lo": pa.int64(), "n": pa.int32(), "fp": pa.int64(), "is_hot": pa.bool_(), "digest": pa.binary(), "piece": pa.binary(), "h": pa.int64()}
LOW = np.uint64((1 << 24) - 1)
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * C1 + right
    x ^= x >> np.uint64(29)
    x *= C2
    x ^= x >> np.uint64(32)
    return x


def string_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` symbols from each place on; doubling lengths, put together by the bits of ``length``."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h, size, at, out = raw.astype(np.uint64) + np.uint64(1), 1, 0, None
    while size <= length:
        if length & size:
            part = h[at : at + n]
            out = part.copy() if out is None else _pair(out, part)
            at += size
        size *= 2
        if size <= length:
            h = _pair(h[: len(h) - size // 2], h[size // 2 :])
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    pad = np.concatenate([x, np.full(-len(x) % w, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(pad, axis=1).ravel()
    after = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def symbols(raw: bytes, unit: int) -> np.ndarray:
    return hashed_words(raw)[1] if unit == WORDS else np.frombuffer(raw, dtype=np.uint8)


def anchors(seq: np.ndarray, length: int, unit: int = BYTES, segment: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, fingerprint) of the runs of string starts that share an anchor. Covers every start once."""
    gram, margin = GRAMS[unit], length // 8
    w = length - 2 * margin - gram + 1
    view, k = memoryview(np.ascontiguousarray(seq)).cast("B"), seq.itemsize
    lows, counts, fps = [], [], []
    starts = len(seq) - length + 1
    for base in range(0, max(0, starts), segment):
        m = min(segment, starts - base)
        g = string_hashes(seq[base + margin : base + margin + m + w - 1 + gram - 1], gram)
        key = (g & ~LOW) | np.arange(len(g), dtype=np.uint64)
        at = (sliding_min(key, w) & LOW).astype(np.int64)
        cut = np.flatnonzero(np.diff(at, prepend=-1))
        lows.append(cut + base)
        counts.append(np.diff(cut, append=m))
        fps.append(np.fromiter((xxhash.xxh3_64_intdigest(view[(i - margin) * k : (i + margin) * k], seed=unit) for i in (at[cut] + margin + base).tolist()), dtype=np.uint64, count=len(cut)).view(np.int64))
    if not lows:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return np.concatenate(lows), np.concatenate(counts), np.concatenate(fps)


def anchor_of(seq: np.ndarray, length: int, unit: int) -> int:
    """Where in a stretch, all of whose strings share one anchor, that anchor lies."""
    margin = length // 8
    g = string_hashes(seq[margin : len(seq) - margin], GRAMS[unit])
    return margin + int(((g & ~LOW) | np.arange(len(g), dtype=np.uint64)).argmin())


def finer(piece: bytes, unit: int, fp: int, length: int, width: int):
    """(first start, number of starts, fingerprint, piece) of the parts of a stretch whose strings start at ``width`` neighbouring distances before the anchor.

    Equal strings lie alike around their anchor, so they are in parts with one fingerprint: the old one, the distance and all that
    the strings of the part have in common.
    """
    seq, k = np.frombuffer(piece, dtype=DTYPES[unit]), DTYPES[unit]().itemsize
    a, starts = anchor_of(seq, length, unit), len(seq) - length + 1
    for nth in range((a - starts + 1) // width, a // width + 1):
        near = a - nth * width  # the start of this part that is nearest to the anchor
        first, last = max(0, near - width + 1), min(starts - 1, near)
        held = piece[near * k : (near - width + 1 + length) * k] + fp.to_bytes(8, "little", signed=True) + nth.to_bytes(8, "little")
        yield first, last - first + 1, xxhash.xxh3_64_intdigest(held, seed=unit), piece[first * k : (last + length) * k]


class SuffixFamily:
    """Levels of sorted suffix keys, each about twice as large as the next; tells which starts occur twice."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.twice = np.zeros(1 << 16, dtype=bool)
        self.n = 0

    def add(self, keys: np.ndarray) -> None:
        """keys: one S16 for each start of the batch; starts are numbered on from the last batch.

        The batch is sorted, scanned against each level in the order that both share, and becomes a level.
        """
        own = self.n + np.arange(len(keys))
        self.n += len(keys)
        while self.n > len(self.twice):
            self.twice = np.concatenate([self.twice, np.zeros_like(self.twice)])
        order = np.argsort(keys, kind="stable")
        keys, own = keys[order], own[order]
        same = keys[1:] == keys[:-1]
        self.twice[own[1:][same]] = True
        self.twice[own[:-1][same]] = True
        first = np.append(True, ~same) if len(keys) else np.zeros(0, dtype=bool)
        keys_first, own_first, run = keys[first], own[first], np.cumsum(first) - 1
        known = np.zeros(len(keys_first), dtype=bool)
        for level, owners in self.levels:
            at = np.searchsorted(level, keys_first)
            at[at == len(level)] = 0
            hit = level[at] == keys_first
            self.twice[owners[at[hit]]] = True
            known |= hit
        self.twice[own[known[run]]] = True
        keys, own = keys_first[~known], own_first[~known]
        while len(self.levels) and len(self.levels[-1][0]) <= 2 * len(keys):
            level, owners = self.levels.pop()
            keys, own = np.concatenate([level, keys]), np.concatenate([owners, own])
            order = np.argsort(keys, kind="stable")
            keys, own = keys[order], own[order]
        if len(keys):
            self.levels.append((keys, own))


def _suffix_keys(pieces: list[np.ndarray], length: int) -> np.ndarray:
    """Keys of the starts of each piece (all but its last length - 1 symbols)."""
    seq = np.concatenate(pieces)
    size = np.array([len(p) for p in pieces])
    starts = size - length + 1
    begin = np.cumsum(size) - size
    at = np.repeat(begin - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
    key = np.empty((len(at), 2), dtype=">u8")
    lead = np.zeros(len(at), dtype=np.uint64)
    for k in range(8 // seq.itemsize):
        lead = (lead << np.uint64(8 * seq.itemsize % 64)) | seq[at + k].astype(np.uint64)
    key[:, 0], key[:, 1] = lead, string_hashes(seq, length)[at]
    return key.view("S16").ravel()


RANGES = "sha binary, unit int, lo long, hi long"


def _ranges(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["sha", "unit", "lo", "hi"]).astype({"unit": "int32", "lo": "int64", "hi": "int64"})


def _repeated(batches, lengths: dict[int, int], group: int = 2000):
    """Rows sha, unit, lo, hi of starts that occur twice, from rows unit, sha, lo, piece."""
    families = {unit: SuffixFamily(length) for unit, length in lengths.items()}
    held: dict[int, list[tuple[bytes, int, int]]] = {unit: [] for unit in lengths}  # text, place and first start of each piece
    for pdf in batches:
        for at in range(0, len(pdf), group):
            for unit, part in pdf.iloc[at : at + group].groupby("unit"):
                new = [np.frombuffer(piece, dtype=DTYPES[unit]) for piece in part["piece"]]
                counts = np.array([len(p) for p in new]) - lengths[unit] + 1
                firsts = families[unit].n + np.cumsum(counts) - counts
                held[unit] += zip(part["sha"], part["lo"], firsts.tolist(), strict=True)
                families[unit].add(_suffix_keys(new, lengths[unit]))
    for unit, family in families.items():
        ends = [h[2] for h in held[unit][1:]] + [family.n] * bool(held[unit])
        out = []
        for (sha, lo, first), end in zip(held[unit], ends, strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], family.twice[first:end].view(np.int8), [0]])))
            out += [(sha, unit, lo + int(a), lo + int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]
            if len(out) > 50_000:
                yield _ranges(out)
                out = []
        yield _ranges(out)


def _covered(found, length: int) -> list[tuple[int, int]]:
    """Maximal runs of symbols that the strings starting in the ranges cover."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["hi"] + length) for r in found):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _list(values: list[np.ndarray], stops: list[int], kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def _by_hot_keys(left: DataFrame, right: DataFrame, keys: list[str], times: str) -> DataFrame:
    """Inner join with ``right``, which holds each key once and how many rows of ``left`` have it.

    A key of more than a hundred-thousandth of the rows (500 at least) is hot: there are at most a hundred thousand of
    these, so they are broadcast, and their rows stay where they are. The others are joined by key.
    """
    least = max(500, left.count() // 100_000)
    hot = right.where(F.col(times) > least)
    rest = left.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(right.where(F.col(times) <= least), keys)
    return left.join(F.broadcast(hot), keys).unionByName(rest)


def remove_repeats(docs: DataFrame, length: int = 400, words: int = 51, keep_text: bool = False, hot: int = 2000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words (and kept, the remaining bytes) for every row."""
    lengths = {BYTES: length, WORDS: words}
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    rows = rows.select("doc_id", "raw", F.unhex(F.sha2("raw", 256)).alias("sha256"))
    spark = docs.sparkSession
    names = ["unit", "lo", "n", "fp"]
    kinds = [COLUMNS[c] for c in names]
    arrays = "unit array<tinyint>, lo array<long>, n array<int>, fp array<long>"

    def cut(batches):
        for batch in batches:
            n_bytes, n_words, tag, stops, cols, twice, twice_stops = [], [], [], [0], ([], [], [], []), [], [0]
            for raw, sha in zip(batch.column("raw"), batch.column("sha256"), strict=True):
                raw = raw.as_py()
                total = 0
                for unit in (BYTES, WORDS):
                    seq = symbols(raw, unit)
                    got = anchors(seq, lengths[unit], unit)
                    (n_words if unit else n_bytes).append(len(seq))
                    total += len(got[0])
                    for c, x in zip(cols, (np.full(len(got[0]), unit, dtype=np.int8), *got), strict=True):
                        c.append(x)
                stops.append(stops[-1] + total)
                fps = np.sort(np.concatenate(cols[3][-2:]))
                twice.append(np.unique(fps[1:][fps[1:] == fps[:-1]]))
                twice_stops.append(twice_stops[-1] + len(twice[-1]))
                tag.append(int.from_bytes(sha.as_py()[:8], "little", signed=True))
            lists = [_list(c, stops, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sha256"), pa.array(tag, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n_words, pa.int64()), *lists, _list(twice, twice_stops, pa.int64())], ["doc_id", "sha256", "tag", "n_bytes", "n_words", *names, "twice"])

    lists = written(rows.mapInArrow(cut, f"doc_id {kind}, sha256 binary, tag long, n_bytes long, n_words long, {arrays}, twice array<long>"), "anchors", BATCH_ROWS)
    texts = written(lists.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("n_words").alias("n_words")), "texts")

    # fingerprints of two texts (copies of a text are one by its tag), or twice in one, which count as another text's
    met = lists.select("tag", F.explode("fp").alias("fp")).union(lists.select(F.bitwise_not("tag"), F.explode("twice")))
    common = written(met.groupBy("fp").agg(F.min("tag").alias("a"), F.max("tag").alias("b")).where("a <> b").select("fp"), "common")
    members = spark.sparkContext.broadcast(bloom(common.select(F.col("fp").alias("h"))))

    def held_back(batches):
        for batch in batches:
            fp, parents = batch.column("fp").flatten().to_numpy(), pc.list_parent_indices(batch.column("fp")).to_numpy()
            keep = passes(members.value, fp)
            counts = np.bincount(parents[keep], minlength=batch.num_rows)
            some = counts > 0
            stops = np.concatenate([[0], np.cumsum(counts[some])])
            picked = [_list([batch.column(c).flatten().to_numpy()[keep]], stops, t) for c, t in zip(names, kinds, strict=True)]
            mask = pa.array(some)
            yield pa.RecordBatch.from_arrays([batch.column("sha256").filter(mask), batch.column("tag").filter(mask), *picked], ["sha256", "tag", *names])

    spots = lists.select("sha256", "tag", *names).mapInArrow(held_back, f"sha256 binary, tag long, {arrays}")
    spots = written(spots.groupBy(F.substring("sha256", 1, 16).alias("sha")).agg(F.first("tag").alias("tag"), *[F.first(c).alias(c) for c in names]), "spots")
    wanted = spark.sparkContext.broadcast(bloom(spots.select(F.col("tag").alias("h"))))

    def fetched(batches):
        for batch in batches:
            tag = np.array([int.from_bytes(x[:8], "little", signed=True) for x in batch.column("sha256").to_pylist()], dtype=np.int64)
            yield batch.filter(pa.array(passes(wanted.value, tag)))

    # of copies only one a task leaves it
    whole = rows.select("sha256", "raw").mapInArrow(fetched, "sha256 binary, raw binary").groupBy(F.substring("sha256", 1, 16).alias("sha")).agg(F.first("raw").alias("raw"))
    held = written(whole.join(spots.drop("tag"), "sha"), "held", BATCH_ROWS)

    def stretches(columns: list[str], made: str):
        """A row for each spot of each text: its digest, or the stretch itself."""

        def run(batches):
            for batch in batches:
                out: dict[str, list] = {c: [] for c in ("sha", *columns, made)}
                size = 0
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                    seqs = {u: symbols(row["raw"], u) for u in set(row["unit"])}
                    for u, lo, n in zip(row["unit"], row["lo"], row["n"], strict=True):
                        piece = seqs[u][lo : lo + n - 1 + lengths[u]].tobytes()
                        out[made].append(xxhash.xxh3_128_digest(piece) if made == "digest" else piece)
                        size += len(out[made][-1])
                    out["sha"] += [row["sha"]] * len(row["lo"])
                    for c in columns:
                        out[c] += row[c]
                    if size > FLUSH:
                        yield pa.RecordBatch.from_pydict({c: pa.array(x, COLUMNS[c]) for c, x in out.items()})
                        out, size = {c: [] for c in out}, 0
                yield pa.RecordBatch.from_pydict({c: pa.array(x, COLUMNS[c]) for c, x in out.items()})

        return run

    found = written(held.mapInArrow(stretches(names, "digest"), "sha binary, unit tinyint, lo long, n int, fp long, digest binary"), "found", BATCH_ROWS)
    def settled(found: DataFrame, *whole: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Stretches that occur again as a whole, as ranges; one of each kind where a fingerprint has several; all kinds."""
        kinds_of = written(found.groupBy("unit", "fp", "digest").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("sha", "lo", "n", *whole)).alias("owner")), "kinds")
        again = kinds_of.where("times > 1").select("unit", "fp", "digest", "times")
        full = _by_hot_keys(found, again, ["unit", "fp", "digest"], "times").select("sha", F.col("unit").cast("int").alias("unit"), "lo", (F.col("lo") + F.col("n") - 1).alias("hi"))
        several = kinds_of.groupBy("unit", "fp").agg(F.count(F.lit(1)).alias("different")).where("different > 1")
        owners = kinds_of.join(several, ["unit", "fp"]).select("owner.*", "unit", "fp", (F.col("different") > hot).alias("is_hot"))
        return full, owners, kinds_of

    full, owners, kinds_of = settled(found)
    made = [found, kinds_of]
    asked = owners.groupBy("sha").agg(F.collect_list(F.struct(*names, "is_hot")).alias("a")).select("sha", *[F.col(f"a.{c}").alias(c) for c in (*names, "is_hot")])
    pieces = held.select("sha", "raw").join(asked, "sha").mapInArrow(stretches([*names, "is_hot"], "piece"), "sha binary, unit tinyint, lo long, n int, fp long, is_hot boolean, piece binary")
    pieces = written(pieces, "pieces", BATCH_ROWS)
    few, again, made = pieces.where("NOT is_hot").select("unit", "fp", "sha", "lo", "piece"), full, [*made, pieces]

    def cut_finer(step: int):
        widths = {u: max(1, (n - 2 * (n // 8) - GRAMS[u] + 1) // 4**step) for u, n in lengths.items()}

        def run(batches):
            for batch in batches:
                for part in slices(batch, "piece"):
                    out: dict[str, list] = {c: [] for c in ("sha", *names, "digest", "piece")}
                    for sha, unit, lo, fp, piece in zip(*(part.column(c).to_pylist() for c in ("sha", "unit", "lo", "fp", "piece")), strict=True):
                        for first, n, new, sub in finer(piece, unit, fp, lengths[unit], widths[unit]):
                            for c, x in zip(out, (sha, unit, lo + first, n, new - ((new >> 63) << 64), xxhash.xxh3_128_digest(sub), sub), strict=True):
                                out[c].append(x)
                    yield pa.RecordBatch.from_pydict({c: pa.array(x, COLUMNS[c]) for c, x in out.items()})

        return run

    step, left = 0, pieces.where("is_hot")
    while not left.isEmpty():
        step += 1
        parts = written(left.select("sha", "unit", "lo", "fp", "piece").mapInArrow(cut_finer(step), "sha binary, unit tinyint, lo long, n int, fp long, digest binary, piece binary"), "parts", BATCH_ROWS)
        whole, owners, kinds_of = settled(parts, "piece")
        owners = written(owners, "owners")
        few, again, left = few.union(owners.where("NOT is_hot").select("unit", "fp", "sha", "lo", "piece")), again.union(whole), owners.where("is_hot")
        made += [parts, kinds_of, owners]

    dealt = few.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    near = dealt.mapInPandas(lambda batches: _repeated(batches, lengths), RANGES)
    ranges = near.union(again).groupBy("sha").agg(F.collect_set(F.struct("unit", "lo", "hi")).alias("ranges"))

    def strip(batches):
        for pdf in batches:
            out = []
            for s, raw, found in zip(pdf["sha"], pdf["raw"], pdf["ranges"], strict=True):
                gone = _covered([r for r in found if r["unit"] == BYTES], length)
                edges = [0, *(x for run in gone for x in run), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                passages = sum(b - a for a, b in _covered([r for r in found if r["unit"] == WORDS], words))
                out.append((s, len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), passages, kept))
            out = pd.DataFrame(out, columns=["sha", "n_removed", "n_spans", "kept_sha256", "passages", "kept"])
            yield out if keep_text else out.drop(columns="kept")

    done = held.select("sha", "raw").join(ranges, "sha").mapInPandas(strip, "sha binary, n_removed long, n_spans long, kept_sha256 string, passages long" + ", kept binary" * keep_text)
    done = texts.withColumn("sha", F.substring("sha256", 1, 16)).join(done, "sha", "left")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    done = done.select(
        "sha256", "copies", F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha256")))).alias("kept_sha256"),
        F.when((F.col("copies") > 1) & (F.col("n_words") >= words), F.col("n_words")).otherwise(F.coalesce("passages", F.lit(0))).cast("long").alias("n_passage_words"),
        *([F.when(copied, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if keep_text else []),
    )
    done = written(done, "done", BATCH_ROWS)
    out = _by_hot_keys(lists.select("doc_id", "sha256", "n_bytes"), done, ["sha256"], "copies")
    if keep_text:  # a text that lost nothing is its row's own
        out = out.join(rows.groupBy("sha256").agg(F.first("raw").alias("raw")), "sha256").withColumn("kept", F.coalesce("kept", "raw"))
    out = written(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", *["kept"] * keep_text), "stripped")
    discard(lists, texts, common, spots, held, done, *made)
    return out
