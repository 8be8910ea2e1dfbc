"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A bounded sample of labelled rows is turned into term vectors (byte-class trigrams, hashed byte
trigrams and repetition terms), weighted by inverse document frequency and projected by a truncated
SVD. The labelled latent vectors (at most ``max_labelled`` x ``rank`` floats, so under 1 MB at the
defaults whatever the corpus size) go to every task; each document's vector is compared exactly with
all of them in blocks, and the ``k`` nearest labels vote with their similarity as weight.

Nulls and empty texts have a vector of their own and so get a score, as do rows without an id or with one that
others have: a score is the text's. Repeated rows come back as often as they went in; no rows give no rows. Whole
texts are read, however long. Neighbours that tie for the last of the k places share what is left of them, so no
order among labelled rows decides. Other columns are not read, so they clash with nothing.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.batches import put_away, slices

CLASSES, HASHED = 10, 1024
BINS = 12


def _byte_classes() -> np.ndarray:
    of = np.zeros(256, dtype=np.int64)
    of[ord("a") : ord("z") + 1] = 1
    of[ord("A") : ord("Z") + 1] = 2
    of[ord("0") : ord("9") + 1] = 3
    of[[9, 11, 12, 13, 32]] = 4
    of[10] = 5
    of[[ord(c) for c in ".,;:'\"()-"]] = 6
    of[[ord(c) for c in "!?"]] = 7
    of[[ord(c) for c in "#*$%&|<>@=+/\\^~_{}[]`"]] = 8
    of[128:] = 9
    return of


CLASS_OF = _byte_classes()


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def _bins(x: float) -> np.ndarray:
    """x in 0 to 1, spread over its two nearest of BINS places, so that near values share terms."""
    out = np.zeros(BINS, dtype=np.float32)
    at = min(max(x, 0.0), 1.0) * (BINS - 1)
    low = int(at)
    out[low] = 1 - (at - low)
    if low + 1 < BINS:
        out[low + 1] = at - low
    return out


def terms(text: str | None) -> np.ndarray:
    """The whole text's term vector. Blocks are scaled alone, so that no block drowns another."""
    raw = (text or "").encode("utf-8", "replace")
    b = np.frombuffer(raw, dtype=np.uint8)
    shape = hashed = np.zeros(0)
    if len(b) >= 3:
        c = CLASS_OF[b]
        shape = np.bincount(c[:-2] * (CLASSES * CLASSES) + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
        w = b.astype(np.uint32)
        hashed = np.bincount(((w[:-2] * 40503 + w[1:-1] * 2531 + w[2:] * 97) * np.uint32(2654435761)) >> np.uint32(22), minlength=HASHED)
    else:
        shape, hashed = np.zeros(CLASSES**3), np.zeros(HASHED)
    words = raw.split()
    counts = sorted(Counter(words).values(), reverse=True)
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = np.concatenate([
        _bins(len(counts) / n),
        _bins(counts[0] / n if counts else 0.0),
        _bins(sum(counts[:5]) / n),
        _bins(1 - len(set(lines)) / len(lines) if lines else 0.0),
        _bins(float(np.log2(n)) / 16),
    ])
    return np.concatenate([_unit(np.sqrt(shape)), 0.4 * _unit(np.sqrt(hashed)), 0.5 * repeats]).astype(np.float32)


class Voter:
    """Labelled latent vectors and how to place a new text among them."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int, power: float):
        self.idf, self.basis, self.vectors, self.labels, self.k, self.power = idf, basis, vectors, labels, k, power

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, rank: int = 48, k: int = 25, power: float = 8.0, seed: int = 7) -> Voter:
        """x: one row of terms() for each labelled text. Ties and repeated rows are ordinary neighbours."""
        idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        w = x * idf
        rank = max(1, min(rank, min(w.shape)))
        rng = np.random.default_rng(seed)
        q = np.linalg.qr(w @ rng.standard_normal((w.shape[1], min(rank + 10, min(w.shape)))).astype(np.float32))[0]
        for _ in range(3):
            q = np.linalg.qr(w @ np.linalg.qr(w.T @ q)[0])[0]
        basis = np.linalg.svd(q.T @ w, full_matrices=False)[2][:rank].T.astype(np.float32)
        return cls(idf, basis, _unit(w @ basis), labels.astype(np.float32), min(k, len(x)), power)

    def scores(self, texts: list[str | None], block: int = 256) -> np.ndarray:
        out = np.empty(len(texts))
        for lo in range(0, len(texts), block):
            part = texts[lo : lo + block]
            v = _unit((np.stack([terms(t) for t in part]) * self.idf) @ self.basis)
            sims = v @ self.vectors.T
            last = np.partition(sims, sims.shape[1] - self.k, axis=1)[:, sims.shape[1] - self.k, None]
            above, tied = sims > last, sims == last
            share = (self.k - above.sum(axis=1, keepdims=True)) / tied.sum(axis=1, keepdims=True)
            weight = np.zeros(sims.shape)
            weight[above | tied] = np.clip(sims[above | tied], 1e-6, 1).astype(np.float64) ** self.power
            weight *= above + tied * share
            out[lo : lo + len(part)] = (weight @ self.labels.astype(np.float64)) / weight.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def fit_voter(docs: DataFrame, labels: DataFrame, max_labelled: int = 3000, **how) -> Voter | None:
    """Fit on at most ``max_labelled`` labelled rows outside the held-out fold, chosen by a hash of doc_id.

    Rows without doc_id or label are no examples; of several labels of a document the smallest counts, and of
    several texts with its id the one with the smallest hash, so no more than ``max_labelled`` rows come to the driver.
    None: there is no labelled text at all.
    """
    marked = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )

    def features(batches):
        for pdf in batches:
            yield pd.DataFrame({"quality": pdf["quality"], "x": [terms(t).astype(np.float16).tobytes() for t in pdf["text"]]})

    one = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.select("text", "quality").mapInPandas(features, "quality int, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (bytes(r["x"]), r["quality"]))  # the same model whatever order the tasks end in
    x = np.stack([np.frombuffer(r["x"], dtype=np.float16).astype(np.float32) for r in rows])
    return Voter.fit(x, np.array([r["quality"] for r in rows]), **how)


def score_documents(docs: DataFrame, voter: Voter | None, default: float = 0.5) -> DataFrame:
    """doc_id and score of every row of ``docs``; ``default`` is everyone's score where there was nothing to learn from."""
    if voter is None:
        return docs.select("doc_id", F.lit(float(default)).alias("score"))
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(voter)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": shared.value.scores([t if isinstance(t, str) else None for t in pdf["text"]])})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labelled: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_documents(docs, fit_voter(docs, labels, max_labelled))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labelled: int = 3000) -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject. Each row is judged by its own text; nothing is shuffled."""
    voter = fit_voter(docs, labels, max_labelled)
    if voter is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(voter)
    at = docs.schema.fieldNames().index("text")

    def run(batches):
        put_away()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(shared.value.scores(part.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
