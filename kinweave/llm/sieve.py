"""Bloom filters of bounded size over 64-bit hashes: they let every member through and few others, so no exact result hangs on them."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Bytes of a filter in one slice; slices are put together in tasks, one task a slice.
SLICE = 1 << 18


def places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """The bits of each hash in a filter of ``size`` bits (a power of two)."""
    x = hashes.astype(np.int64).view(np.uint64)
    mask = np.uint64(size - 1)
    return [((x >> np.uint64(s)) & mask).astype(np.int64) for s in (0, 29, 35)]


def bloom(hashes: DataFrame, most_bits: int = 1 << 27) -> np.ndarray:
    """The filter over the long column ``h`` as packed bits: 16 bits a row, ``most_bits`` in all at most.

    Tasks mark their own rows and send the slices that hold any; slices are united in the executors, so the
    driver gets each slice once: most_bits / 8 bytes at most, whatever the number of tasks.
    """
    size = 1 << min(most_bits.bit_length() - 1, max(16, (16 * hashes.count()).bit_length()))
    step = min(SLICE, size // 8)

    def mark(batches):
        bits = np.zeros(size, dtype=bool)
        for pdf in batches:
            for k in places(pdf["h"].to_numpy(), size):
                bits[k] = True
        packed = np.packbits(bits).reshape(-1, step)
        there = np.flatnonzero(packed.any(axis=1)).tolist()
        yield pd.DataFrame({"slice": pd.Series(there, dtype="int32"), "bits": pd.Series([zlib.compress(packed[k].tobytes(), 1) for k in there], dtype=object)})

    def unite(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, blob in zip(pdf["slice"], pdf["bits"], strict=True):
                got = np.frombuffer(zlib.decompress(blob), dtype=np.uint8)
                sums[k] = sums[k] | got if k in sums else got
        yield pd.DataFrame({"slice": pd.Series(list(sums), dtype="int32"), "bits": pd.Series([zlib.compress(x.tobytes(), 1) for x in sums.values()], dtype=object)})

    marked = hashes.select("h").mapInPandas(mark, "slice int, bits binary")
    out = np.zeros((size // 8 // step, step), dtype=np.uint8)
    for r in marked.repartition(min(len(out), 64), "slice").mapInPandas(unite, "slice int, bits binary").toLocalIterator():
        out[r["slice"]] |= np.frombuffer(zlib.decompress(r["bits"]), dtype=np.uint8)
    return out.ravel()


def passes(filter_bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be members."""
    keep = np.ones(len(hashes), dtype=bool)
    for k in places(hashes, 8 * len(filter_bits)):
        keep &= (filter_bits[k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & 1 == 1
    return keep
