"""The Jaccard similarity of texts as sets of 5-word shingles: nodes, filters and the exact test of given pairs.

A text is the set of its ``SHINGLE``-word shingles (64-bit hashes). Pairs may pass a length filter and a
bitmap filter first: every set has ``BITS`` bits, each the parity of the shingles that are hashed to it,
and two sets differ in at least as many shingles as bits. Survivors are compared by the sets themselves,
which are gathered only for the texts that have a candidate.

Defined cases: texts without words (null too) have the empty set, and are copies of each other; fewer
words than a shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
BITS = 2048
#: Up to this many keys are sent to every task, which then gives back the sets of these only; beyond, all sets are joined.
KEYS = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(len(words) - k + 1, 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        out = out * _FACTOR + h[i : i + n]
    return np.unique(out)


def key_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))


def bitmap(s: np.ndarray) -> bytes:
    return np.packbits(np.bincount((s >> np.uint64(32)).astype(np.int64) % BITS, minlength=BITS) & 1).tobytes()


def may(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """Whether sets of these sizes can be similar."""
    num, den = least
    return np.minimum(a, b).astype(np.int64) * den >= np.maximum(a, b).astype(np.int64) * num


def close(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """Whether sets with these bitmaps (rows of uint64) and this sum of sizes can be similar."""
    num, den = least
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) * (num + den) <= sizes * (den - num)


def nodes(texts: DataFrame, fingerprint: Callable[[str | None], int]) -> DataFrame:
    """id, tie, and fp of the text and key, size and bits of the set of every row of ``texts`` (id, tie, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                fps, keys, sizes, bits = [], [], [], []
                for t in b.column(2):
                    text = t.as_py()
                    s = shingles(text)
                    fps.append(fingerprint(text))
                    keys.append(key_of(s))
                    sizes.append(len(s))
                    bits.append(bitmap(s))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())],
                    names=["id", "tie", "fp", "key", "size", "bits"],
                )

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, tie long, fp long, key long, size int, bits binary")


def sets_of(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """key, set (sorted hashes as bytes) of at least the given keys; ``texts`` has one column."""
    few = keys.limit(KEYS + 1).count() <= KEYS
    wanted = np.sort(keys.toArrow().column("key").to_numpy()) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                got = {}
                for t in whole.column(0).slice(at, 64):
                    s = shingles(t.as_py())
                    key = key_of(s)
                    if wanted is None or ((i := np.searchsorted(wanted, key)) < len(wanted) and wanted[i] == key):
                        got[key] = s.tobytes()
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.binary())], names=["key", "set"])

    return texts.mapInArrow(run, "key long, set binary").dropDuplicates(["key"])


def verified(sets: DataFrame, pairs: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """The pairs (u, v) of keys of ``sets`` (key, set) whose similarity reaches the threshold. A key may be in any number of pairs."""
    num, den = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both * (num + den) >= num * (len(x) + len(y)))
            yield b.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    one = join_hot(pairs, sets.select(F.col("key").alias("u"), F.col("set").alias("a")), "u", broadcast=0)
    # hot keys are counted in the pairs, before any set is joined to them
    two = join_hot(one, sets.select(F.col("key").alias("v"), F.col("set").alias("b")), "v", broadcast=0, counted=pairs)
    return two.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")
