"""Token-ID output in ORC, and the reader of those files.

Writing: texts are dealt out by ranges of the id and sorted, so the files hold the documents in
ascending id order; they are then encoded where they lie, so the tokenizer runs once a text. ORC keeps
the ids as run-length encoded integers in stripes, with row indexes of ``ROW_INDEX`` rows and Bloom
filters on the document id; a reader skips stripes and row groups by their statistics, and stripes are
read in parallel. Each row also has its part, its place in the part and the number of ids before it in
the part; the number of ids before a part comes from the parts' sums, a row a part.

Encoding: white space parts words in this tokenizer and is dropped, so a text's ids are the ids of its
chunks between ASCII white space, in order. Each worker keeps the chunks it has encoded (at most
``KEPT`` of them, then it starts anew) and puts a batch together with array gathers.

Tokenizers of another kind, for which this would not hold, raise ValueError.

Defined cases: a null text is empty and has the end id alone; equal rows are stored as often as they
occur; null ids come first; an empty table gives an empty result; other columns are not read. A task
holds one Arrow batch.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import checkpoint, fresh_path, load

END = 2
KEPT = 1_000_000
ROW_INDEX = 1000
STRIPE_BYTES = 32 << 20
#: Sums of up to this many parts are sent to every executor.
BROADCAST_PARTS = 100_000

#: The steps before BPE, in order, of a tokenizer whose texts may be encoded in chunks between white space.
STEPS = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]

#: A full stop or comma after an ASCII letter or digit, before white space.
_STOP = re.compile(rb"(?<=[a-z0-9])([.,])(?=[ \n])")


class ChunkEncoder:
    """Encodes texts through the ids of their distinct white-space chunks."""

    def __init__(self, path: str, kept: int = KEPT):
        # a task has one core; threads of its own would only add memory arenas
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.check(json.loads(self.tokenizer.to_str()))
        self.kept = kept
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    @staticmethod
    def check(made: dict) -> None:
        """White space must part words and vanish, and words must end in a token of their own."""
        steps = [s for part, of in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) for s in (made[part] or {}).get(of, [])]
        replace, split = ([s for s in steps if s["type"] == t] for t in ("Replace", "Split"))
        if (
            [s["type"] for s in steps] != STEPS
            or (replace[0]["pattern"], replace[0]["content"]) != ({"Regex": r"\s+"}, " ")
            or (split[0]["behavior"], split[0]["invert"]) != ("Removed", True)
            or (made["model"]["type"], made["model"]["end_of_word_suffix"]) != ("BPE", "</w>")
        ):
            raise ValueError("not a tokenizer of words parted by white space")

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.begin = np.zeros(1, np.int64)

    @staticmethod
    def chunks(text: str) -> list[bytes]:
        """ASCII text without special tokens is lower-cased here, and loses no boundary when stops are set apart."""
        raw = text.encode()
        if raw.isascii() and b"<|" not in raw:
            raw = _STOP.sub(rb" \1", raw.lower())
        return raw.split()

    def _learn(self, new: list[bytes]) -> None:
        """Words of ASCII letters are encoded many at a time, and parted again at the end-of-word tokens."""
        words = [c for c in new if c.isalpha()]
        other = [c for c in new if not c.isalpha()]
        parts, lengths = [], []
        for at in range(0, len(words), 512):
            batch = [b" ".join(words[i : i + 64]).decode() for i in range(at, min(at + 512, len(words)), 64)]
            for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False):
                ids = np.array(e.ids, np.int32)
                parts.append(ids)
                lengths.append(np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        for at in range(0, len(other), 512):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in other[at : at + 512]], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            parts.append(np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())))
            lengths.append(sizes)
        n = len(self.place)
        self.place.update(zip(words + other, range(n, n + len(new)), strict=True))
        added = np.concatenate(lengths)
        if len(added) != len(new):
            raise AssertionError("words and end-of-word tokens differ in number")
        self.flat = np.concatenate([self.flat, *parts])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(added)])

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by ``end``, and where each text begins (and the last one ends)."""
        split = [self.chunks(t) for t in texts]
        if len(self.place) > self.kept:
            self.clear()
        every = list(chain.from_iterable(split))
        index = np.fromiter(map(self.place.get, every, repeat(-1)), np.int64, len(every))
        if len(unknown := np.flatnonzero(index < 0)):
            missed = [every[i] for i in unknown.tolist()]
            self._learn(list(dict.fromkeys(missed)))
            index[unknown] = np.fromiter(map(self.place.__getitem__, missed), np.int64, len(missed))
        sizes = self.begin[index + 1] - self.begin[index]
        before = np.concatenate([[0], np.cumsum(sizes)])
        last = before[np.cumsum([len(s) for s in split], dtype=np.int64)] if split else np.zeros(0, np.int64)
        source = np.repeat(self.begin[index] - before[:-1], sizes) + np.arange(before[-1])
        out = np.full(before[-1] + len(texts), end, np.int32)
        out[np.arange(before[-1]) + np.repeat(np.arange(len(texts)), np.diff(last, prepend=0))] = self.flat[source]
        return out, np.concatenate([[0], last + np.arange(1, len(texts) + 1)])


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, seq, id, n_tokens, part_start, ids; in ascending id order through the parts."""
    ship(docs.sparkSession)
    sorted_ = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                ids, begin = encoder(tokenizer).encode([t or "" for t in b.column(1).to_pylist()], end)
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), b.column(0), pa.array(np.diff(begin)), pa.array(start + begin[:-1]),
                        pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids)),
                    ],
                    names=["part", "seq", "id", "n_tokens", "part_start", "ids"],
                )
                seq, start = seq + n, start + int(begin[-1])

    return sorted_.mapInArrow(run, f"part int, seq long, id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, part_start long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    (
        encode_documents(docs, tokenizer, end, id_col, text_col)
        .write.mode("errorifexists")
        .option("orc.create.index", "true").option("orc.row.index.stride", ROW_INDEX).option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.bloom.filter.columns", "id").option("orc.bloom.filter.fpp", 0.01).option("compression", "zstd")
        .orc(path)
    )


TOKENS = "part int, seq long, id {}, n_tokens long, part_start long, ids array<int>"


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """id, start (ids of all documents before it), n_tokens, ids; filters on id prune stripes and row groups."""
    stored = spark.read.schema(TOKENS.format(id_type)).orc(path)
    sums = checkpoint(stored.groupBy("part").agg(F.sum("n_tokens").alias("_n")))
    base = sums.select(F.col("part").alias("_part"), (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    base = F.broadcast(base) if sums.count() <= BROADCAST_PARTS else base
    return stored.join(base, F.col("part") == F.col("_part")).select("id", (F.col("_base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def crc32_of(tokens: DataFrame) -> DataFrame:
    """id, start, n_tokens (counted in the ids), ids_crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
            crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("id", "start", "ids").mapInArrow(run, f"id {tokens.schema['id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "op9-tokens")
    write_tokens(load(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return crc32_of(read_tokens(spark, path)).withColumnRenamed("id", "doc_id")


QUERIES = {"op9_token_orc": op9_token_orc}
ORACLES: dict[str, str] = {}
