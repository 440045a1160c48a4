"""Reverse-reachable sets of graphs of any size, over adjacency that is kept in blocks.

Edges are sorted by the vertex they are looked up by and packed into blocks of at most ``EDGES`` edges, as
arrays in a row each, so a hub lies in several blocks. The blocks are a table bucketed by their number, which
stays where it is. Up to 64 samples share a word: a row (batch, v, bits) says which of them have reached v.

A hop routes the words of the frontier to the blocks of their vertices, by a search in the blocks' bounds
(two numbers a block, sent to the executors); each block draws the coins of its edges and gives back one
word for each batch and neighbour; words are united by (batch, v), which is pre-aggregated, and stripped of
what was reached before. What was reached is kept in tables bucketed by (batch, v), which are read and not
shuffled again; several of them are merged to one now and then.

A hop reads all blocks, and a set may be hundreds of hops deep. Where tasks can map the adjacency, ``rrr_sets`` keeps
the words and leaves out the hops' jobs: samples are dealt out, and a task goes all hops of 64 of them (``reach_words``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import fold_u32, salted
from ..functions.session import bucketed
from ..shipping import ship
from .graph import Csr, Graph

#: Edges of a block (20 bytes each).
EDGES = 1 << 16
#: Blocks of a graph at most; their bounds take 16 bytes each in every task.
MOST_BLOCKS = 1 << 20
#: Tables of what was reached before they are merged.
MERGE = 4
#: Coins that are drawn at a time.
COINS = 1 << 20


class Blocks:
    """The adjacency of a graph by ``by`` (dst: predecessors, src: successors), in blocks."""

    def __init__(self, graph: Graph, by: str = "dst", edges: int = EDGES):
        spark = graph.edges.sparkSession
        ship(spark)
        edges = max(edges, -(-graph.m // MOST_BLOCKS))
        other = "src" if by == "dst" else "dst"
        # some blocks a task; a task is cut by range, whatever its vertices
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-graph.m // (16 * edges)))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, k, first = [], 0, TaskContext.get().partitionId() << 32

            def block(t: pa.Table, number: int) -> pa.RecordBatch:
                v, to, thr, eh = (t.column(c).to_numpy() for c in ("v", "to", "thr", "eh"))
                cells = [v.astype(np.int64), to.astype(np.int64), thr.astype(np.int64), eh.astype(np.uint32)]
                return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([int(v[0])]), pa.array([int(v[-1])]), pa.array([len(v)]), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=["block", "first", "last", "n", "v", "to", "thr", "eh"])

            rows = 0
            for b in batches:
                held.append(b)
                rows += b.num_rows
                while rows >= edges:
                    t = pa.Table.from_batches(held)
                    yield block(t.slice(0, edges), first + k)
                    held, rows, k = t.slice(edges).combine_chunks().to_batches(), rows - edges, k + 1
            if rows:
                yield block(pa.Table.from_batches(held), first + k)

        ordered = graph.edges.select(F.col(by).alias("v"), F.col(other).alias("to"), "k", "thr", "eh").repartitionByRange(tasks, "v", "to", "k").sortWithinPartitions("v", "to", "k")
        rows = ordered.drop("k").mapInArrow(pack, "block long, first long, last long, n long, v binary, to binary, thr binary, eh binary")
        self.table, self.name = bucketed(rows, "block")
        bounds = sorted(self.table.select("first", "last", "block").toLocalIterator())
        self.bounds = spark.sparkContext.broadcast(tuple(np.array([r[k] for r in bounds], np.int64) for k in range(3)))
        self.largest = self.table.agg(F.max("n")).first()[0] or 0

    def drop(self) -> None:
        self.table.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")

    def routed(self, words: DataFrame) -> DataFrame:
        """block, batch, v, bits: every word once for each block that holds edges of its vertex."""
        bounds = self.bounds

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, last, block = bounds.value
            for b in batches:
                v = b.column("v").to_numpy()
                lo, hi = np.searchsorted(last, v), np.searchsorted(first, v, side="right")
                n = np.maximum(hi - lo, 0)
                of = np.repeat(np.arange(len(v)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                yield pa.RecordBatch.from_arrays([pa.array(block[at]), *[b.column(c).take(pa.array(of)) for c in ("batch", "v", "bits")]], names=["block", "batch", "v", "bits"])

        return words.select("batch", "v", "bits").mapInArrow(route, "block long, batch long, v long, bits long")

    def sent(self, words: DataFrame, first: int) -> DataFrame:
        """batch, v, bits: what the words send along live edges; ``first``: where the hashes of the samples begin."""

        def along(block: pa.Table, ask: pa.Table) -> pa.Table:
            if not ask.num_rows:
                return pa.table({"batch": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "bits": pa.array([], pa.int64())})
            cell = lambda c, kind: np.frombuffer(block.column(c)[0].as_buffer(), kind)
            own, to, thr, eh = cell("v", np.int64), cell("to", np.int64), cell("thr", np.int64), cell("eh", np.uint32)
            batch, v = ask.column("batch").to_numpy(), ask.column("v").to_numpy()
            bits = ask.column("bits").to_numpy().view(np.uint64)
            # one row for each set bit
            which, bit = np.nonzero(np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            lo, hi = np.searchsorted(own, v[which]), np.searchsorted(own, v[which], side="right")
            sh = fold_u32(np.uint32(first), (batch[which] * 64 + bit).astype(np.uint32))
            ends, got = np.cumsum(hi - lo), []
            for at in range(0, int(ends[-1]), COINS):
                e = np.arange(at, min(at + COINS, int(ends[-1])))
                row = np.searchsorted(ends, e, side="right")
                e = lo[row] + e - (ends[row] - (hi - lo)[row])
                on = fold_u32(eh[e], sh[row]).astype(np.int64) < thr[e]
                got.append(united(batch[which[row[on]]], to[e[on]], np.uint64(1) << bit[row[on]].astype(np.uint64)))
            a, u, w = united(*(np.concatenate(x) for x in zip(*got, strict=True))) if got else (batch[:0], v[:0], bits[:0])
            return pa.table({"batch": a, "v": u, "bits": w.view(np.int64)})

        asked = self.routed(words)
        return self.table.select("block", "v", "to", "thr", "eh").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(along, "batch long, v long, bits long")


def united(batch: np.ndarray, v: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One word for each batch and vertex."""
    if not len(v):
        return batch, v, bits
    order = np.lexsort((v, batch))
    batch, v, bits = batch[order], v[order], bits[order]
    cut = np.flatnonzero(np.concatenate([[True], (batch[1:] != batch[:-1]) | (v[1:] != v[:-1])]))
    return batch[cut], v[cut], np.bitwise_or.reduceat(bits, cut)


def sent_words(csr: Csr, sh: np.ndarray, v: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (ascending) and words of what the words of the vertices v send along live edges; sh: the hashes of the word's samples."""
    which, bit = np.nonzero(np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    lo = csr.indptr[v[which]]
    n = csr.indptr[v[which] + 1] - lo
    ends, key, got = np.cumsum(n), sh.astype(np.uint32), [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for at in range(0, int(ends[-1]) if len(ends) else 0, COINS):
        e = np.arange(at, min(at + COINS, int(ends[-1])))
        row = np.searchsorted(ends, e, side="right")
        e = lo[row] + e - (ends[row] - n[row])
        on = fold_u32(csr.eh[e], key[bit[row]]) < csr.thr[e]
        to = csr.to[e[on]].astype(np.int64)
        got.append(united(np.zeros(len(to), np.int8), to, np.uint64(1) << bit[row[on]].astype(np.uint64))[1:])
    u, w = (np.concatenate(x) for x in zip(*got, strict=True))
    return united(np.zeros(len(u), np.int8), u, w)[1:]


def reach_words(csr: Csr, sh: np.ndarray, at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and words of all that up to 64 samples reach from the starts (sample index, vertex). What is reached is kept in order, so memory and work follow it and not the graph."""
    v, new = united(np.zeros(len(v), np.int8), v.astype(np.int64), np.uint64(1) << at.astype(np.uint64))[1:]
    seen, word = v, new.copy()
    while len(v):
        v, new = sent_words(csr, sh, v, new)
        place = np.searchsorted(seen, v)
        old = seen[np.minimum(place, len(seen) - 1)] == v
        new[old] &= ~word[place[old]]
        word[place[old]] |= new[old]
        seen, word = np.insert(seen, place[~old], v[~old]), np.insert(word, place[~old], new[~old])
        v, new = v[new != 0], new[new != 0]
    return seen, word


def sets_by_blocks(blocks: Blocks, rooted: DataFrame, stream: str, seed: int) -> DataFrame:
    """sid, v: the set of each row of ``rooted`` (sid, v), whose coins are those of the sample of its number."""
    spark, first, made = rooted.sparkSession, salted(stream, seed), []
    word = lambda c: F.bit_or(c).alias("bits")

    def keep(df: DataFrame) -> DataFrame:
        table, name = bucketed(df, "batch", "v")
        made.append(name)
        return table

    try:
        start = rooted.groupBy(F.floor(F.col("sid") / 64).alias("batch"), "v").agg(word(F.expr("shiftleft(1L, CAST(sid % 64 AS INT))")))
        frontier = keep(start)
        reached = [frontier]
        while frontier.limit(1).count():
            new = blocks.sent(frontier, first).groupBy("batch", "v").agg(word("bits"))
            for old in reached:
                new = new.join(old.select("batch", "v", F.col("bits").alias("_old")), ["batch", "v"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_old", F.lit(0).cast("long"))))).drop("_old")
            frontier = keep(new.filter("bits <> 0").select("batch", "v", "bits"))
            reached.append(frontier)
            if len(reached) > MERGE:
                reached = [keep(_united_files(reached).groupBy("batch", "v").agg(word("bits")))]
        found = _united_files(reached)  # files outlive their tables
    finally:
        for name in made:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    bit = F.explode(F.expr("filter(sequence(0, 63), i -> shiftrightunsigned(bits, i) & 1 = 1)"))
    return found.select("batch", "v", bit.alias("_bit")).select((F.col("batch") * 64 + F.col("_bit")).alias("sid"), "v")


def _united_files(tables: list[DataFrame]) -> DataFrame:
    """The rows of bucketed tables from their files: a union of bucketed scans passes for partitioned where it is not."""
    out = None
    for t in tables:
        if at := t.inputFiles():
            rows = t.sparkSession.read.schema(t.schema).parquet(*at)
            out = rows if out is None else out.union(rows)
    return tables[0].limit(0) if out is None else out
