"""Weighted directed multigraphs as DataFrames.

``vertices``: orig, vid (dense, in the order of orig). ``edges``: src, dst (dense), k (number among
parallel edges), weight, thr (floor(weight * 2^32): an edge is live when its coin is below), eh (the
edge's hash, from which its coins come). Parallel edges and self loops are kept.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import MASK, ONE, fold, salted
from ..functions.session import checkpoint, shared_folder
from ..shipping import ship

#: A graph up to this many edges may be sent to every executor as arrays (28 bytes an edge), where they cannot be mapped from a shared file.
CSR_EDGES = 8_000_000
#: Vertices of adjacency arrays at most, and edges that a task writes at a time.
CSR_VERTICES, WRITTEN = (1 << 31) - 1, 1 << 18
#: Id maps up to this many vertices are joined by broadcast.
BROADCAST_VERTICES = 1_000_000


def dense_ids(ids: DataFrame, column: str) -> DataFrame:
    """orig, vid: the rank (from 0) of every distinct value.

    Ranks come from the sizes of range partitions and the place in a partition, so no task sorts all ids.
    """
    parts = checkpoint(ids.select(F.col(column).alias("orig")).distinct().repartitionByRange("orig").withColumn("part", F.spark_partition_id()))
    base = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("orig")) - 1
    return parts.withColumn("r", rank).join(base, "part").select("orig", (F.col("base") + F.col("r")).cast("long").alias("vid"))


def threshold(weight: Column) -> Column:
    return F.floor(weight * F.lit(float(ONE))).cast("long")


def hashed(edges: DataFrame) -> DataFrame:
    """Add k and eh to src, dst, ...: parallel edges are numbered by weight."""
    order = [c for c in ("weight",) if c in edges.columns]
    k = F.row_number().over(Window.partitionBy("src", "dst").orderBy(*order)) - 1 if order else F.row_number().over(Window.partitionBy("src", "dst").orderBy("dst")) - 1
    out = edges.withColumn("k", k.cast("long"))
    for c in ("src", "dst", "k"):
        out = out.withColumn("eh", fold(F.col("eh") if c != "src" else salted("edge"), F.col(c).bitwiseAND(F.lit(MASK))))
    return out


@dataclass(frozen=True)
class Csr:
    """Adjacency arrays: the neighbours of v are at indptr[v] to indptr[v + 1], ordered by (neighbour, k)."""

    n: int
    indptr: np.ndarray
    to: np.ndarray
    thr: np.ndarray
    eh: np.ndarray
    #: running sum of thr, from 0; None: not kept
    total: np.ndarray | None = None

    def running(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.thr.astype(np.int64))]) if self.total is None else self.total


class MappedCsr:
    """Adjacency arrays as files in the shared folder, which every task maps: nothing of them passes through the driver, and a task reads the pages that it needs.

    The edges are sorted by range partitions, whose sizes and last vertices alone are collected; each task then writes
    its range to its place, so a hub's edges may be written by several.
    """

    KINDS = {"indptr": "<i8", "to": "<i4", "thr": "<u8", "eh": "<u4", "total": "<i8"}
    _open: dict[str, Csr] = {}

    def __init__(self, path: str, n: int, m: int):
        self.path, self.n, self.m = path, n, m

    @property
    def value(self) -> Csr:
        if self.path not in self._open:
            if len(self._open) > 8:
                self._open.clear()
            of = lambda c: np.memmap(f"{self.path}/{c}", np.dtype(self.KINDS[c]), "r").view(np.ndarray) if self.size(c) else np.zeros(0, self.KINDS[c])
            self._open[self.path] = Csr(self.n, *map(of, self.KINDS))
        return self._open[self.path]

    def size(self, name: str) -> int:
        return {"indptr": self.n + 1, "total": self.m + 1}.get(name, self.m)

    @classmethod
    def write(cls, graph: Graph, by: str, folder: str) -> MappedCsr:
        spark, other = graph.edges.sparkSession, "dst" if by == "src" else "src"
        ship(spark)
        out = cls(f"{folder}/adjacency-{uuid.uuid4().hex}", graph.n, graph.m)
        os.makedirs(out.path)
        for c, kind in cls.KINDS.items():
            with open(f"{out.path}/{c}", "wb") as f:
                f.truncate(out.size(c) * np.dtype(kind).itemsize)
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), out.m >> 21)
        ordered = graph.edges.select(F.col(by).alias("v"), F.col(other).alias("to"), "k", "thr", "eh").repartitionByRange(tasks, "v", "to", "k").sortWithinPartitions("v", "to", "k")
        parts = checkpoint(ordered.drop("k").withColumn("part", F.spark_partition_id()))
        place, at, last, total = {}, 0, -1, 0
        for r in sorted(parts.groupBy("part").agg(F.count("*"), F.max("v"), F.sum("thr")).collect()):
            place[r[0]] = at, last, total
            at, last, total = at + r[1], r[2], total + r[3]
        path, n, m, end = out.path, out.n, out.m, last

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            to_ = {c: open(f"{path}/{c}", "r+b") for c in cls.KINDS}
            held, rows, where = [], 0, None

            def flush() -> None:
                nonlocal where
                t = pa.Table.from_batches(held)
                v, to, thr, eh = (t.column(c).to_numpy() for c in ("v", "to", "thr", "eh"))
                at, last, total = where
                u, sums = np.arange(last + 1, v[-1] + 1), total + np.cumsum(thr)
                cells = {"indptr": (last + 1, at + np.searchsorted(v, u)), "to": (at, to), "thr": (at, thr), "eh": (at, eh), "total": (at + 1, sums)}
                if at + len(v) == m:
                    cells["indptr"] = last + 1, np.concatenate([cells["indptr"][1], np.full(n - end, m)])
                for c, (first, x) in cells.items():
                    kind = np.dtype(cls.KINDS[c])
                    to_[c].seek(first * kind.itemsize)
                    to_[c].write(x.astype(kind).tobytes())
                where = at + len(v), int(v[-1]), int(sums[-1])
                held.clear()

            for b in batches:
                if not b.num_rows:
                    continue
                where = where or place[b.column("part")[0].as_py()]
                held.append(b)
                rows += b.num_rows
                if rows >= WRITTEN:
                    flush()
                    rows = 0
            if held:
                flush()
            for f in to_.values():
                f.close()
            yield from ()

        parts.mapInArrow(put, "v long").count()
        return out


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    direction: str = "forward"

    @classmethod
    def build(cls, edges: DataFrame, renumber: bool = True, weigh: Callable[[DataFrame], DataFrame] | None = None) -> Graph:
        """From src, dst and maybe weight (null or absent: 1.0), in original ids; ``weigh`` gives the edges other weights."""
        edges = edges.select("src", "dst", (F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)).alias("weight"))
        if renumber:
            vertices = checkpoint(dense_ids(edges.select("src").union(edges.select("dst")), "src"))
            small = vertices.count() <= BROADCAST_VERTICES
            side = lambda c: (F.broadcast if small else lambda d: d)(vertices.select(F.col("orig").alias(c), F.col("vid").alias(f"_{c}")))
            edges = edges.join(side("src"), "src").join(side("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "weight")
        else:
            top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
            vertices = edges.sparkSession.range(0 if top is None else top + 1).select(F.col("id").alias("orig"), F.col("id").alias("vid"))
        edges = hashed(edges).withColumn("thr", threshold(F.col("weight")))
        return cls(vertices, checkpoint(weigh(edges) if weigh else edges))

    def with_weights(self, weighted: DataFrame) -> Graph:
        """The same graph with the weights (and thr) of another edge table."""
        return replace(self, edges=checkpoint(weighted))

    @cached_property
    def n(self) -> int:
        return self.vertices.count()

    @cached_property
    def m(self) -> int:
        return self.edges.count()

    def transpose(self) -> Graph:
        """All edges turned round; ids, weights and hashes stay, so the same coins decide."""
        swapped = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in self.edges.columns if c not in ("src", "dst")])
        return replace(self, edges=swapped, direction="backward" if self.direction == "forward" else "forward")

    def degree(self, side: str = "src") -> DataFrame:
        """vid, degree; 0 for vertices without edges."""
        counts = self.edges.groupBy(F.col(side).alias("vid")).agg(F.count("*").alias("_d"))
        return self.vertices.select("vid").join(counts, "vid", "left").select("vid", F.coalesce("_d", F.lit(0)).cast("long").alias("degree"))

    def neighbors(self, vid: int) -> DataFrame:
        return self.edges.filter(F.col("src") == vid).select("dst", "weight")

    def to_original(self, df: DataFrame, column: str = "vid") -> DataFrame:
        """Translate a column of dense ids."""
        names = self.vertices.select(F.col("vid").alias(column), F.col("orig").alias("_orig"))
        return df.join(names, column).withColumn(column, F.col("_orig")).drop("_orig")

    def to_dense(self, df: DataFrame, column: str = "orig") -> DataFrame:
        """Translate a column of original ids; unknown ones raise ValueError."""
        names = self.vertices.select(F.col("orig").alias(column), F.col("vid").alias("_vid"))
        missing = df.join(names, column, "left_anti").select(column).limit(5).collect()
        if missing:
            raise ValueError(f"no such vertices: {[r[0] for r in missing]}")
        return df.join(names, column).withColumn(column, F.col("_vid")).drop("_vid")

    def dense_list(self, ids: list[int]) -> list[int]:
        found = dict(map(tuple, self.vertices.filter(F.col("orig").isin(list(ids))).select("orig", "vid").collect()))
        if missing := [i for i in ids if i not in found]:
            raise ValueError(f"no such vertices: {missing}")
        return [found[i] for i in ids]

    def original_list(self, vids: list[int]) -> list[int]:
        found = dict(map(tuple, self.vertices.filter(F.col("vid").isin([int(v) for v in vids])).select("vid", "orig").collect()))
        if missing := [v for v in vids if v not in found]:
            raise ValueError(f"no such vertices: {missing}")
        return [found[v] for v in vids]

    @cached_property
    def _live_degree(self) -> float:
        return (self.edges.agg(F.sum("thr")).first()[0] or 0) / ONE / max(self.n, 1)

    def live_degree(self) -> float:
        """Live in-edges of a vertex, on average, under independent cascades."""
        return self._live_degree

    def mappable(self) -> bool:
        return shared_folder(self.edges.sparkSession) is not None and self.n <= CSR_VERTICES

    def fits_csr(self) -> bool:
        """Whether tasks can have the adjacency arrays: mapped from the shared folder, or else as a broadcast variable."""
        return self.mappable() or (self.m <= CSR_EDGES and self.n <= CSR_EDGES)

    def csr(self, by: str = "src") -> Csr:
        """Adjacency arrays on the driver, by ``src`` (successors) or ``dst`` (predecessors); only for graphs that fit."""
        if self.m > CSR_EDGES or self.n > CSR_EDGES:
            raise ValueError(f"{self.m} edges are too many to be sent to every executor")
        t = self.edges.select("src", "dst", "k", "thr", "eh").toArrow()
        a = {c: t.column(c).to_numpy() for c in t.column_names}
        other = "dst" if by == "src" else "src"
        order = np.lexsort((a["k"], a[other], a[by]))
        indptr = np.concatenate([[0], np.cumsum(np.bincount(a[by], minlength=self.n))]).astype(np.int64)
        return Csr(self.n, indptr, a[other][order].astype(np.int32), a["thr"][order].astype(np.uint64), a["eh"][order].astype(np.uint32))

    @cached_property
    def _sent(self) -> dict:
        return {}

    def sent_csr(self, by: str) -> MappedCsr | Broadcast:
        """The adjacency arrays, whose ``value`` tasks have: written to the shared folder and mapped, or else a broadcast variable. Made once."""
        if by not in self._sent:
            folder = shared_folder(self.edges.sparkSession)
            self._sent[by] = MappedCsr.write(self, by, folder) if self.mappable() else self.edges.sparkSession.sparkContext.broadcast(self.csr(by))
        return self._sent[by]

    def blocks(self, by: str):
        """The adjacency in blocks, made once."""
        if ("blocks", by) not in self._sent:
            from .blocks import Blocks

            self._sent["blocks", by] = Blocks(self, by)
        return self._sent["blocks", by]

    def communities(self, labels: DataFrame) -> DataFrame:
        """community, src, dst (dense in the community's own edges, from 0), gsrc, gdst, weight: edges inside communities.

        ``labels``: orig, community. Vertices without an edge inside their community vanish.
        """
        lab = self.vertices.join(labels, "orig").select("vid", "community")
        inside = (
            self.edges.join(lab.select(F.col("vid").alias("src"), F.col("community").alias("_c")), "src")
            .join(lab.select(F.col("vid").alias("dst"), "community"), "dst").filter("_c = community")
            .select("community", F.col("src").alias("gsrc"), F.col("dst").alias("gdst"), "weight", "k", "thr", "eh")
        )
        own = inside.select("community", F.col("gsrc").alias("v")).union(inside.select("community", "gdst")).distinct()
        own = own.withColumn("local", (F.row_number().over(Window.partitionBy("community").orderBy("v")) - 1).cast("long"))
        s, d = (own.select("community", F.col("v").alias(f"g{x}"), F.col("local").alias(x)) for x in ("src", "dst"))
        return inside.join(s, ["community", "gsrc"]).join(d, ["community", "gdst"])
