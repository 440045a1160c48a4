"""The published binary layout of weighted graphs, as a Spark data source on a file system that all executors share.

Fixed values, little-endian: five 64-bit numbers (a mark, the direction, the bits of a weight, vertices, edges), the
vertices' original ids (32 bits each), where each vertex's edges begin (64 bits each, one more at the end), the edges'
other vertices (32 bits each), and the weights (a 32-bit float, or an integer of 16 or 8 bits each). A forward
graph has the edges of a vertex's successors, a backward one those of its predecessors.

Reading: partitions are ranges of vertices or edges, and a task reads its own bytes. Writing: rows come with their
places, tasks write them at their offsets of a file beside the target, and the commit writes the header and
renames it; a task that runs again writes the same bytes.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.session import checkpoint
from ..operators import weights
from ..operators.graph import Graph, hashed, threshold
from ..shipping import ship

MARK = 0xC0FFEE
DIRECTIONS = {"forward": 0xF0CACC1A, "backward": 0xA1CCAC0F}
KINDS = {32: np.dtype("<f4"), 16: np.dtype("<u2"), 8: np.dtype("<u1")}
HEADER = struct.Struct("<5Q")
#: Vertices or edges of a partition, and rows of a batch.
RANGE, BATCH = 1 << 21, 1 << 16
#: Vertices whose edges' begins are summed together.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Layout:
    direction: str
    bits: int
    n: int
    m: int

    @property
    def begins(self) -> int:
        return HEADER.size + 4 * self.n

    @property
    def others(self) -> int:
        return self.begins + 8 * (self.n + 1)

    @property
    def weights(self) -> int:
        return self.others + 4 * self.m

    @property
    def size(self) -> int:
        return self.weights + self.bits // 8 * self.m


def layout_of(path: str) -> Layout:
    """The header of a file; one that is no such file raises ValueError."""
    with open(path, "rb") as f:
        head = f.read(HEADER.size)
    if len(head) < HEADER.size or HEADER.unpack(head)[0] != MARK:
        raise ValueError(f"not a binary graph of this byte order: {path}")
    _, direction, bits, n, m = HEADER.unpack(head)
    names = {v: k for k, v in DIRECTIONS.items()}
    if direction not in names or bits not in KINDS:
        raise ValueError(f"an unknown direction or weight in {path}")
    out = Layout(names[direction], bits, n, m)
    if os.path.getsize(path) != out.size:
        raise ValueError(f"{path} has {os.path.getsize(path)} bytes, its header tells {out.size}")
    return out


@dataclass
class Range(InputPartition):
    start: int
    stop: int


class GraphReader(DataSourceReader):
    def __init__(self, path: str, part: str):
        self.path, self.part = path, part

    def partitions(self) -> list[InputPartition]:
        at = layout_of(self.path)
        total = at.n if self.part == "vertices" else at.m
        return [Range(a, min(a + RANGE, total)) for a in range(0, total, RANGE)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        at = layout_of(self.path)
        view = lambda kind, offset, count: np.memmap(self.path, kind, "r", offset, (count,)) if count else np.zeros(0, kind)
        if self.part == "vertices":
            ids = view("<u4", HEADER.size, at.n)
            for a in range(partition.start, partition.stop, BATCH):
                b = min(a + BATCH, partition.stop)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b].astype(np.int64)), pa.array(np.arange(a, b))], names=["orig", "vid"])
            return
        begins, others, weight = view("<u8", at.begins, at.n + 1), view("<u4", at.others, at.m), view(KINDS[at.bits], at.weights, at.m)
        for a in range(partition.start, partition.stop, BATCH):
            b = min(a + BATCH, partition.stop)
            lo, hi = np.searchsorted(begins, a, side="right") - 1, np.searchsorted(begins, b - 1, side="right")
            own = lo + np.searchsorted(begins[lo : hi + 1].astype(np.int64), np.arange(a, b), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(others[a:b].astype(np.int64)), pa.array(weight[a:b].astype(np.float64))], names=["own", "other", "weight"])


class GraphWriter(DataSourceArrowWriter):
    """Rows kind (0: vertex, 1: edge), pos, a (original id, or other vertex), b (where its edges begin, or weight)."""

    def __init__(self, path: str, at: Layout):
        self.path, self.at, self.beside = path, at, f"{path}.writing"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        file = os.open(self.beside, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for batch in iterator:
                kind, pos, a, b = (batch.column(c).to_numpy() for c in ("kind", "pos", "a", "b"))
                for k, base, more, ids in ((0, self.at.begins, np.dtype("<u8"), HEADER.size), (1, self.at.weights, KINDS[self.at.bits], self.at.others)):
                    own = np.flatnonzero(kind == k)
                    for run in np.split(own, np.flatnonzero(np.diff(pos[own]) != 1) + 1) if len(own) else []:
                        first = int(pos[run[0]])
                        os.pwrite(file, a[run].astype("<u4").tobytes(), ids + 4 * first)
                        os.pwrite(file, b[run].astype(more).tobytes(), base + more.itemsize * first)
        finally:
            os.close(file)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        with open(self.beside, "r+b" if os.path.exists(self.beside) else "w+b") as f:
            f.write(HEADER.pack(MARK, DIRECTIONS[self.at.direction], self.at.bits, self.at.n, self.at.m))
            f.seek(self.at.begins + 8 * self.at.n)
            f.write(struct.pack("<Q", self.at.m))
            f.truncate(self.at.size)
        os.replace(self.beside, self.path)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.beside):
            os.remove(self.beside)


class GraphFile(DataSource):
    """Options: path, and part (vertices or edges) to read, or direction, bits, n and m to write."""

    @classmethod
    def name(cls) -> str:
        return "seedflow_graph"

    def schema(self) -> str:
        return "orig long, vid long" if self.options["part"] == "vertices" else "own long, other long, weight double"

    def reader(self, schema) -> GraphReader:
        return GraphReader(self.options["path"], self.options["part"])

    def writer(self, schema, overwrite: bool) -> GraphWriter:
        o = self.options
        if not overwrite and os.path.exists(o["path"]):
            raise ValueError(f"{o['path']} is there already")
        return GraphWriter(o["path"], Layout(o["direction"], int(o["bits"]), int(o["n"]), int(o["m"])))


def _format(spark: SparkSession) -> str:
    ship(spark)
    spark.dataSource.register(GraphFile)
    return GraphFile.name()


def read_binary(spark: SparkSession, path: str, direction: str | None = None, bits: int | None = None, scale: float = 1.0) -> Graph:
    """The graph of a binary file. A wrong mark, another direction or another width of weights than is asked for raises ValueError."""
    at = layout_of(path)
    if direction and at.direction != direction:
        raise ValueError(f"the stored graph is {at.direction}; write it again, turned round")
    if bits and at.bits != bits:
        raise ValueError(f"the stored weights have {at.bits} bits, not {bits}")
    if scale > 1 or (scale != 1 and at.bits != 32):
        raise ValueError("scale_factor must not exceed 1, and stored integers cannot be scaled")
    reader = spark.read.format(_format(spark)).option("path", path)
    rows = reader.option("part", "edges").load()
    edges = hashed(rows.select(F.col("own").alias("src"), F.col("other").alias("dst"), (F.col("weight") * scale).alias("weight")))
    if at.bits == 32:
        edges = edges.withColumn("thr", threshold(F.col("weight")))
    else:
        edges = edges.withColumn("wq", F.col("weight").cast("int")).withColumn("thr", weights.quantum_threshold(F.col("wq"), at.bits)).withColumn("weight", F.col("wq") / float((1 << at.bits) - 1))
    graph = Graph(reader.option("part", "vertices").load(), checkpoint(edges))
    return graph if at.direction == "forward" else Graph(graph.vertices, graph.transpose().edges, "backward")


def _ranked(df: DataFrame, *by: str) -> DataFrame:
    """With ``pos``, the place in the order of ``by``: the sizes of range partitions and the place in one."""
    parts = checkpoint(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    base = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return parts.withColumn("_r", rank).join(base, "_part").withColumn("pos", F.col("_base") + F.col("_r")).drop("_part", "_r", "_base")


def write_binary(graph: Graph, path: str, bits: int = 32) -> None:
    """Write a graph whose ids fit into 32 bits, by the vertex of its direction; ``bits``: 32, or 16 or 8 for integers."""
    spark = graph.edges.sparkSession
    if bits not in KINDS:
        raise ValueError("32, 16 or 8 bits")
    if graph.n and (graph.n > 1 << 32 or graph.vertices.filter((F.col("orig") < 0) | (F.col("orig") >= 1 << 32)).limit(1).count()):
        raise ValueError("ids must fit into 32 bits")
    own, other = ("src", "dst") if graph.direction == "forward" else ("dst", "src")
    value = F.col("weight") if bits == 32 else weights.quantum(F.col("weight"), bits).cast("double")
    placed = _ranked(graph.edges.select(own, other, "k", value.alias("b")), own, other, "k")
    edges = placed.select(F.lit(1).alias("kind"), F.col("pos").cast("long"), F.col(other).cast("long").alias("a"), F.col("b"))
    counts = graph.vertices.join(placed.groupBy(F.col(own).alias("vid")).agg(F.count("*").alias("_d")), "vid", "left").select("vid", "orig", F.coalesce("_d", F.lit(0)).alias("d"), F.floor(F.col("vid") / CHUNK).alias("chunk"))
    before = counts.groupBy("chunk").agg(F.sum("d").alias("_n")).select("chunk", (F.sum("_n").over(Window.orderBy("chunk")) - F.col("_n")).alias("base"))
    inside = F.sum("d").over(Window.partitionBy("chunk").orderBy("vid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("d")
    vertices = counts.withColumn("in", inside).join(before, "chunk").select(F.lit(0).alias("kind"), F.col("vid").cast("long").alias("pos"), F.col("orig").cast("long").alias("a"), (F.col("base") + F.col("in")).cast("double").alias("b"))
    rows = vertices.union(edges).repartitionByRange("kind", "pos").sortWithinPartitions("kind", "pos")
    how = {"path": path, "direction": graph.direction, "bits": bits, "n": graph.n, "m": graph.m}
    rows.write.format(_format(spark)).options(**how).mode("overwrite").save()
