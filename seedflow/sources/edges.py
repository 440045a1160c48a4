"""Edge lists, stored graphs, community lists, stored sets and experiment records."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.session import checkpoint
from ..operators import weights
from ..operators.graph import Graph
from ..operators.influence import Sets

EDGES = "src long, dst long, weight double"


def parse_lines(lines: DataFrame, weighted: bool, column: str = "value") -> DataFrame:
    """src, dst, weight (null where there is none) of text lines.

    Fields are parted by white space, more fields are ignored; empty lines and lines with ``%`` or ``#``
    anywhere are skipped; a line without two (weighted: three) numbers raises when it is read.
    """
    kept = lines.filter((F.trim(F.col(column)) != "") & ~F.col(column).rlike("[%#]"))
    part = F.split(F.trim(F.regexp_replace(F.col(column), r"\s+", " ")), " ")

    def field(at: int, kind: str):
        return F.coalesce(F.get(part, F.lit(at)).cast(kind), F.raise_error(F.concat(F.lit("an edge lacks a field: "), F.col(column))).cast(kind))

    return kept.select(field(0, "long").alias("src"), field(1, "long").alias("dst"), (field(2, "double") if weighted else F.lit(None).cast("double")).alias("weight"))


def read_edges(spark: SparkSession, path: str, weighted: bool = False, undirected: bool = False, scale: float = 1.0) -> DataFrame:
    """An edge list in text. The reverse edge of a weighted one shares its weight; ``scale`` must not exceed 1 for weighted lists."""
    edges = parse_lines(spark.read.text(path), weighted)
    if weighted:
        if scale > 1:
            raise ValueError("scale_factor must not exceed 1")
        edges = edges.withColumn("weight", F.col("weight") * scale)
    return weights.undirected(edges, shared=weighted) if undirected else edges


def load_graph(spark: SparkSession, path: str, weighted: bool = False, undirected: bool = False, model: str = "IC", distribution: str = "uniform", mean: float = 0.5, deviation: float = 1.0, scale: float = 1.0, renumber: bool = True, seed: int = 0, normalize_by: str = "dst", bits: int | None = None) -> Graph:
    """Read, number and weigh a graph; unweighted lists draw weights, and are normalised for LT.

    ``bits`` (8 or 16): weights become integers of so many bits as they are loaded (column ``wq``).
    """
    if model not in ("IC", "LT"):
        raise ValueError(f"unknown diffusion model: {model}")
    graph = Graph.build(read_edges(spark, path, weighted, undirected, scale if weighted else 1.0), renumber)
    whole = lambda edges: graph.with_weights(edges if bits is None else weights.quantize(edges, bits))
    if weighted:
        return graph if bits is None else whole(graph.edges)
    how = {"uniform": {"scale": scale, "seed": seed}, "normal": {"mean": mean, "deviation": deviation, "scale": scale, "seed": seed}, "const": {"mean": mean}}.get(distribution)
    if how is None:
        raise ValueError(f"unsupported distribution: {distribution}")
    edges = weights.assign(graph.edges, distribution, **how)
    return whole(weights.lt_normalize(edges, normalize_by, seed) if model == "LT" else edges)


def write_graph(graph: Graph, path: str, bits: int | None = None, made_of: dict | None = None) -> None:
    """Store vertices and edges as Parquet, and what they are as JSON; ``bits`` (8 or 16): weights as integers of so many bits. ``made_of``: see ``open_or_create``."""
    graph.vertices.write.parquet(f"{path}/vertices")
    edges = graph.edges if bits is None else graph.edges.withColumn("weight", weights.quantum(F.col("weight"), bits).cast("short" if bits == 8 else "int")).drop("thr")
    edges.write.parquet(f"{path}/edges")
    meta = [(json.dumps({"format": "seedflow-graph-1", "direction": graph.direction, "weight": "double" if bits is None else f"uint{bits}", "vertices": graph.n, "edges": graph.m, "made_of": made_of}),)]
    graph.edges.sparkSession.createDataFrame(meta, "value string").coalesce(1).write.text(f"{path}/meta")


def reload_graph(spark: SparkSession, path: str, direction: str | None = None, scale: float = 1.0, made_of: dict | None = None) -> Graph:
    """A stored graph; a wrong format or direction, or one that was made of something else, raises ValueError."""
    if scale > 1:
        raise ValueError("scale_factor must not exceed 1")
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    kinds = {"double": None, "uint8": 8, "uint16": 16}
    if meta.get("format") != "seedflow-graph-1" or meta.get("weight") not in kinds:
        raise ValueError(f"not a stored graph: {path}")
    if direction and meta["direction"] != direction:
        raise ValueError(f"the stored graph is {meta['direction']}")
    if made_of is not None and meta.get("made_of") != made_of:
        found = meta.get("made_of") or {}
        raise ValueError(f"the graph stored at {path} is of another {', '.join(k for k in made_of if found.get(k) != made_of[k]) or 'kind'}")
    edges, bits = spark.read.parquet(f"{path}/edges"), kinds[meta["weight"]]
    if bits:
        if scale != 1:
            raise ValueError("stored integers cannot be scaled")
        edges = edges.withColumn("thr", weights.quantum_threshold(F.col("weight"), bits)).withColumn("weight", F.col("weight") / float((1 << bits) - 1))
    graph = Graph(spark.read.parquet(f"{path}/vertices"), edges, meta["direction"])
    if scale != 1:
        from ..operators.graph import threshold

        graph = graph.with_weights(edges.withColumn("weight", F.col("weight") * scale).withColumn("thr", threshold(F.col("weight"))))
    return graph


def input_mark(spark: SparkSession, path: str, stored_graph: bool = False) -> dict:
    """What an input holds, whatever its name or the order of its lines: their number and the sum of their hashes."""
    rows = spark.read.parquet(f"{path}/edges") if stored_graph else spark.read.text(path)
    n, total = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    return {"lines": n, "hash": str(total or 0)}


def open_or_create(spark: SparkSession, path: str, build, made_of: dict | None = None) -> Graph:
    """The graph stored at ``path``, or ``build()`` stored there. A stored graph that was not made of ``made_of`` (input, weights, model, seed) raises ValueError."""
    try:
        return reload_graph(spark, path, made_of=made_of)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    write_graph(build(), path, made_of=made_of)
    return reload_graph(spark, path, made_of=made_of)


def write_edge_text(graph: Graph, path: str, normalize: bool = False) -> None:
    """Lines ``src dst weight``, in original ids, or in dense ids from 1."""
    edges = graph.edges.select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"), "weight") if normalize else graph.to_original(graph.to_original(graph.edges.select("src", "dst", "weight"), "src"), "dst")
    edges.select(F.concat_ws(" ", "src", "dst", "weight")).write.text(path)


def read_communities(spark: SparkSession, path: str, first: int = 1) -> DataFrame:
    """orig, community of a white-space list: its i-th number (from 0) is the label of vertex i + first.

    Files are read in splits, in the order of their names: a number's place is what stands before its split, before
    its line in the split, and before it in the line, so any number of tasks may read one file.
    """
    part = F.filter(F.split(F.col("value"), r"\s+"), lambda x: x != "")
    lines = spark.read.text(path).select(part.alias("part"), F.input_file_name().alias("file"), F.input_file_block_start().alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = checkpoint(lines.withColumn("n", F.size("part")).filter("n > 0"))
    per = lines.groupBy("file", "split").agg(F.sum("n").alias("_n"))  # a row a split
    before = per.withColumn("base", F.sum("_n").over(Window.orderBy("file", "split")) - F.col("_n")).drop("_n")
    inside = F.sum("n").over(Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = lines.withColumn("inside", inside).join(before, ["file", "split"]).select("base", "inside", F.posexplode("part"))
    return placed.select((F.col("base") + F.col("inside") + F.col("pos") + first).cast("long").alias("orig"), F.col("col").cast("long").alias("community"))


def fingerprint(graph: Graph, model: str, seed: int, stream: str = "sample") -> dict:
    """What a set depends on: the edges (a sum of hashes, whatever their order), their number, the model, the seed and the stream."""
    total = graph.edges.agg(F.sum(F.xxhash64("src", "dst", "k", "thr").cast("decimal(38,0)"))).first()[0]
    return {"format": "seedflow-sets-2", "edges": str(total or 0), "n": graph.n, "m": graph.m, "model": model, "seed": seed, "stream": stream}


def store_sets(sets: Sets, path: str, since: int = 0) -> None:
    """Add the sets ``since`` to ``sets.drawn - 1`` to a store. A range is a folder that is written whole; written again, it replaces itself."""
    spark, mark = sets.graph.edges.sparkSession, fingerprint(sets.graph, sets.model, sets.seed, sets.stream)
    _check_mark(spark, path, mark)
    if since == 0:
        spark.createDataFrame([(json.dumps(mark),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/mark")
    if sets.drawn > since:
        sets.rows.filter((F.col("sid") >= since) & (F.col("sid") < sets.drawn)).write.mode("overwrite").parquet(f"{path}/sets/start={since}/stop={sets.drawn}")


def _check_mark(spark: SparkSession, path: str, mark: dict) -> bool:
    """Whether there is a store; one of other sets raises ValueError."""
    try:
        found = json.loads(spark.read.text(f"{path}/mark").first()[0])
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False
    if found != mark:
        raise ValueError(f"the stored sets are of another graph, model or seed: {[k for k in mark if mark[k] != found.get(k)]}")
    return True


def reload_sets(graph: Graph, path: str, model: str, seed: int = 0, stream: str = "sample") -> Sets:
    """The stored sets of this graph, model and seed (none where there is no store), as many as follow each other from 0."""
    spark = graph.edges.sparkSession
    if not _check_mark(spark, path, fingerprint(graph, model, seed, stream)):
        return Sets(graph, model, stream, seed)
    try:
        rows = spark.read.schema("sid long, v long, start long, stop long").parquet(f"{path}/sets")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return Sets(graph, model, stream, seed)
    drawn, used = 0, []
    for start, stop in sorted(map(tuple, rows.select("start", "stop").distinct().collect())):
        if start == drawn:
            drawn, used = stop, [*used, start]
    return Sets(graph, model, stream, seed, rows.filter(F.col("start").isin(used) & (F.col("sid") < drawn)).select("sid", "v").distinct(), drawn)


def write_records(records: list[dict], path: str) -> None:
    Path(path).write_text(json.dumps(records, indent=2))


def read_records(path: str) -> list[dict]:
    got = json.loads(Path(path).read_text())
    return got if isinstance(got, list) else [got]
