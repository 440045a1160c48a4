"""Reachability in sampled worlds: reverse-reachable sets, forward simulation, live edges.

Physical strategies give identical rows, since every coin is a hash of (edge or vertex, sample):

* ``local``: tasks map the adjacency arrays from files in the shared folder (where that is no file system: a graph
  that is small enough by its counts is broadcast), and traverse batches of samples with numpy, one job in all;
* ``bits``: as ``local``, for independent cascades: a vertex has one bit for each of 64 samples, and a hop
  passes over the edges once for all of them; an edge's 64 coins are drawn together, when it is first met.
  ``auto`` takes it where a vertex has more than one live in-edge on average, so that samples overlap;
* ``blocks``: for independent cascades on graphs of any size, see ``blocks``; over mapped arrays, a task goes all hops
  of the words of its samples, in one job;
* ``frontier``: any size and model; starts are dealt out by sample over mapped arrays. Where they cannot be mapped, a
  driver loop joins the frontier with the edges, hop by hop, anti-joins what was visited, and checkpoints every hop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import ONE, fold, fold_np, fold_u32, salted
from ..functions.session import bucketed, checkpoint, stored
from ..shipping import ship
from .blocks import reach_words, sets_by_blocks
from .graph import CSR_EDGES, Csr, Graph

#: Cells (samples x vertices) of one batch's visited bitmap.
CELLS = 1 << 25
#: Rows of a batch that tasks give back.
OUT_ROWS = 1 << 17
#: Edges that a pass of bits looks at together.
EDGES_AT_ONCE = 1 << 22
#: Live in-edges a vertex, on average, above which 64 samples share a pass over the edges.
BITS_DEGREE = 1.5
#: LTR: linear thresholds whose live parents are drawn by exponential races, so that no vertex's in-edges are put in order.
MODELS = ("IC", "LT", "LTR")


def check_model(model: str) -> str:
    if model not in MODELS:
        raise ValueError(f"unknown diffusion model: {model}")
    return model


def samples(spark: SparkSession, start: int, stop: int, stream: str = "sample", seed: int = 0) -> DataFrame:
    """sid, sh: sample numbers and their hashes."""
    return spark.range(start, stop).select(F.col("id").alias("sid"), fold(salted(stream, seed), F.col("id")).alias("sh"))


def root_of(sh: Column, n: int) -> Column:
    return (fold(salted("root"), sh) % n).cast("long")


def vertex_coin(v: Column, sh: Column) -> Column:
    return fold(fold(salted("vertex"), v), sh)


def live(edges: DataFrame, sh: Column) -> Column:
    """Whether an independent-cascade edge is live in the sample of hash sh."""
    return fold(F.col("eh"), sh) < F.col("thr")


def lt_intervals(edges: DataFrame) -> DataFrame:
    """Edges with [lo, hi) in their head's interval of 2^32, in the order of (src, k): the vertex's coin picks at most one."""
    w = Window.partitionBy("dst").orderBy("src", "k").rowsBetween(Window.unboundedPreceding, 0)
    return edges.withColumn("hi", F.sum("thr").over(w)).withColumn("lo", F.col("hi") - F.col("thr"))


def with_rest(edges: DataFrame) -> DataFrame:
    """Edges with ``rest``, 2^32 less the weights into their head."""
    total = edges.groupBy("dst").agg(F.greatest(F.lit(ONE) - F.sum("thr"), F.lit(0)).alias("rest"))
    return edges.join(total, "dst")


def race_time(coin: Column, weight: Column) -> Column:
    return F.when(weight > 0, -F.log((coin + 0.5) / float(ONE)) / weight)


def race_winners(asked: DataFrame) -> DataFrame:
    """sid, sh, v, _to of the live parents; ``asked``: sid, sh, v, and the in-edges of v (_to, thr, eh, rest). An aggregate: any task may hold some of a hub's edges."""
    time = race_time(fold(F.col("eh"), F.col("sh")), F.col("thr"))
    best = asked.filter("thr > 0").groupBy("sid", "sh", "v", "rest").agg(F.min(F.struct(time.alias("t"), F.col("_to").alias("u"))).alias("b"))
    none = race_time(vertex_coin(F.col("v"), F.col("sh")), F.col("rest"))
    return best.filter(F.col("b.t") < F.coalesce(none, F.lit(float("inf")))).select("sid", "sh", "v", F.col("b.u").alias("_to"))


# -- numpy


def _expand(csr: Csr, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the frontier entry and place of the edge, for all edges of the vertices v."""
    n = csr.indptr[v + 1] - csr.indptr[v]
    which = np.repeat(np.arange(len(v)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(csr.indptr[v], n)


def reach_ic(csr: Csr, sh: np.ndarray, at: np.ndarray, v: np.ndarray, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sample index, vertex and hop of all that is reached from the starts (at, v); ``seen`` is a bitmap of what counts as reached before."""
    seen = np.zeros(len(sh) * csr.n, bool) if seen is None else seen
    key = np.unique(at.astype(np.int64) * csr.n + v)
    key = key[~seen[key]]
    found, hops, hop = [key], [np.zeros(len(key), np.int32)], 0
    while len(key):
        seen[key] = True
        s, u = key // csr.n, key % csr.n
        which, e = _expand(csr, u)
        on = fold_np(csr.eh[e], sh[s[which]]) < csr.thr[e]
        key = np.unique(s[which[on]] * csr.n + csr.to[e[on]])
        key = key[~seen[key]]
        hop += 1
        found.append(key)
        hops.append(np.full(len(key), hop, np.int32))
    all_ = np.concatenate(found)
    return all_ // csr.n, all_ % csr.n, np.concatenate(hops)


def reach_along(n: int, sh: np.ndarray, at: np.ndarray, v: np.ndarray, seen: np.ndarray, step: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same along what ``step`` (vertices, hashes) finds: the index of the vertex, and the one that it leads to."""
    key = np.unique(at.astype(np.int64) * n + v)
    key = key[~seen[key]]
    found, hops, hop = [key], [np.zeros(len(key), np.int32)], 0
    while len(key):
        seen[key] = True
        s = key // n
        which, to = step(key % n, sh[s])
        key = np.unique(s[which] * n + to)
        key = key[~seen[key]]
        hop += 1
        found.append(key)
        hops.append(np.full(len(key), hop, np.int32))
    all_ = np.concatenate(found)
    return all_ // n, all_ % n, np.concatenate(hops)


def stepper(csr: Csr, heads: Csr | None, model: str) -> Callable:
    """One hop over the edges of ``csr``: backwards (by head), or forwards (by tail) with ``heads`` to ask for the live in-edges of linear thresholds."""
    if model == "IC":

        def step(v: np.ndarray, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            which, e = _expand(csr, v)
            on = fold_np(csr.eh[e], sh[which]) < csr.thr[e]
            return which[on], csr.to[e[on]]

        return step
    if heads is not None:
        total = heads.running()

        def step(v: np.ndarray, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            which, e = _expand(csr, v)
            ok, parent = lt_parents(heads, total, csr.to[e].astype(np.int64), sh[which])
            on = ok & (parent == v[which])
            return which[on], csr.to[e[on]]

        return step
    own = csr.running() if model == "LT" else rests(csr)

    def step(v: np.ndarray, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok, parent = (lt_parents if model == "LT" else race_parents)(csr, own, v, sh)
        return np.flatnonzero(ok), parent[ok]

    return step


def coin_bits(eh: np.ndarray, thr: np.ndarray, sh: np.ndarray) -> np.ndarray:
    """For each edge, one bit for each of up to 64 samples: whether it is live there."""
    out, key = np.zeros(len(eh), np.uint64), sh.astype(np.uint32)
    last = (np.maximum(thr, 1) - 1).astype(np.uint32)  # thr may be 2^32
    for at in range(0, len(eh), 1 << 14):
        on = fold_u32(eh[at : at + (1 << 14), None], key) <= last[at : at + (1 << 14), None]
        packed = np.zeros((len(on), 8), np.uint8)
        packed[:, : -(-len(sh) // 8)] = np.packbits(on, axis=1, bitorder="little")
        out[at : at + (1 << 14)] = packed.view("<u8").ravel()
    out[thr == 0] = 0
    return out


def or_at(n: int, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each of n places, the union of the bits that are sent there."""
    out = np.zeros(n, np.uint64)
    if len(at):
        order = np.argsort(at, kind="stable")
        at, bits = at[order], bits[order]
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[cut]] = np.bitwise_or.reduceat(bits, cut)
    return out


def reach_bits(csr: Csr, sh: np.ndarray, v: np.ndarray, by_to: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The bits of the samples (up to 64, one start each) that reach each vertex. by_to: the edges' order by ``to``, their own vertices and the cuts."""
    seen = or_at(csr.n, v, np.uint64(1) << np.arange(len(v), dtype=np.uint64))
    live, drawn, new = np.zeros(len(csr.to), np.uint64), np.zeros(len(csr.to), bool), seen.copy()
    while len(at := np.flatnonzero(new)):
        sent, many = np.zeros(csr.n, np.uint64), by_to is not None and 4 * int((csr.indptr[at + 1] - csr.indptr[at]).sum()) > len(csr.to)
        for some in _some_edges(csr, at):
            which, e = _expand(csr, some)
            fresh = e[~drawn[e]]
            live[fresh] = coin_bits(csr.eh[fresh], csr.thr[fresh], sh)
            drawn[fresh] = True
            if not many:
                sent |= or_at(csr.n, csr.to[e], new[some[which]] & live[e])
        if many:  # most edges: in their fixed order, without a sort
            order, own, cut = by_to
            sent[csr.to[order[cut]]] = np.bitwise_or.reduceat(new[own] & live[order], cut)
        new = sent & ~seen
        seen |= new
    return seen


def _some_edges(csr: Csr, v: np.ndarray) -> list[np.ndarray]:
    """The vertices v in runs of about ``EDGES_AT_ONCE`` edges."""
    return np.split(v, np.flatnonzero(np.diff(np.cumsum(csr.indptr[v + 1] - csr.indptr[v]) // EDGES_AT_ONCE)) + 1)


def by_to(csr: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """None where the graph has no edges, or so many that their order is not worth its memory."""
    if not 0 < len(csr.to) <= CSR_EDGES:
        return None
    order = np.argsort(csr.to, kind="stable")
    to = csr.to[order]
    return order, np.repeat(np.arange(csr.n), np.diff(csr.indptr))[order], np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))


def bit_rows(seen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sample index and vertex of every bit."""
    some = np.flatnonzero(seen)
    for at in range(0, len(some), 1 << 17):
        v = some[at : at + (1 << 17)]
        k, s = np.nonzero(np.unpackbits(seen[v].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        yield s, v[k]


def lt_parents(csr: Csr, total: np.ndarray, v: np.ndarray, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each vertex has a live in-edge in its sample, and its tail. csr by dst; total: running sum of thr, from 0."""
    coin = fold_np(fold_np(np.full(len(v), salted("vertex"), np.uint64), v), sh).astype(np.int64)
    target = total[csr.indptr[v]] + coin
    e = np.searchsorted(total, target, side="right") - 1
    ok = target < total[csr.indptr[v + 1]]
    return ok, csr.to[np.where(ok, e, 0)] if len(csr.to) else np.zeros(len(v), np.int32)


def reach_lt_back(csr: Csr, sh: np.ndarray, at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The walk along live in-edges from one start each, until none is live or a vertex comes again."""
    total = csr.running()
    return _walk_back(csr, sh, at, v, lambda u, h: lt_parents(csr, total, u, h))


def _walk_back(csr: Csr, sh: np.ndarray, at: np.ndarray, v: np.ndarray, parents: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seen = np.zeros(len(sh) * csr.n, bool)
    s, u, found, hops, hop = at.astype(np.int64), v.astype(np.int64), [], [], 0
    while len(s):
        seen[s * csr.n + u] = True
        found.append(s * csr.n + u)
        hops.append(np.full(len(s), hop, np.int32))
        ok, parent = parents(u, sh[s])
        s, u, hop = s[ok], parent[ok].astype(np.int64), hop + 1
        new = ~seen[s * csr.n + u]
        s, u = s[new], u[new]
    key = np.concatenate(found) if found else np.zeros(0, np.int64)
    return key // csr.n, key % csr.n, np.concatenate(hops) if hops else np.zeros(0, np.int32)


def race_parents(csr: Csr, rest: np.ndarray, v: np.ndarray, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by races: each in-edge, and "none" with the ``rest`` of the weights, runs an exponential time; the first wins."""
    which, e = _expand(csr, v)
    none = _race(fold_np(fold_np(np.full(len(v), salted("vertex"), np.uint64), v), sh), rest[v])
    ok, parent = np.zeros(len(v), bool), np.zeros(len(v), np.int32)
    if len(e):
        x = _race(fold_np(csr.eh[e], sh[which]), csr.thr[e])
        cut = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        best = np.minimum.reduceat(x, cut)
        first = np.flatnonzero(x == np.repeat(best, np.diff(np.append(cut, len(x)))))
        first = first[np.unique(which[first], return_index=True)[1]]
        ok[which[first]], parent[which[first]] = best < none[which[first]], csr.to[e[first]]
    return ok, parent


def _race(coin: np.ndarray, weight: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return -np.log((coin.astype(np.float64) + 0.5) / ONE) / weight.astype(np.float64)


def rests(csr: Csr) -> np.ndarray:
    """2^32 less the weights of each vertex's edges, at least 0."""
    total = csr.running()
    return np.maximum(ONE - (total[csr.indptr[1:]] - total[csr.indptr[:-1]]), 0)


def reach_race_back(csr: Csr, sh: np.ndarray, at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rest = rests(csr)
    return _walk_back(csr, sh, at, v, lambda u, h: race_parents(csr, rest, u, h))


def spread_lt(csr: Csr, sh: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Activated vertices and rounds of every sample under linear thresholds; rounds counts the last, empty one."""
    n, b = csr.n, len(sh)
    active, weight = np.zeros(b * n, bool), np.zeros(b * n, np.int64)
    key = np.unique(np.repeat(np.arange(b), len(seeds)) * n + np.tile(seeds, b))
    active[key] = True
    rounds, running = np.zeros(b, np.int64), np.ones(b, bool)
    while running.any():
        rounds[running] += 1
        which, e = _expand(csr, key % n)
        hit = (key // n)[which] * n + csr.to[e]
        np.add.at(weight, hit, csr.thr[e].astype(np.int64))
        near = np.unique(hit)
        near = near[~active[near]]
        coin = fold_np(fold_np(np.full(len(near), salted("vertex"), np.uint64), near % n), sh[near // n]).astype(np.int64)
        key = near[weight[near] >= coin]
        active[key] = True
        running = np.zeros(b, bool)
        running[key // n] = True
    return active.reshape(b, n).sum(axis=1), rounds


def live_out(csr: Csr, heads: Csr, total: np.ndarray, sh: int, model: str) -> tuple[np.ndarray, np.ndarray]:
    """Tails and heads of the live edges of one world, ordered by head. csr by src, heads by dst; total: running sum of heads' thr, from 0."""
    if model != "IC":
        rest, tails, own = rests(heads) if model != "LT" else None, [], []
        for v in _some_edges(heads, np.arange(csr.n)):
            each = np.full(len(v), sh, np.uint64)
            ok, parent = lt_parents(heads, total, v, each) if model == "LT" else race_parents(heads, rest, v, each)
            tails.append(parent[ok].astype(np.int64))
            own.append(v[ok])
        return np.concatenate(tails), np.concatenate(own)
    on = []
    for at in range(0, len(heads.to), EDGES_AT_ONCE):
        eh, thr = (x[at : at + EDGES_AT_ONCE] for x in (heads.eh, heads.thr))
        on.append(at + np.flatnonzero((fold_u32(eh, np.uint32(sh)) <= (np.maximum(thr, 1) - 1).astype(np.uint32)) & (thr > 0)))
    on = np.concatenate(on) if on else np.zeros(0, np.int64)
    return heads.to[on].astype(np.int64), np.searchsorted(heads.indptr, on, side="right") - 1


def sweep(n: int, tail: np.ndarray, head: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Up to 64 starts at once: for each vertex, the bits of the starts that reach it along the edges, which are ordered by head."""
    mask = np.zeros(n, np.uint64)
    np.bitwise_or.at(mask, starts, np.uint64(1) << np.arange(len(starts), dtype=np.uint64))
    if not len(head):
        return mask
    cut = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    at = head[cut]
    while True:
        new = mask[at] | np.bitwise_or.reduceat(mask[tail], cut)
        if (new == mask[at]).all():
            return mask
        mask[at] = new


def by_tail(n: int, tail: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Live edges as places of each tail, and heads."""
    return np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=n))]), head[np.argsort(tail, kind="stable")]


def beyond(at_tail: np.ndarray, head: np.ndarray, starts: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each distinct start, how many vertices it reaches that are not known; what known ones reach is known.

    Starts are bits of several words a vertex; a hop goes over what is new alone, so the work grows with what is reached.
    """
    mask = np.zeros((len(known), -(-len(starts) // 64)), np.uint64)
    at, new = starts, np.zeros((len(starts), mask.shape[1]), np.uint64)
    i = np.arange(len(starts))
    new[i, i // 64] = np.uint64(1) << (i % 64).astype(np.uint64)
    at, new = at[~known[at]], new[~known[at]]
    while len(at):
        mask[at] |= new
        n = at_tail[at + 1] - at_tail[at]
        to = head[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at_tail[at], n)]
        which = np.repeat(np.arange(len(at)), n)[~known[to]]
        to = to[~known[to]]
        if not len(to):
            break
        order = np.argsort(to, kind="stable")
        to = to[order]
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        at = to[cut]
        new = np.bitwise_or.reduceat(new[which[order]], cut, axis=0) & ~mask[at]
        some = new.any(axis=1)
        at, new = at[some], new[some]
    total, reached = np.zeros(mask.shape[1] * 64, np.int64), np.flatnonzero(mask.any(axis=1))
    for a in range(0, len(reached), 1 << 14):
        total += np.unpackbits(mask[reached[a : a + (1 << 14)]].astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total[: len(starts)]


def batches_of(rows: int, n: int) -> Iterator[slice]:
    step = max(CELLS // max(n, 1), 1)
    return (slice(a, a + step) for a in range(0, rows, step))


# -- DataFrames


def _tasks(df: DataFrame, rows: int) -> DataFrame:
    return df.repartition(max(min(rows // 256, 4 * df.sparkSession.sparkContext.defaultParallelism), 1)) if rows else df


def rrr_sets(graph: Graph, stop: int, model: str = "IC", stream: str = "sample", seed: int = 0, start: int = 0, strategy: str = "auto") -> DataFrame:
    """sid, v: the reverse-reachable sets ``start`` to ``stop - 1``, each of a random root."""
    check_model(model)
    spark = graph.edges.sparkSession
    if graph.n == 0:
        return spark.createDataFrame([], "sid long, v long")
    if strategy == "auto":
        strategy = "local" if graph.fits_csr() else "blocks" if model == "IC" else "frontier"
        if strategy == "local" and model == "IC" and graph.live_degree() > BITS_DEGREE:
            strategy = "bits"
    rooted = samples(spark, start, stop, stream, seed).withColumn("v", root_of(F.col("sh"), graph.n))
    if strategy == "blocks":
        if model != "IC":
            raise ValueError(f"no strategy {strategy} for {model}")
        return _worded(graph, rooted) if graph.mappable() else sets_by_blocks(graph.blocks("dst"), rooted.select("sid", "v"), stream, seed)
    return sets_of_roots(graph, _tasks(rooted, stop - start) if strategy in ("local", "bits") else rooted, model, strategy)


def sets_of_roots(graph: Graph, rooted: DataFrame, model: str, strategy: str) -> DataFrame:
    """sid, v: the reverse-reachable set of every row of ``rooted`` (sid, sh, v)."""
    if strategy not in ("local", "bits", "frontier") or (strategy == "bits" and model != "IC"):
        raise ValueError(f"no strategy {strategy} for {model}")
    if strategy == "frontier":
        return reach(graph, rooted, model).select("sid", "v")
    ship(graph.edges.sparkSession)
    csr = graph.sent_csr("dst")
    if strategy == "bits":

        def run_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order = by_to(csr.value)
            for b in batches:
                sid, sh, v = (b.column(k).to_numpy() for k in range(3))
                for at in range(0, len(sid), 64):
                    for s, u in bit_rows(reach_bits(csr.value, sh[at : at + 64], v[at : at + 64], order)):
                        yield pa.RecordBatch.from_arrays([pa.array(sid[at : at + 64][s]), pa.array(u.astype(np.int64))], names=["sid", "v"])

        return rooted.select("sid", "sh", "v").mapInArrow(run_bits, "sid long, v long")
    walk = {"IC": reach_ic, "LT": reach_lt_back, "LTR": reach_race_back}[model]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, sh, v = (b.column(k).to_numpy() for k in range(3))
            for part in batches_of(len(sid), csr.value.n):
                s, u, _ = walk(csr.value, sh[part], np.arange(len(sh[part])), v[part])
                yield pa.RecordBatch.from_arrays([pa.array(sid[part][s]), pa.array(u.astype(np.int64))], names=["sid", "v"])

    return rooted.select("sid", "sh", "v").mapInArrow(run, "sid long, v long")


def reach(graph: Graph, starts: DataFrame, model: str = "IC", forward: bool = False, seen: DataFrame | None = None) -> DataFrame:
    """sid, v, hop: all that the starts (sid, sh, v) reach against the edges (or along them), but for ``seen`` (sid, v).

    Where the adjacency can be mapped, the starts are dealt out by sample and a task goes all hops of its samples, in
    one job: what is read grows with what is reached, not with hops times the graph.
    Else by frontier joins: the edges are bucketed by the vertex they are looked up by, once; a hop shuffles its
    frontier, not the graph. Each hop is stored once, as it is found.
    """
    if model == "LTR" and forward:
        raise ValueError("races go backwards only")
    return _walked(graph, starts, model, forward, seen) if graph.mappable() else _joined(graph, starts, model, forward, seen)


def _walked(graph: Graph, starts: DataFrame, model: str, forward: bool, seen: DataFrame | None) -> DataFrame:
    csr = graph.sent_csr("src" if forward else "dst")
    heads = graph.sent_csr("dst") if forward and model == "LT" else None
    asked = starts.select("sid", "sh", "v", F.lit(False).alias("known"))
    if seen is not None:
        asked = asked.union(seen.select("sid", F.lit(0).cast("long"), "v", F.lit(True)))
    # a sample's starts come last, so its last row has its hash
    asked = asked.repartition("sid").sortWithinPartitions("sid", F.desc("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, n = stepper(csr.value, heads and heads.value, model), csr.value.n
        for t in whole_samples(batches, max(CELLS // n, 1)):
            sid, sh, v, known = (t.column(c).to_numpy() for c in ("sid", "sh", "v", "known"))
            cut = np.flatnonzero(sid[1:] != sid[:-1])
            last = np.append(cut, len(sid) - 1)
            at, mark = np.repeat(np.arange(len(last)), np.diff(last, prepend=-1)), np.zeros(len(last) * n, bool)
            mark[at[known] * n + v[known]] = True
            s, u, hop = reach_along(n, sh[last], at[~known], v[~known], mark, step)
            own = sid[last]
            for a in range(0, len(s), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(own[s[a : a + OUT_ROWS]]), pa.array(u[a : a + OUT_ROWS].astype(np.int64)), pa.array(hop[a : a + OUT_ROWS])], names=["sid", "v", "hop"])

    return asked.mapInArrow(run, "sid long, v long, hop int")


def _worded(graph: Graph, rooted: DataFrame) -> DataFrame:
    """sid, v: the sets of the rows of ``rooted`` (sid, sh, v), 64 samples of a task in a word."""
    csr = graph.sent_csr("dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_samples(batches, 64):
            sid, sh, v = (t.column(c).to_numpy() for c in ("sid", "sh", "v"))
            own, first, at = np.unique(sid, return_index=True, return_inverse=True)
            seen, word = reach_words(csr.value, sh[first], at, v)
            for a in range(0, len(seen), OUT_ROWS):
                for s, k in bit_rows(word[a : a + OUT_ROWS]):
                    yield pa.RecordBatch.from_arrays([pa.array(own[s]), pa.array(seen[a + k])], names=["sid", "v"])

    return rooted.select("sid", "sh", "v").repartition("sid").sortWithinPartitions("sid").mapInArrow(run, "sid long, v long")


def whole_samples(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of up to ``most`` samples at a time, from batches that are ordered by ``sid``."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if b.column("sid")[0] == b.column("sid")[-1] == held[0].column("sid")[0]:
            continue  # one sample's rows go on
        t = pa.Table.from_batches(held)
        sid = t.column("sid").to_numpy()
        cut = np.flatnonzero(sid[1:] != sid[:-1]) + 1
        ends = np.append(cut[most - 1 :: most], cut[-1]) if len(cut) else cut
        at = 0
        for end in np.unique(ends):
            yield t.slice(at, end - at)
            at = int(end)
        held = t.slice(at).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _joined(graph: Graph, starts: DataFrame, model: str, forward: bool, seen: DataFrame | None) -> DataFrame:
    tail, head = ("src", "dst") if forward else ("dst", "src")
    edges = {"IC": lambda e: e, "LT": lt_intervals, "LTR": with_rest}[model](graph.edges)
    edges, table = bucketed(edges.select(F.col(tail).alias("v"), F.col(head).alias("_to"), "thr", "eh", *{"IC": [], "LT": ["lo", "hi"], "LTR": ["rest"]}[model]), "v")
    try:
        return _hops(edges, starts, model, forward, seen)
    finally:
        edges.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")


def _hops(edges: DataFrame, starts: DataFrame, model: str, forward: bool, seen: DataFrame | None) -> DataFrame:
    first = starts.select("sid", "sh", "v", F.lit(0).alias("hop")).distinct()
    frontier = checkpoint(first.join(seen.select("sid", "v"), ["sid", "v"], "left_anti").select("sid", "sh", "v", "hop") if seen is not None else first)
    visited, hop = frontier.select("sid", "v", "hop"), 0
    while frontier.limit(1).count():
        hop += 1
        known = visited.select("sid", "v") if seen is None else visited.select("sid", "v").union(seen.select("sid", "v"))
        joined = frontier.select("sid", "sh", "v").join(edges, "v")
        if model == "IC":
            joined = joined.filter(live(edges, F.col("sh")))
        elif model == "LTR":
            joined = race_winners(joined)
        else:
            coin = vertex_coin(F.col("_to" if forward else "v"), F.col("sh"))  # the coin of the edge's head
            joined = joined.filter((F.col("lo") <= coin) & (coin < F.col("hi")))
        new = joined.select("sid", "sh", F.col("_to").alias("v")).distinct().join(known, ["sid", "v"], "left_anti")
        frontier = stored(new.select("sid", "sh", "v", F.lit(hop).alias("hop")), "frontier")
        visited = visited.union(frontier.select("sid", "v", "hop"))
    return visited


def simulate(graph: Graph, seeds: list[int], replicas: int, model: str = "IC", seed: int = 0, strategy: str = "auto") -> DataFrame:
    """replica, activated, rounds of forward diffusion from dense seeds."""
    if check_model(model) == "LTR":
        model = "LT"  # races draw live parents; forward rounds need none
    spark = graph.edges.sparkSession
    reps = samples(spark, 0, replicas, "simulation", seed)
    local = graph.fits_csr() if strategy == "auto" else strategy == "local"
    if not local:
        return _simulate_frontier(graph, reps, seeds, model)
    ship(spark)
    csr, start = graph.sent_csr("src"), np.unique(np.array(seeds, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, sh = b.column(0).to_numpy(), b.column(1).to_numpy()
            for part in batches_of(len(sid), csr.value.n):
                m = len(sh[part])
                if model == "IC":
                    s, _, hop = reach_ic(csr.value, sh[part], np.repeat(np.arange(m), len(start)), np.tile(start, m))
                    activated, rounds = np.bincount(s, minlength=m), np.zeros(m, np.int64)
                    np.maximum.at(rounds, s, hop + 1)
                else:
                    activated, rounds = spread_lt(csr.value, sh[part], start)
                yield pa.RecordBatch.from_arrays([pa.array(sid[part]), pa.array(activated.astype(np.int64)), pa.array(rounds)], names=["replica", "activated", "rounds"])

    return _tasks(reps, replicas).mapInArrow(run, "replica long, activated long, rounds long")


def _simulate_frontier(graph: Graph, reps: DataFrame, seeds: list[int], model: str) -> DataFrame:
    starts = reps.withColumn("v", F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds]) if seeds else F.expr("CAST(array() AS array<bigint>)")))
    if model == "IC":
        got = reach(graph, starts, "IC", forward=True).groupBy("sid").agg(F.count("*").alias("a"), (F.max("hop") + 1).alias("r"))
        rounds = F.coalesce("r", F.lit(0))
    else:
        active = checkpoint(starts.select("sid", "sh", "v").distinct())
        new, got_rounds, step = active, [], 0
        edges = graph.edges.select(F.col("src").alias("v"), F.col("dst").alias("_to"), "thr")
        weight = checkpoint(active.sparkSession.createDataFrame([], "sid long, sh long, v long, w long"))
        while new.limit(1).count():
            step += 1
            added = new.join(edges, "v").groupBy("sid", "sh", F.col("_to").alias("v")).agg(F.sum("thr").alias("w"))
            touched = added.select("sid", "v")
            weight = checkpoint(weight.union(added).groupBy("sid", "sh", "v").agg(F.sum("w").alias("w")).join(active.select("sid", "v"), ["sid", "v"], "left_anti").select("sid", "sh", "v", "w"))
            new = checkpoint(weight.join(touched, ["sid", "v"], "left_semi").filter(F.col("w") >= vertex_coin(F.col("v"), F.col("sh"))).select("sid", "sh", "v"))
            active = checkpoint(active.union(new))
            got_rounds.append(new.select("sid").distinct().withColumn("r", F.lit(step + 1)))
        last = got_rounds[0] if got_rounds else None
        for g in got_rounds[1:]:
            last = last.union(g)
        got = active.groupBy("sid").agg(F.count("*").alias("a"))
        got = got.join(last.groupBy("sid").agg(F.max("r").alias("r")), "sid", "left") if last is not None else got.withColumn("r", F.lit(1))
        rounds = F.coalesce("r", F.lit(1))
    return reps.select("sid").join(got, "sid", "left").select(F.col("sid").alias("replica"), F.coalesce("a", F.lit(0)).cast("long").alias("activated"), rounds.cast("long").alias("rounds"))


def live_edges(graph: Graph, count: int, seed: int = 0, start: int = 0) -> DataFrame:
    """sid and the edge (src, dst, k) of every live edge of the worlds ``start`` to ``count - 1``: each edge draws its own coin in every world."""
    worlds = F.explode(F.transform(F.sequence(F.lit(start), F.lit(count - 1)), lambda i: F.struct(i.cast("long").alias("sid"), fold(F.lit(salted("sample", seed)), i).alias("sh"))))
    return graph.edges.withColumn("_w", worlds).filter(live(graph.edges, F.col("_w.sh"))).select(F.col("_w.sid").alias("sid"), "src", "dst", "k")


def live_parents(graph: Graph, count: int, seed: int = 0, start: int = 0, race: bool = False) -> DataFrame:
    """sid, v, parent: the one live in-edge of each vertex in the linear-threshold worlds ``start`` to ``count - 1``, where it has one."""
    worlds = F.explode(F.transform(F.sequence(F.lit(start), F.lit(count - 1)), lambda i: F.struct(i.cast("long").alias("sid"), fold(F.lit(salted("sample", seed)), i).alias("sh"))))
    if race:
        asked = with_rest(graph.edges).withColumn("_w", worlds).select(F.col("_w.sid").alias("sid"), F.col("_w.sh").alias("sh"), F.col("dst").alias("v"), F.col("src").alias("_to"), "thr", "eh", "rest")
        return race_winners(asked).select("sid", "v", F.col("_to").alias("parent"))
    heads = graph.edges.select("dst").distinct().withColumn("_w", worlds).select("dst", F.col("_w.sid").alias("sid"), F.col("_w.sh").alias("sh"))
    heads = heads.withColumn("coin", vertex_coin(F.col("dst"), F.col("sh")))
    picked = heads.join(lt_intervals(graph.edges), "dst").filter("lo <= coin AND coin < hi")
    return picked.select("sid", F.col("dst").alias("v"), F.col("src").alias("parent"))
