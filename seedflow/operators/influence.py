"""Influence maximisation: IMM, OPIM-C, TIM+, community IMM and hill climbing over the sampling operators."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bounds
from ..functions.rng import ONE, fold, fold_u32, salted
from ..functions.session import checkpoint, stored
from ..shipping import ship
from .coverage import Greedy, greedy_grouped, max_coverage, seed_coverage, small_parts
from .graph import Graph
from .sampling import beyond, by_tail, check_model, live_edges, live_out, live_parents, reach, rrr_sets, samples, sets_of_roots, sweep

#: OPIM-C and TIM+ draw no more sets than this, unless told; where one would need more, its result says ``guaranteed`` False. None, as in IMM: no limit.
MAX_SETS = 2_000_000
#: Candidates that a round of hill climbing evaluates at a time.
LAZY = 64
#: Rounds of that many before each evaluates four times as many as the one before it.
SAME = 4
#: Candidates of a piece that a task evaluates in a world, and of them, in a pass.
PIECE, AT_ONCE = 2048, 512
#: Ranks of a reachability sketch, standard errors that an upper bound lies above its estimate, and cells (worlds x vertices x ranks) at a time.
RANKS, ERRORS, RANK_CELLS = 16, 8.0, 1 << 23
#: Worlds that are sketched together by joins.
WORLDS_AT_ONCE = 64


@dataclass
class Result:
    seeds: list[int]  # dense ids
    sets: int
    fraction: float
    spread: float
    #: whether as many sets were drawn as the approximation guarantee needs
    guaranteed: bool = True
    details: dict = field(default_factory=dict)


class Sets:
    """A growing store of reverse-reachable sets; sets once drawn are kept, and set i is the same whenever it is drawn."""

    def __init__(self, graph: Graph, model: str, stream: str = "sample", seed: int = 0, stored: DataFrame | None = None, drawn: int = 0):
        self.graph, self.model, self.stream, self.seed = graph, model, stream, seed
        self.rows, self.drawn = stored, drawn
        #: milliseconds by phase
        self.times = {"GenerateRRRSets": [], "FindMostInfluentialSet": [], "Counting": [], "Pivoting": []}
        #: one entry for each time that sets were drawn
        self.iterations = []

    def grow(self, theta: int) -> Sets:
        if theta > self.drawn:
            began = time.perf_counter()
            new = checkpoint(rrr_sets(self.graph, theta, self.model, self.stream, self.seed, start=self.drawn))
            self.rows = new if self.rows is None else self.rows.union(new)
            before, self.drawn = self.drawn, theta
            self.times["GenerateRRRSets"].append((time.perf_counter() - began) * 1000)
            self.iterations.append({"NumSets": theta - before, "Total": self.times["GenerateRRRSets"][-1]})
        return self

    def draw(self, theta: int) -> DataFrame:
        """The sets that ``grow`` would add, drawn but not added."""
        return checkpoint(rrr_sets(self.graph, theta, self.model, self.stream, self.seed, start=self.drawn))

    def add(self, theta: int, rows: DataFrame) -> None:
        self.rows = rows if self.rows is None else self.rows.union(rows)
        self.drawn = theta

    def first(self, theta: int) -> DataFrame:
        return self.rows if theta >= self.drawn else self.rows.filter(F.col("sid") < theta)

    def greedy(self, k: int, theta: int | None = None) -> Greedy:
        theta = self.drawn if theta is None else min(theta, self.drawn)
        began = time.perf_counter()
        got = max_coverage(self.first(theta), k, theta)
        self.times["FindMostInfluentialSet"].append((time.perf_counter() - began) * 1000)
        self.times["Counting"].append(got.counting)
        self.times["Pivoting"].append(got.pivoting)
        return got

    def phases(self) -> dict:
        """Times, and the bytes of the sets at four a member."""
        return {**self.times, "Iterations": self.iterations, "RRRSetSizeBytes": 4 * self.rows.count() if self.rows is not None else 0}


def _most(theta: int, max_sets: int | None) -> int:
    return theta if max_sets is None else min(theta, max_sets)


def _check(graph: Graph, k: int, model: str) -> int:
    check_model(model)
    if k < 1:
        raise ValueError("k must be at least 1")
    if graph.n < 3:
        raise ValueError("a graph of at least 3 vertices is needed")
    return min(k, graph.n)


def imm_sampling(sets: Sets, k: int, eps: float, l: float, max_sets: int | None) -> tuple[int, float, list[int], bool]:
    """Theta, the lower bound, the sizes that were tried, and whether the guarantee holds. Sets that are there already skip the guesses that they suffice for."""
    n, e, tried, bound = sets.graph.n, math.sqrt(2) * eps, [], 0.0
    last = max(int(math.log2(n)), 2) - 1
    x = min(max(int(bounds.imm_inverse_theta_prime(sets.drawn, e, l, k, n)), 1), last) if sets.drawn else 1
    while x <= last:
        need = bounds.imm_theta_prime(x, e, l, k, n)
        theta = _most(need, max_sets)
        tried.append(theta)
        f = sets.grow(theta).greedy(k, theta).fraction
        if f >= 2.0**-x:
            bound = n * f / (1 + e)
            break
        if theta < need:
            break
        x += 1
    need = bounds.imm_theta(eps, l, k, bound, n)
    theta = _most(need, max_sets) or sets.drawn
    sets.grow(theta)
    return theta, bound, tried, bool(need) and theta >= need and tried[-1] == bounds.imm_theta_prime(x, e, l, k, n)


def imm(graph: Graph, k: int = 10, eps: float = 0.5, model: str = "IC", seed: int = 0, max_sets: int | None = None, sets: Sets | None = None) -> Result:
    """As many sets as the guarantee needs; no more than ``max_sets`` where a caller gives it, and then ``guaranteed`` says whether they were enough."""
    k = _check(graph, k, model)
    l = 1 + 1 / math.log2(graph.n)
    sets = sets or Sets(graph, model, seed=seed)
    began = time.perf_counter()
    theta, bound, tried, sure = imm_sampling(sets, k, eps, l, max_sets)
    estimation = {"ThetaEstimation": (time.perf_counter() - began) * 1000, "ThetaEstimationGenerateRRR": list(sets.times["GenerateRRRSets"]), "ThetaEstimationMostInfluential": list(sets.times["FindMostInfluentialSet"])}
    got = sets.greedy(k, theta)
    return Result(got.seeds, theta, got.fraction, got.fraction * graph.n, sure, {"lower_bound": bound, "theta_primes": tried, **estimation, **sets.phases()})


class Ahead:
    """Sets of the next round, drawn by a thread with a job group of its own while this round is judged."""

    def __init__(self, sets: list[Sets], theta: int):
        self.sets, self.theta, self.found = sets, theta, []
        self.group, self.sc = f"seedflow-ahead-{uuid.uuid4().hex}", sets[0].graph.edges.sparkSession.sparkContext
        self.thread = InheritableThread(target=self._run)
        self.thread.start()

    def _run(self) -> None:
        self.sc.setJobGroup(self.group, "sets of the next round", interruptOnCancel=True)
        try:
            self.found = [s.draw(self.theta) for s in self.sets]
        except Exception as stopped:  # noqa: BLE001  raised again by take, unless cancelled
            self.found = stopped

    def take(self) -> None:
        self.thread.join()
        if isinstance(self.found, Exception):
            raise self.found
        for s, rows in zip(self.sets, self.found, strict=True):
            s.add(self.theta, rows)

    def cancel(self) -> None:
        while self.thread.is_alive():  # jobs that it begins after a call are cancelled by the next
            self.sc.cancelJobGroup(self.group)
            self.thread.join(0.2)


def opimc(graph: Graph, k: int = 10, eps: float = 0.5, delta: float = 0.05, model: str = "IC", seed: int = 0, max_sets: int | None = MAX_SETS, ahead_bytes: int = 0) -> Result:
    """``ahead_bytes``: the next round's sets are drawn while a round is judged, if they are expected to take no more than this (16 bytes a member)."""
    k = _check(graph, k, model)
    n = graph.n
    first, most = bounds.opim_limits(eps, delta, k, n)
    rounds = max(math.ceil(math.log2(most / first)), 1) if most > first else 1
    d = delta / (3 * rounds)
    r1, r2, theta, alpha = Sets(graph, model, "r1", seed), Sets(graph, model, "r2", seed), _most(first, max_sets), 0.0
    ahead, used = None, {"taken": 0, "cancelled": 0, "refused": 0}
    for turn in range(1, rounds + 1):
        if ahead:
            ahead.take()
            used["taken"] += 1
            ahead = None
        r1.grow(theta)
        r2.grow(theta)
        if ahead_bytes and turn < rounds and (larger := _most(2 * theta, max_sets)) > theta:
            if 16 * r1.rows.count() / theta * 2 * (larger - theta) <= ahead_bytes:
                ahead = Ahead([r1, r2], larger)
            else:
                used["refused"] += 1
        got = r1.greedy(k)
        covered = seed_coverage(r2.rows, got.seeds)
        upper = bounds.opim_upper(n, theta, got.fraction * theta, d)
        alpha = bounds.opim_lower(n, theta, covered, d) / upper if upper else 0.0
        if alpha >= bounds.APPROX - eps or (max_sets is not None and theta >= max_sets):
            break
        if turn < rounds:
            theta = _most(2 * theta, max_sets)
    if ahead:
        ahead.cancel()
        used["cancelled"] += 1
    sure = alpha >= bounds.APPROX - eps or theta >= most
    return Result(got.seeds, theta, got.fraction, covered / theta * n, sure, {"alpha": alpha, "rounds": turn, "theta_zero": first, "theta_max": most, "ahead": used, **r1.phases()})


def widths(graph: Graph, rrr: DataFrame) -> DataFrame:
    """sid, width: the number of edges that point into each set."""
    return rrr.join(graph.degree("dst").select(F.col("vid").alias("v"), "degree"), "v").groupBy("sid").agg(F.sum("degree").alias("width"))


def kpt_mean(graph: Graph, rrr: DataFrame, k: int) -> float:
    """Mean over sets of 1 - (1 - width / m)^k."""
    share = 1 - F.pow(1 - F.col("width") / max(graph.m, 1), k)
    return widths(graph, rrr).agg(F.avg(share)).first()[0] or 0.0


def tim(graph: Graph, k: int = 10, eps: float = 0.5, model: str = "IC", seed: int = 0, max_sets: int | None = MAX_SETS) -> Result:
    k = _check(graph, k, model)
    n, kpt, sure = graph.n, 1.0, True
    sets = Sets(graph, model, "r1", seed)
    for i in range(1, max(int(math.log2(n)), 2)):
        need = bounds.tim_kpt_samples(i, n)
        c = _most(need, max_sets)
        mean = kpt_mean(graph, sets.grow(c).first(c), k)
        if mean > 2.0**-i or c < need:
            kpt, sure = max(n * mean / 2, 1.0), c >= need
            break
    e, need = bounds.tim_refine(eps, k, n, kpt)
    refine = _most(need, max_sets)
    guess = sets.greedy(k)
    fresh = Sets(graph, model, "r2", seed).grow(refine)
    kpt_plus = max(kpt, seed_coverage(fresh.rows, guess.seeds) / refine * n / (1 + e))
    sure = sure and refine >= need
    need = bounds.tim_theta(eps, k, n, kpt_plus)
    theta = _most(need, max_sets)
    final = Sets(graph, model, "sample", seed).grow(theta)
    got = final.greedy(k)
    return Result(got.seeds, theta, got.fraction, got.fraction * n, sure and theta >= need, {"kpt": kpt, "kpt_refined": kpt_plus, **final.phases()})


def community_imm(graph: Graph, labels: DataFrame, k: int = 10, eps: float = 0.5, model: str = "IC", seed: int = 0, max_sets: int | None = 200_000, strategy: str = "auto") -> DataFrame:
    """vid, community, gain, guaranteed: the k best of the communities' own greedy seeds, by gain (expected vertices in their community).

    All communities go through the guesses of IMM together: set i of a community is drawn from its own
    root in one graph that holds the edges inside communities, and greedy rounds pick a seed of each, so
    the number of jobs depends on the largest community's logarithm alone. A community of fewer than 3
    vertices has no estimate and gives none.
    """
    check_model(model)
    inside = checkpoint(graph.communities(labels))
    spark = inside.sparkSession
    whole = Graph(graph.vertices, inside.select(F.col("gsrc").alias("src"), F.col("gdst").alias("dst"), "k", "weight", "thr", "eh"))
    strategy = ("local" if whole.fits_csr() else "frontier") if strategy == "auto" else strategy
    names = inside.select("community", F.col("gsrc").alias("v"), F.col("src").alias("local")).union(inside.select("community", "gdst", "dst")).distinct()
    names = checkpoint(names)
    sizes = names.groupBy("community").agg(F.count("*").alias("n")).filter("n >= 3")
    # one row a community: its number, size, and how many sets it has and needs
    state = {r["community"]: {"n": r["n"], "drawn": 0, "bound": 0.0, "sure": True, "open": True} for r in sizes.toLocalIterator()}
    if not state:
        return spark.createDataFrame([], "vid long, community long, gain double, guaranteed boolean")
    e, rows = math.sqrt(2) * eps, None
    small = lambda s: (min(k, s["n"]), 1 + 1 / math.log2(s["n"]))

    def grow(need: dict) -> None:
        """Draw the sets that the communities still need."""
        nonlocal rows
        more = [(c, state[c]["n"], state[c]["drawn"], t, i) for i, (c, t) in enumerate((c, t) for c, t in need.items() if t > state[c]["drawn"])]
        if not more:
            return
        ranges = spark.createDataFrame(pd.DataFrame(more, columns=["community", "n", "start", "stop", "c"]), "community long, n long, start long, stop long, c long")
        pieces = ranges.withColumn("p", F.explode(F.sequence(F.floor(F.col("start") / 4096), F.floor((F.col("stop") - 1) / 4096)))).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
        drawn = pieces.withColumn("i", F.explode(F.sequence(F.greatest("start", F.col("p") * 4096), F.least("stop", (F.col("p") + 1) * 4096) - 1)))
        drawn = drawn.withColumn("sh", fold(F.lit(salted("sample", seed)), F.col("i"))).withColumn("local", (fold(F.lit(salted("root")), F.col("sh")) % F.col("n")).cast("long"))
        rooted = checkpoint(drawn.join(names, ["community", "local"]).select("community", "i", "sh", "v"))
        # a set's number among all communities': its root's community tells them apart
        ids = small_parts(ranges.select("community", "c"), len(more))
        keyed = checkpoint(rooted.join(ids, "community").withColumn("sid", F.col("i") * len(more) + F.col("c")))
        found = sets_of_roots(whole, keyed.select("sid", "sh", "v"), model, strategy)
        new = checkpoint(found.withColumn("c", F.col("sid") % len(more)).join(ids, "c").select(F.col("community").alias("part"), F.floor(F.col("sid") / len(more)).alias("sid"), "v"))
        rows = new if rows is None else rows.union(new)
        for c, t in need.items():
            state[c]["drawn"] = max(state[c]["drawn"], t)

    def greedy(thetas: dict, scale: DataFrame | None = None, best_of: int | None = None) -> DataFrame:
        """part, rank, v, gain over the first theta sets of each community."""
        use = spark.createDataFrame(pd.DataFrame([(c, t, small(state[c])[0]) for c, t in thetas.items()], columns=["part", "theta", "k"]), "part long, theta long, k int")
        return greedy_grouped(rows.join(small_parts(use, len(thetas)), "part").filter("sid < theta").select("part", "sid", "v"), use.select("part", "k"), max(small(state[c])[0] for c in thetas), scale, best_of)

    x = 1
    while left := {c: s for c, s in state.items() if s["open"] and x < max(int(math.log2(s["n"])), 2)}:
        need = {c: bounds.imm_theta_prime(x, e, small(s)[1], small(s)[0], s["n"]) for c, s in left.items()}
        theta = {c: _most(t, max_sets) for c, t in need.items()}
        grow(theta)
        covered = dict(map(tuple, greedy(theta).groupBy("part").agg(F.sum("gain")).collect()))
        for c in left:
            f = covered.get(c, 0) / theta[c]
            if f >= 2.0**-x:
                state[c] |= {"bound": state[c]["n"] * f / (1 + e), "open": False}
            elif theta[c] < need[c]:
                state[c] |= {"sure": False, "open": False}
        x += 1
    need = {c: bounds.imm_theta(eps, small(s)[1], small(s)[0], s["bound"], s["n"]) for c, s in state.items()}
    theta = {c: _most(t, max_sets) or state[c]["drawn"] for c, t in need.items()}
    grow(theta)
    scale = [(c, t, s["n"], bool(s["sure"] and 0 < need[c] <= t)) for c, t in theta.items() for s in [state[c]]]
    scales = spark.createDataFrame(pd.DataFrame(scale, columns=["part", "theta", "n", "guaranteed"]), "part long, theta long, n long, guaranteed boolean")
    per_set = scales.select("part", (F.col("n") / F.col("theta")).alias("scale"))
    best = greedy(theta, per_set, k).join(small_parts(scales, len(scale)), "part").select(F.col("v").alias("vid"), F.col("part").alias("community"), (F.col("gain") / F.col("theta") * F.col("n")).alias("gain"), "guaranteed")
    return best.orderBy(F.desc("gain"), "vid").limit(k)


def ranks(sh: np.ndarray, n: int, columns: range) -> np.ndarray:
    """Exponential ranks of all (world, vertex) pairs, one column each; a coin of world, vertex and column."""
    h = fold_u32(fold_u32(np.uint32(salted("rank")), np.arange(n, dtype=np.uint32))[None, :], sh.astype(np.uint32)[:, None]).ravel()
    u = fold_u32(h[:, None], np.array(columns, np.uint32))
    return -np.log((u.astype(np.float32) + 1) / np.float32(ONE))


def least_ranks(state: np.ndarray, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """For each vertex, the least ranks of all that it reaches. Minima do not mind cycles: rounds until nothing falls."""
    if not len(tail):
        return state
    order = np.argsort(tail, kind="stable")
    tail, head = tail[order], head[order]
    cut = np.flatnonzero(np.concatenate([[True], tail[1:] != tail[:-1]]))
    at = tail[cut]
    while True:
        new = np.minimum(state[at], np.minimum.reduceat(state[head], cut, axis=0))
        if (new == state[at]).all():
            return state
        state[at] = new


class Spread:
    """Live-edge worlds with what the seeds chosen so far reach in each; that reach is kept, and grows by the next seed alone.

    ``local``: a world's reach is a bitmap in its row, and ``AT_ONCE`` candidates go through a world in one pass of
    bits. Else the reach is a table (sid, v), and candidates go through frontier joins.
    """

    def __init__(self, graph: Graph, count: int, seed: int = 0, strategy: str = "auto", model: str = "IC"):
        check_model(model)
        self.graph, self.count, self.model, self.seed = graph, count, model, seed
        self.local = graph.fits_csr() if strategy == "auto" else strategy == "local"
        worlds = samples(graph.edges.sparkSession, 0, count, "sample", seed)
        self.total, self.seeds = 0, []
        if self.local:
            ship(graph.edges.sparkSession)
            tasks = max(min(count, 4 * graph.edges.sparkSession.sparkContext.defaultParallelism), 1)
            self.worlds = worlds.repartition(tasks).withColumn("seen", F.lit(None).cast("binary"))
            heads = graph.sent_csr("dst")
            self.arrays = graph.sent_csr("src"), heads
        else:
            self.worlds, self.seen = checkpoint(worlds), None

    def _worlds(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """sid, sh, bitmap of what is reached, live tails and heads of every world."""
        csr, heads = (a.value for a in self.arrays)
        total, n = heads.running(), csr.n
        for b in batches:
            for sid, sh, seen in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                known = np.zeros(n, bool) if seen is None else np.unpackbits(np.frombuffer(seen, np.uint8), count=n).astype(bool)
                yield sid, sh, known, *live_out(csr, heads, total, sh, self.model)

    def add(self, seed: int) -> None:
        """One more seed."""
        self.seeds.append(int(seed))
        if not self.local:
            starts = self.worlds.select("sid", "sh", F.lit(int(seed)).cast("long").alias("v"))
            new = checkpoint(reach(self.graph, starts, self.model, True, self.seen).select("sid", "v"))
            self.total += new.count()
            self.seen = new if self.seen is None else self.seen.union(new)
            return
        of_worlds = self._bare()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for sid, sh, seen, tail, head in of_worlds._worlds(batches):
                seen |= sweep(len(seen), tail, head, np.array([seed])) > 0
                yield pa.RecordBatch.from_arrays([pa.array([sid]), pa.array([sh]), pa.array([np.packbits(seen).tobytes()], pa.binary()), pa.array([int(seen.sum())])], names=["sid", "sh", "seen", "n"])

        grown = checkpoint(self.worlds.mapInArrow(run, "sid long, sh long, seen binary, n long"))
        self.total = grown.agg(F.sum("n")).first()[0] or 0
        self.worlds = grown.drop("n")

    def _bare(self) -> Spread:
        """What tasks need of this object, without DataFrames."""
        bare = object.__new__(Spread)
        bare.arrays, bare.model = self.arrays, self.model
        return bare

    def bounds(self) -> DataFrame:
        """v, bound: an upper bound of what each vertex reaches, summed over all worlds, from reachability sketches.

        A vertex's sketch in a world has ``RANKS`` independent least ranks of what it reaches there, which give an
        unbiased estimate of its reach with a known error. Errors of worlds are independent, so their sum's is small;
        the bound lies ``ERRORS`` of it above the estimate, and is too low with probability below 1e-6 even for one world.
        """
        if not self.local:
            found = None
            for at in range(0, self.count, WORLDS_AT_ONCE):
                some = self._sketched(at, min(at + WORLDS_AT_ONCE, self.count))
                found = some if found is None else found.union(some)
        else:
            of_worlds, n = self._bare(), self.graph.n

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total, error = np.zeros(n), np.zeros(n)
                some, step, width = [], max(RANK_CELLS // (n * RANKS), 1), max(min(RANK_CELLS // n, RANKS), 1)

                def take() -> None:
                    sh = np.array([w[1] for w in some], np.uint64)
                    tail, head = (np.concatenate([w[k] + i * n for i, w in enumerate(some)]) for k in (3, 4))
                    sums = sum(least_ranks(ranks(sh, n, range(c, min(c + width, RANKS))), tail, head).sum(axis=1, dtype=np.float64) for c in range(0, RANKS, width))
                    reached = ((RANKS - 1) / sums).reshape(len(some), n)
                    total.__iadd__(reached.sum(axis=0))
                    error.__iadd__((reached**2).sum(axis=0) / (RANKS - 2))
                    some.clear()

                for world in of_worlds._worlds(batches):
                    some.append(world)
                    if len(some) >= step:
                        take()
                if some:
                    take()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total), pa.array(error)], names=["v", "total", "error"])

            found = self.worlds.mapInArrow(run, "v long, total double, error double")
        if found is None:
            return self.graph.vertices.select(F.col("vid").alias("v"), F.lit(0).cast("long").alias("bound"))
        return found.groupBy("v").agg(F.ceil(F.sum("total") + ERRORS * F.sqrt(F.sum("error"))).cast("long").alias("bound"))

    def _sketched(self, start: int, stop: int) -> DataFrame:
        """v, total, error of some worlds, by joins of their live edges with the vertices' least ranks, hop by hop."""
        cols = [f"m{k}" for k in range(RANKS)]
        live = live_edges(self.graph, stop, self.seed, start).select("sid", "src", "dst") if self.model == "IC" else live_parents(self.graph, stop, self.seed, start, self.model == "LTR").select("sid", F.col("parent").alias("src"), F.col("v").alias("dst"))
        live = stored(live.distinct(), "live")
        worlds = F.transform(F.sequence(F.lit(start), F.lit(stop - 1)), lambda i: F.struct(i.cast("long").alias("sid"), fold(F.lit(salted("sample", self.seed)), i).alias("sh")))
        every = self.graph.vertices.select(F.col("vid").alias("v")).withColumn("_w", F.explode(worlds)).withColumn("_h", fold(fold(F.lit(salted("rank")), F.col("v")), F.col("_w.sh")))
        state = stored(every.select(F.col("_w.sid").alias("sid"), "v", *[(-F.log((fold(F.col("_h"), F.lit(k)) + 1) / float(ONE))).alias(c) for k, c in enumerate(cols)]), "ranks")
        while True:
            sent = live.join(state, (live["dst"] == state["v"]) & (live["sid"] == state["sid"])).groupBy(live["sid"], live["src"].alias("v")).agg(*[F.min(c).alias(f"_{c}") for c in cols])
            falls = F.greatest(*[F.coalesce((F.col(f"_{c}") < F.col(c)).cast("int"), F.lit(0)) for c in cols])
            both = stored(state.join(sent, ["sid", "v"], "left").select("sid", "v", *[F.least(c, f"_{c}").alias(c) for c in cols], falls.alias("fell")), "ranks")
            state = both.drop("fell")
            if not both.filter("fell > 0").limit(1).count():
                break
        reached = F.lit(float(RANKS - 1)) / sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
        return state.withColumn("_r", reached).groupBy("v").agg(F.sum("_r").alias("total"), (F.sum(F.col("_r") * F.col("_r")) / (RANKS - 2)).alias("error"))

    def gains(self, candidates: DataFrame) -> DataFrame:
        """v, gain: what each candidate (v) reaches beyond the seeds, summed over all worlds."""
        if not self.local:
            worlds = candidates.select("v").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(self.count - 1)))) if self.count else candidates.select("v", F.lit(0).alias("_s")).limit(0)
            starts = worlds.select((F.col("_s") * self.graph.n + F.col("v")).alias("sid"), fold(F.lit(salted("sample", self.seed)), F.col("_s")).alias("sh"), "v")
            got = reach(self.graph, starts, self.model, True).select((F.col("sid") % self.graph.n).alias("o"), F.floor(F.col("sid") / self.graph.n).alias("sid"), "v")
            got = got.join(self.seen, ["sid", "v"], "left_anti") if self.seen is not None else got
            found = got.groupBy(F.col("o").alias("v")).agg(F.count("*").alias("gain"))
            return candidates.select("v").join(found, "v", "left").select("v", F.coalesce("gain", F.lit(0)).alias("gain"))
        # worlds and pieces of the candidates are dealt out together
        pieces = max(-(-self.graph.n // PIECE), 1)
        of = candidates.select("v").groupBy((F.col("v") % pieces).alias("piece")).agg(F.collect_list("v").alias("asked"))
        asked = self.worlds.select("sid", "sh", "seen").crossJoin(of.select("asked")).repartition(max(min(pieces * self.count, 8 * self.graph.edges.sparkSession.sparkContext.defaultParallelism), 1)).sortWithinPartitions("sid")
        of_worlds = self._bare()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, world = None, None
            for b in batches:
                for i in range(b.num_rows):
                    row = b.slice(i, 1)
                    if row.column("sid")[0].as_py() != of:
                        of, (_, _, seen, tail, head) = row.column("sid")[0].as_py(), next(of_worlds._worlds(iter([row])))
                        world = (*by_tail(len(seen), tail, head), seen)
                    v = row.column("asked").flatten().to_numpy()
                    for at in range(0, len(v), AT_ONCE):
                        some = v[at : at + AT_ONCE]
                        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(beyond(*world[:2], some, world[2]))], names=["v", "gain"])

        found = asked.mapInArrow(run, "v long, gain long").groupBy("v").agg(F.sum("gain").alias("gain"))
        return found if self.count else candidates.select("v", F.lit(0).cast("long").alias("gain")).limit(0)


def marginal_spread(graph: Graph, seeds: list[int], count: int, seed: int = 0, strategy: str = "auto", model: str = "IC") -> DataFrame:
    """v, total: over ``count`` live-edge worlds, the number of vertices reached from seeds and v together, for every v not a seed."""
    spread = Spread(graph, count, seed, strategy, model)
    for s in seeds:
        spread.add(s)
    others = graph.vertices.select(F.col("vid").alias("v")).filter(~F.col("v").isin([int(s) for s in seeds]))
    return spread.gains(others).select("v", (F.col("gain") + spread.total).cast("long").alias("total"))


def hill_climb(graph: Graph, k: int = 10, count: int = 10_000, seed: int = 0, strategy: str = "auto", model: str = "IC") -> Result:
    """Greedy over forward live-edge worlds: min(k, n) seeds, ties to the smaller id.

    Reachability sketches give every vertex an upper bound. Gains only fall as seeds are added, so a bound or an
    old gain stays a bound: a round evaluates the ``LAZY`` candidates of the largest bounds, until the best that is
    evaluated is not below any other bound. So few vertices are ever evaluated. Where bounds are loose, more rounds
    evaluate four times as many as the one before, so their number grows with the logarithm of what must be evaluated.
    """
    began = time.perf_counter()
    spread = Spread(graph, count, seed, strategy, model)
    known = checkpoint(spread.bounds().select("v", F.col("bound").alias("gain"), F.lit(-1).alias("turn")))
    sampling, evaluated = (time.perf_counter() - began) * 1000, 0
    for turn in range(min(k, graph.n)):
        misses = 0
        while True:
            top = known.orderBy(F.desc("gain"), "v").first()
            if top["turn"] == turn:
                break
            largest = known.orderBy(F.desc("gain"), "v").limit(LAZY << 2 * max(misses - SAME, 0))
            fresh = checkpoint(spread.gains(checkpoint(largest.filter(F.col("turn") < turn).select("v"))).select("v", F.col("gain").alias("_g")))
            evaluated, misses = evaluated + fresh.count(), misses + 1
            known = checkpoint(known.join(fresh, "v", "left").select("v", F.coalesce("_g", "gain").alias("gain"), F.when(F.col("_g").isNull(), F.col("turn")).otherwise(turn).alias("turn")))
        spread.add(top["v"])
        known = known.filter(F.col("v") != top["v"])
    return Result(spread.seeds, count, 0.0, spread.total / count if count else 0.0, True, {"Samples": count, "Evaluated": evaluated, "Sampling": sampling, "SeedSelection": (time.perf_counter() - began) * 1000 - sampling})


def as_frame(graph: Graph, result: Result) -> DataFrame:
    """rank, vertex (original id), of a result."""
    rows = pd.DataFrame({"rank": np.arange(1, len(result.seeds) + 1), "vertex": graph.original_list(result.seeds)})
    return graph.edges.sparkSession.createDataFrame(rows, "rank long, vertex long")
