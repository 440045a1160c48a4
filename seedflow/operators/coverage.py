"""Coverage of reverse-reachable sets (sid, v): counts, greedy maximum coverage, coverage of given seeds."""

from __future__ import annotations

import heapq
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import bucketed, checkpoint, stored

#: Sets with up to this many entries in all (16 bytes each) are brought to the driver for the greedy rounds.
LOCAL_ENTRIES = 1_000_000
#: Beyond: the candidates that a lazy round looks at, and their entries, at most.
CANDIDATES, LAZY_ENTRIES = 2000, 200_000
#: Seeds of up to this many parts are sent to every executor.
SMALL_PARTS = 100_000


@dataclass(frozen=True)
class Greedy:
    seeds: list[int]
    gains: list[int]
    fraction: float
    #: of the distributed rounds: how each changed the counts, and the sets' members that were left; of lazy ones, the members that were brought to the driver
    rounds: list[tuple[str, int]] = field(default_factory=list)
    #: milliseconds of counting at first, and of all rounds
    counting: float = 0.0
    pivoting: float = 0.0


def coverage(rrr: DataFrame) -> DataFrame:
    """v, covered: the number of sets that hold a vertex."""
    return rrr.groupBy("v").agg(F.count("*").alias("covered"))


def uncovered_by(rrr: DataFrame, seed: int) -> DataFrame:
    """The sets that do not hold ``seed``."""
    return rrr.join(rrr.filter(F.col("v") == seed).select("sid"), "sid", "left_anti")


def partition(rrr: DataFrame, v: int) -> DataFrame:
    """sid, holds: whether each set holds ``v``."""
    return rrr.groupBy("sid").agg(F.bool_or(F.col("v") == int(v)).alias("holds"))


def small_parts(df: DataFrame, rows: int) -> DataFrame:
    """A table of some rows a part, broadcast if it has few."""
    return F.broadcast(df) if rows <= SMALL_PARTS else df


def greedy_grouped(rrr: DataFrame, k: DataFrame, most: int, scale: DataFrame | None = None, best_of: int | None = None) -> DataFrame:
    """part, rank, v, gain: greedy maximum coverage in every part of ``rrr`` (part, sid, v) on its own; ``k``: part, k; ``most``: the largest k.

    All parts go through a round together, so the number of jobs does not depend on theirs. Ties to the smaller v.
    ``best_of``: only the picks of that many largest scaled gains are wanted (``scale``: part, scale). A part's gains
    only fall, so a part stops once its last one is below the best of all parts, kept in a heap of that size.
    """
    rest, picked, heap = checkpoint(rrr), [], []
    for rank in range(1, most + 1):
        counts = rest.groupBy("part", "v").agg(F.count("*").alias("n"))
        best = counts.groupBy("part").agg(F.max(F.struct("n", (-F.col("v")).alias("m"))).alias("b"))
        best = best.join(k, "part").filter(F.col("k") >= rank).select("part", F.lit(rank).alias("rank"), (-F.col("b.m")).alias("v"), F.col("b.n").alias("gain"))
        picked.append(checkpoint(best))
        parts = picked[-1].count()
        if not parts:
            break
        now = picked[-1]
        if best_of is not None:
            scaled = now.join(scale, "part").withColumn("_s", F.col("gain") * F.col("scale"))
            for r in scaled.orderBy(F.desc("_s")).limit(best_of).select("_s").collect():
                (heapq.heappush if len(heap) < best_of else heapq.heappushpop)(heap, r["_s"])
            if len(heap) == best_of:
                now = checkpoint(scaled.filter(F.col("_s") >= heap[0]).select("part", "v"))
                parts = now.count()
                rest = rest.join(small_parts(now.select("part"), parts), "part", "left_semi")
        covered = rest.join(small_parts(now.select("part", "v"), parts), ["part", "v"]).select("part", "sid")
        rest = checkpoint(rest.join(covered, ["part", "sid"], "left_anti"))
    out = picked[0]
    for p in picked[1:]:
        out = out.union(p)
    return out


def seed_coverage(rrr: DataFrame, seeds: list[int]) -> int:
    """Number of sets that hold any of the seeds."""
    return rrr.filter(F.col("v").isin([int(s) for s in seeds])).select("sid").distinct().count() if seeds else 0


def greedy_local(sid: np.ndarray, v: np.ndarray, k: int, sets: int) -> Greedy:
    if not len(v):
        return Greedy([], [], 0.0)
    began = time.perf_counter()
    sid = np.unique(sid, return_inverse=True)[1]
    by_set, by_vertex = np.argsort(sid, kind="stable"), np.argsort(v, kind="stable")
    set_at = np.concatenate([[0], np.cumsum(np.bincount(sid))])
    vertex_at = np.concatenate([[0], np.cumsum(np.bincount(v))])
    members, holders = v[by_set], sid[by_vertex]
    count, covered = np.bincount(v), np.zeros(len(set_at) - 1, bool)
    seeds, gains, counted = [], [], time.perf_counter()
    while len(seeds) < k and (best := int(count.argmax())) >= 0 and count[best] > 0:
        hit = holders[vertex_at[best] : vertex_at[best + 1]]
        hit = hit[~covered[hit]]
        covered[hit] = True
        n = set_at[hit + 1] - set_at[hit]
        gone = members[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(set_at[hit], n)]
        count = count - np.bincount(gone, minlength=len(count))
        seeds.append(best)
        gains.append(len(hit))
    return Greedy(seeds, gains, float(covered.sum() / sets) if sets else 0.0, [], (counted - began) * 1000, (time.perf_counter() - counted) * 1000)


def greedy_distributed(rrr: DataFrame, k: int, sets: int, local_entries: int = LOCAL_ENTRIES) -> Greedy:
    """Greedy rounds over a kept table of counts.

    The sets are stored twice, bucketed by vertex (an inverted index: a round reads its seed's bucket) and by set.
    The counts of a round are those of the round before, lowered by the members of the newly covered sets, or
    counted again from what is left where that is less; so a round shuffles no more than the smaller of both. Once
    ``local_entries`` members are left, the remaining rounds are run on the driver.
    """
    began = time.perf_counter()
    sets_by_v, index = bucketed(rrr.select("v", "sid"), "v")
    sets_by_sid, forward = bucketed(rrr.select("sid", "v"), "sid")
    seeds, gains, covered, rounds = [], [], None, []
    try:
        counts = checkpoint(coverage(sets_by_v))
        counted = time.perf_counter()
        while True:
            best, left = counts.agg(F.max(F.struct("covered", (-F.col("v")).alias("m"))), F.coalesce(F.sum("covered"), F.lit(0))).first()
            if len(seeds) == k or best is None:
                break
            rest = sets_by_sid if covered is None else sets_by_sid.join(covered, "sid", "left_anti")
            if left <= local_entries:
                rounds.append(("local", left))
                t = rest.select("sid", "v").toArrow()
                last = greedy_local(t.column("sid").to_numpy(), t.column("v").to_numpy(), k - len(seeds), 0)
                seeds, gains = seeds + last.seeds, gains + last.gains
                break
            seed = -best["m"]
            seeds.append(seed)
            gains.append(best["covered"])
            hit = sets_by_v.filter(F.col("v") == seed).select("sid")
            hit = stored(hit if covered is None else hit.join(covered, "sid", "left_anti"), "covered")
            members = sets_by_sid.join(hit, "sid").select("v")
            gone = coverage(members).withColumnRenamed("covered", "_gone")
            covered = hit if covered is None else covered.union(hit)
            lost = members.count()
            if 2 * lost <= left:
                counts = counts.join(gone, "v", "left").select("v", (F.col("covered") - F.coalesce("_gone", F.lit(0))).alias("covered")).filter("covered > 0")
            else:
                counts = coverage(sets_by_sid.join(covered, "sid", "left_anti"))
            rounds.append(("lowered" if 2 * lost <= left else "recounted", left - lost))
            counts = checkpoint(counts)
    finally:
        for name in (index, forward):
            rrr.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    return Greedy(seeds, gains, sum(gains) / sets if sets else 0.0, rounds, (counted - began) * 1000, (time.perf_counter() - counted) * 1000)


def greedy_lazy(rrr: DataFrame, k: int, sets: int, entries: int = LAZY_ENTRIES, candidates: int = CANDIDATES) -> Greedy:
    """Greedy rounds of which the driver sees the leading candidates alone.

    Vertices are counted on the cluster. Of those that cover most, the members (up to ``entries``) go to the driver,
    which picks among them for as long as a pick covers no less than any vertex that was left behind: gains only fall,
    so what such a vertex covered at first is a bound. The picks' sets are then struck out on the cluster, and what is
    left is counted again. The first pick of a round needs no members, so every round makes one, whatever its size.
    """
    began = time.perf_counter()
    by_sid, name = bucketed(rrr.select("sid", "v"), "sid")
    seeds, gains, rounds, covered, counted = [], [], [], None, None
    among = lambda df, v: df.filter(f"v IN ({', '.join(map(str, v))})")
    try:
        while len(seeds) < k:
            rest = by_sid if covered is None else by_sid.join(covered.hint("merge"), "sid", "left_anti")
            t = coverage(rest).orderBy(F.desc("covered"), "v").limit(candidates + 1).toArrow()
            v, n = t.column("v").to_numpy(), t.column("covered").to_numpy()
            counted = counted or time.perf_counter()
            if not len(v):
                break
            some = min(int(np.searchsorted(np.cumsum(n), entries, side="right")), candidates)
            picks, brought = [(int(v[0]), int(n[0]))], 0
            if some > 1 and len(seeds) + 1 < k:
                t = among(rest, v[:some].tolist()).toArrow()
                brought = t.num_rows
                got = greedy_local(t.column("sid").to_numpy(), t.column("v").to_numpy(), k - len(seeds), 0)
                bound = (int(n[some]), -int(v[some])) if some < len(v) else (0, 0)
                for pick in list(zip(got.seeds, got.gains, strict=True))[1:]:
                    if (pick[1], -pick[0]) < bound:
                        break
                    picks.append(pick)
            seeds, gains = seeds + [p for p, _ in picks], gains + [g for _, g in picks]
            rounds.append(("lazy", brought))
            if len(seeds) < k:
                hit = stored(among(rest, [p for p, _ in picks]).select("sid").distinct(), "covered")
                covered = hit if covered is None else covered.union(hit)
    finally:
        rrr.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    now = time.perf_counter()
    return Greedy(seeds, gains, sum(gains) / sets if sets else 0.0, rounds, ((counted or now) - began) * 1000, (now - (counted or now)) * 1000)


def max_coverage(rrr: DataFrame, k: int, sets: int, strategy: str = "auto", local_entries: int = LOCAL_ENTRIES) -> Greedy:
    """Up to k vertices that cover most sets, ties to the smaller one; stops when all sets are covered.

    ``auto``: on the driver up to ``local_entries`` members, else ``lazy``. ``distributed``: runs on the driver only what
    is left once that has ``local_entries`` members or fewer.
    """
    if strategy == "auto":
        rrr = checkpoint(rrr.select("sid", "v"))  # counted first, and not drawn twice
        strategy = "local" if rrr.count() <= local_entries else "lazy"
    if strategy == "lazy":
        return greedy_lazy(rrr, k, sets)
    if strategy == "distributed":
        return greedy_distributed(rrr, k, sets, local_entries)
    t = rrr.select("sid", "v").toArrow()
    return greedy_local(t.column("sid").to_numpy(), t.column("v").to_numpy(), k, sets)
