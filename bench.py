"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of seconds."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(max(int(cpus), 8))).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from seedflow.operators import influence, weights
    from seedflow.operators.coverage import max_coverage
    from seedflow.operators.graph import Graph
    from seedflow.operators.sampling import rrr_sets, simulate
    from seedflow.plans.catalog import ev
    from seedflow.sources import generators, tables

    seconds: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        out = run()
        seconds[name] = round(time.perf_counter() - start, 3)
        return out

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    noop(spark.range(100))
    graph = timed("build_ev", lambda: ev(spark, sf_dir))
    timed("csr_ev", lambda: graph.csr("dst"))
    timed("rrr_10000_ic_ev", lambda: noop(rrr_sets(graph, 10_000)))
    timed("rrr_10000_lt_ev", lambda: noop(rrr_sets(graph, 10_000, "LT")))
    timed("max_coverage_k10_ev", lambda: max_coverage(rrr_sets(graph, 10_000), 10, 10_000))
    timed("simulate_ic_100_ev", lambda: noop(simulate(graph, list(range(10)), 100)))
    timed("simulate_lt_100_ev", lambda: noop(simulate(graph, list(range(10)), 100, "LT")))
    timed("imm_k10_ev", lambda: influence.imm(graph, 10, 0.5))
    timed("opimc_k10_ev", lambda: influence.opimc(graph, 10, 0.5))
    parts = timed("build_pp", lambda: Graph.build(weights.undirected(tables.part_edges(spark, sf_dir)), weigh=weights.weighted_cascade))
    timed("rrr_1000_ic_pp", lambda: noop(rrr_sets(parts, 1000)))
    timed("simulate_ic_100_pp", lambda: noop(simulate(parts, list(range(10)), 100)))
    for scale in (10, 12, 14):
        r = Graph.build(generators.rmat(spark, scale), weigh=weights.weighted_cascade)
        timed(f"rrr_10000_ic_rmat{scale}", lambda r=r: noop(rrr_sets(r, 10_000)))
    # the published harness: weight 1/2, four kinds of graphs, 10,000 sets, 10 seeds
    half = lambda edges: Graph.build(edges, weigh=lambda e: weights.constant(e, 0.5))
    kinds = {
        "rmat": lambda s: generators.rmat(spark, s), "ba": lambda s: generators.barabasi_albert(spark, 1 << s, 8),
        "ws": lambda s: generators.watts_strogatz(spark, 1 << s, 8, 0.5), "lfr": lambda s: generators.lfr(spark, 1 << s),
    }
    for kind, make in kinds.items():
        g = half(make(10))
        timed(f"rrr_10000_half_{kind}10", lambda g=g: noop(rrr_sets(g, 10_000)))
    g = half(kinds["rmat"](12))
    for strategy in ("bits", "local"):
        timed(f"rrr_1000_half_rmat12_{strategy}", lambda s=strategy: noop(rrr_sets(g, 1000, strategy=s)))
    sets = rrr_sets(half(kinds["lfr"](10)), 10_000)
    timed("max_coverage_k10_half_lfr10", lambda: max_coverage(sets, 10, 10_000))
    timed("hill_climb_k5_10000_ev", lambda: influence.hill_climb(graph, 5, 10_000))
    timed("tim_k10_ev", lambda: influence.tim(graph, 10, 0.5, max_sets=200_000))
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
