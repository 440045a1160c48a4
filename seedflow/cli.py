"""Command line: imm, opimc, tim, hill-climbing, community-imm, simulator, dump-graph, rrr-sets."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import influence
from .operators.graph import Graph
from .operators.sampling import simulate
from .records import record, timed
from .sources import binary, edges


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seedflow")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, k: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("-i", "--input", required=True)
        p.add_argument("-o", "--output", default="output.json")
        p.add_argument("-u", "--undirected", action="store_true")
        p.add_argument("-w", "--weighted", action="store_true")
        p.add_argument("--reload-binary", action="store_true", help="the input is a stored graph")
        p.add_argument("--distribution", choices=["uniform", "normal", "const"], default="uniform")
        p.add_argument("--mean", type=float, default=0.5)
        p.add_argument("--variance", type=float, default=1.0)
        p.add_argument("--scale-factor", type=float, default=1.0)
        p.add_argument("--weight-bits", type=int, choices=[8, 16], help="weights as integers of so many bits")
        p.add_argument("--disable-renumbering", action="store_true")
        p.add_argument("--graph-store-dir")
        p.add_argument("-d", "--diffusion-model", choices=["IC", "LT"], default="IC")
        p.add_argument("--seed", type=int, default=0)
        if k:
            p.add_argument("-k", "--seed-set-size", type=int, default=10)
        return p

    for name in ("imm", "opimc", "tim", "community-imm"):
        command(name).add_argument("-e", "--epsilon", type=float, default=0.5)
        commands.choices[name].add_argument("--max-sets", type=int, default={"imm": 0, "community-imm": 200_000}.get(name, influence.MAX_SETS), help="draw no more sets than this; 0: no limit")
    imm = commands.choices["imm"]
    imm.add_argument("--rr-store-dir")
    imm.add_argument("--rrsets", type=int, help="draw exactly so many sets")
    commands.choices["opimc"].add_argument("--delta", type=float, default=0.05)
    commands.choices["community-imm"].add_argument("--community-map", required=True)
    command("hill-climbing").add_argument("--samples", type=int, default=10_000)
    sim = command("simulator", k=False)
    sim.add_argument("-e", "--experiment-file", required=True)
    sim.add_argument("--replicas", type=int, default=100)
    dump = command("dump-graph", k=False)
    dump.add_argument("--transpose", action="store_true")
    dump.add_argument("--normalize", action="store_true")
    dump.add_argument("--binary", action="store_true", help="store as Parquet, not as text")
    dump.add_argument("--published", action="store_true", help="one file of the published binary layout")
    return top


def load(spark: SparkSession, a: argparse.Namespace) -> Graph:
    def build() -> Graph:
        if a.reload_binary and os.path.isfile(a.input):
            return binary.read_binary(spark, a.input, scale=a.scale_factor)
        if a.reload_binary:
            return edges.reload_graph(spark, a.input, scale=a.scale_factor)
        return edges.load_graph(spark, a.input, a.weighted, a.undirected, a.diffusion_model, a.distribution, a.mean, a.variance, a.scale_factor, not a.disable_renumbering, a.seed, bits=a.weight_bits)

    if not a.graph_store_dir:
        return build()
    how = ("reload_binary", "weighted", "undirected", "diffusion_model", "distribution", "mean", "variance", "scale_factor", "disable_renumbering", "weight_bits", "seed")
    return edges.open_or_create(spark, a.graph_store_dir, build, {**{k: getattr(a, k) for k in how}, **edges.input_mark(spark, a.input, a.reload_binary and not os.path.isfile(a.input))})


def stored_sets(spark: SparkSession, graph: Graph, a: argparse.Namespace) -> influence.Sets:
    return edges.reload_sets(graph, a.rr_store_dir, a.diffusion_model, a.seed) if a.rr_store_dir else influence.Sets(graph, a.diffusion_model, seed=a.seed)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[dict]:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("seedflow").getOrCreate()
    graph, model = load(spark, a), a.diffusion_model
    if a.command == "dump-graph":
        graph = graph.transpose() if a.transpose else graph
        if a.published:
            binary.write_binary(graph, a.output, a.weight_bits or 32)
            return []
        edges.write_graph(graph, a.output) if a.binary else edges.write_edge_text(graph, a.output, a.normalize)
        return []
    if a.command == "simulator":
        out = edges.read_records(a.experiment_file)
        for r in out:
            runs = simulate(graph, graph.dense_list(r["Seeds"]), a.replicas, r.get("DiffusionModel", model), a.seed).orderBy("replica").collect()
            r["Simulations"] = [[x["activated"], x["rounds"]] for x in runs]
        edges.write_records(out, a.output)
        return out
    k, more = a.seed_set_size, {}
    most = getattr(a, "max_sets", 0) or None
    if a.command == "imm":
        sets = stored_sets(spark, graph, a)
        known = sets.drawn
        if a.rrsets:

            def run() -> influence.Result:
                got = sets.grow(a.rrsets).greedy(k, a.rrsets)
                return influence.Result(got.seeds, a.rrsets, got.fraction, got.fraction * graph.n, False, sets.phases())  # a number of sets that is given guarantees nothing
        else:

            def run() -> influence.Result:
                return influence.imm(graph, k, a.epsilon, model, a.seed, most, sets=sets)

        name, more = "IMM", {"Epsilon": a.epsilon}
    elif a.command == "opimc":
        name, run, more = "OPIMC", lambda: influence.opimc(graph, k, a.epsilon, a.delta, model, a.seed, most), {"Epsilon": a.epsilon, "Delta": a.delta}
    elif a.command == "tim":
        name, run, more = "TIM", lambda: influence.tim(graph, k, a.epsilon, model, a.seed, most), {"Epsilon": a.epsilon}
    elif a.command == "hill-climbing":
        name, run = "HillClimbing", lambda: influence.hill_climb(graph, k, a.samples, a.seed, model=model)
    else:
        labels = edges.read_communities(spark, a.community_map)

        def run() -> influence.Result:
            rows = influence.community_imm(graph, labels, k, a.epsilon, model, a.seed, most).orderBy(F.desc("gain"), "vid").collect()
            return influence.Result([r["vid"] for r in rows], 0, 0.0, sum(r["gain"] for r in rows), all(r["guaranteed"] for r in rows))

        name, more = "CommunityIMM", {"Epsilon": a.epsilon}
    result, ms = timed(run)
    if a.command == "imm" and a.rr_store_dir and sets.drawn > known:
        edges.store_sets(sets, a.rr_store_dir, known)
    out = [record(name, a.input, a.output, model, k, graph.original_list(result.seeds), ms, result, **more)]
    edges.write_records(out, a.output)
    return out


if __name__ == "__main__":
    print(json.dumps(main(), indent=2))
