import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedflow import cli
from seedflow.operators import influence, weights
from seedflow.operators.coverage import coverage, max_coverage, seed_coverage, uncovered_by
from seedflow.operators.graph import Graph
from seedflow.operators.sampling import live_edges, live_parents, reach, rrr_sets, samples, simulate


@pytest.fixture(scope="module")
def wc(club):
    return club.with_weights(weights.weighted_cascade(club.edges))


@pytest.fixture(scope="module")
def cyclic(spark, club_edges):
    """Both directions of every tie."""
    return Graph.build(spark.createDataFrame(club_edges + [(b, a, w) for a, b, w in club_edges], "src long, dst long, weight double"))


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


@pytest.mark.parametrize("model", ["IC", "LT"])
def test_strategies_agree(wc, cyclic, model):
    for g in (wc, cyclic.with_weights(weights.weighted_cascade(cyclic.edges))):
        local, frontier = (rows(rrr_sets(g, 40, model, strategy=s), "sid", "v") for s in ("local", "frontier"))
        assert local == frontier
        assert {s for s, _ in local} == set(range(40)) and len(set(local)) == len(local)


def test_sets_are_the_same_whenever_drawn(cyclic):
    whole = rows(rrr_sets(cyclic, 60), "sid", "v")
    assert whole == sorted(rows(rrr_sets(cyclic, 25), "sid", "v") + rows(rrr_sets(cyclic, 60, start=25), "sid", "v"))
    assert whole != rows(rrr_sets(cyclic, 60, stream="r2"), "sid", "v")
    with pytest.raises(ValueError):
        rrr_sets(cyclic, 5, "XX")


@pytest.mark.parametrize("model", ["IC", "LT"])
def test_simulation_strategies_agree(cyclic, model):
    g = cyclic.with_weights(weights.weighted_cascade(cyclic.edges))
    one, two = (rows(simulate(g, [0, 33], 20, model, strategy=s), "replica", "activated", "rounds") for s in ("local", "frontier"))
    assert one == two and len(one) == 20


def test_simulation_edges(club):
    sure = club.with_weights(weights.constant(club.edges, 1.0))
    for orig, size in ((1, 24), (2, 17), (3, 13), (24, 7), (34, 1)):
        assert {r["activated"] for r in simulate(sure, club.dense_list([orig]), 3).collect()} == {size}
    assert {tuple(r)[1:] for r in simulate(sure, [], 2).collect()} == {(0, 0)}
    never = club.with_weights(weights.constant(club.edges, 0.0))
    assert {tuple(r)[1:] for r in simulate(never, [0], 2).collect()} == {(1, 1)}


def test_one_edge_is_live_as_often_as_its_weight(spark):
    g = Graph.build(spark.createDataFrame([(0, 1, 0.3)], "src long, dst long, weight double"))
    live = live_edges(g, 4000).count()
    assert abs(live / 4000 - 0.3) < 0.03
    assert abs(live_parents(g, 4000).count() / 4000 - 0.3) < 0.03
    spread = simulate(g, [0], 4000).agg(F.avg("activated")).first()[0]
    assert abs(spread - 1.3) < 0.03


def test_lt_and_ic_agree_on_expected_spread_of_a_tree(spark):
    g = Graph.build(spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (1, 3, 0.5)], "src long, dst long, weight double"))
    ic, lt = (simulate(g, [0], 4000, m).agg(F.avg("activated")).first()[0] for m in ("IC", "LT"))
    assert abs(ic - 2.25) < 0.06 and abs(lt - 2.25) < 0.06


def hand_made():
    out = []
    for i in range(1000):
        out += [(i, 2), (i, 3 if i % 2 else 5)]
    for i in range(100):
        out += [(1000 + i, v) for v in ((3, 4, 5), (1, 3), (1, 5))[i % 3]]
    return out


def test_coverage_goldens(spark):
    sets = spark.createDataFrame(hand_made(), "sid long, v long")
    count = lambda d: {r[0]: r[1] for r in coverage(d).collect()}
    assert count(sets) == {1: 66, 2: 1000, 3: 567, 4: 34, 5: 567}
    rest = uncovered_by(sets, 2)
    assert count(rest) == {1: 66, 3: 67, 4: 34, 5: 67}
    assert count(uncovered_by(rest, 1)) == {3: 34, 4: 34, 5: 34}
    for strategy, entries in (("local", 0), ("distributed", 0), ("distributed", 300), ("distributed", 10**6)):
        got = max_coverage(sets, 5, 1100, strategy, entries)
        assert (got.seeds, got.gains, got.fraction) == ([2, 3, 1], [1000, 67, 33], 1.0)
    assert seed_coverage(sets, [1, 4]) == 100 and seed_coverage(sets, []) == 0
    assert max_coverage(sets.limit(0), 3, 0).seeds == []


def test_greedy_is_greedy(wc):
    sets = rrr_sets(wc, 300)
    got = max_coverage(sets, 4, 300)
    left, members = {}, {}
    for s, v in rows(sets, "sid", "v"):
        members.setdefault(v, set()).add(s)
    done = set()
    for v, gain in zip(got.seeds, got.gains, strict=True):
        left = {u: len(m - done) for u, m in members.items()}
        assert gain == max(left.values()) and v == min(u for u, c in left.items() if c == gain)
        done |= members[v]


def test_estimators_find_good_seeds(wc):
    best = influence.hill_climb(wc, 3, 400)
    assert len(best.seeds) == 3
    top = simulate(wc, best.seeds, 600).agg(F.avg("activated")).first()[0]
    for run in (influence.imm(wc, 3), influence.opimc(wc, 3), influence.tim(wc, 3, max_sets=20_000), influence.imm(wc, 3, model="LT")):
        assert len(run.seeds) == 3 and 0 < run.fraction <= 1
        assert simulate(wc, run.seeds, 600).agg(F.avg("activated")).first()[0] > 0.85 * top


def test_rrr_estimate_matches_simulation(wc):
    sets = rrr_sets(wc, 6000)
    estimate = seed_coverage(sets, [0]) / 6000 * wc.n
    assert abs(estimate - simulate(wc, [0], 3000).agg(F.avg("activated")).first()[0]) < 0.8


def test_hill_climbing_strategies_agree(cyclic):
    g = cyclic.with_weights(weights.constant(cyclic.edges, 0.1))
    one, two = (rows(influence.marginal_spread(g, [5], 4, strategy=s), "v", "total") for s in ("local", "frontier"))
    assert one == two and len(one) == 33


def test_community_seeds(spark, club):
    g = club.with_weights(weights.weighted_cascade(club.edges))
    labels = g.vertices.select("orig", (F.col("orig") % 2).alias("community"))
    got = influence.community_imm(g, labels, 4, max_sets=5000).collect()
    assert len(got) == 4 and len({r["vid"] for r in got}) == 4


def test_width_and_kpt(wc):
    sets = rrr_sets(wc, 50)
    into = {r[0]: r[1] for r in wc.degree("dst").collect()}
    want = {}
    for s, v in rows(sets, "sid", "v"):
        want[s] = want.get(s, 0) + into[v]
    assert dict(rows(influence.widths(wc, sets), "sid", "width")) == want
    kappa = np.mean([1 - (1 - w / 78) ** 3 for w in want.values()])
    assert abs(influence.kpt_mean(wc, sets, 3) - kappa) < 1e-12


def test_bad_arguments(wc):
    with pytest.raises(ValueError):
        influence.imm(wc, 0)
    with pytest.raises(ValueError):
        influence.imm(wc, 2, model="??")


def test_reach_accepts_many_starts(club):
    starts = samples(club.edges.sparkSession, 0, 3).withColumn("v", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    sure = club.with_weights(weights.constant(club.edges, 1.0))
    got = reach(sure, starts, forward=True).groupBy("sid").count().collect()
    assert {r["count"] for r in got} == {24}


def test_command_line(spark, tmp_path, club_edges):
    path, out = tmp_path / "club.tsv", tmp_path / "out.json"
    path.write_text("".join(f"{a} {b} {w}\n" for a, b, w in club_edges))
    common = ["-i", str(path), "-o", str(out), "-w"]
    got = cli.main(["imm", *common, "-k", "3", "--rr-store-dir", str(tmp_path / "rr")], spark)[0]
    assert got["Algorithm"] == "IMM" and len(got["Seeds"]) == 3 and set(got["Seeds"]) <= set(range(1, 35))
    again = cli.main(["imm", *common, "-k", "3", "--rr-store-dir", str(tmp_path / "rr")], spark)[0]
    assert again["Seeds"] == got["Seeds"]
    fixed = cli.main(["imm", *common, "-k", "2", "--rrsets", "50"], spark)[0]
    assert fixed["Theta"] == 50 and fixed["Guaranteed"] is False and fixed["RRRSetSizeBytes"] > 0 and len(fixed["Iterations"]) == 1
    assert {"Counting", "Pivoting", "ThetaEstimation", "GenerateRRRSets"} <= set(got) and got["Guaranteed"] is True
    assert cli.main(["imm", *common, "-k", "2", "--max-sets", "30"], spark)[0]["Guaranteed"] is False
    assert len(cli.main(["imm", *common, "-k", "2", "--weight-bits", "8"], spark)[0]["Seeds"]) == 2
    assert len(cli.main(["opimc", *common, "-k", "2"], spark)[0]["Seeds"]) == 2
    assert len(cli.main(["hill-climbing", *common, "-k", "2", "--samples", "20"], spark)[0]["Seeds"]) == 2
    cli.main(["simulator", "-i", str(path), "-w", "-e", str(out), "-o", str(tmp_path / "sim.json"), "--replicas", "7"], spark)
    assert len(json.loads((tmp_path / "sim.json").read_text())[0]["Simulations"]) == 7
    cli.main(["dump-graph", "-i", str(path), "-w", "-o", str(tmp_path / "dump"), "--transpose"], spark)
    assert spark.read.text(str(tmp_path / "dump")).count() == 78


def _live(edges, sid, model):
    """The live edges of one world, edge by edge; edges: rows of Graph.edges."""
    from seedflow.functions.rng import fold_int, salted

    sh = fold_int(salted("sample"), sid)
    if model == "IC":
        return [(e["src"], e["dst"]) for e in edges if fold_int(e["eh"], sh) < e["thr"]]
    out = []
    for v in sorted({e["dst"] for e in edges}):
        coin, low = fold_int(fold_int(salted("vertex"), v), sh), 0
        for e in sorted((e for e in edges if e["dst"] == v), key=lambda e: (e["src"], e["k"])):
            if low <= coin < low + e["thr"]:
                out.append((e["src"], v))
            low += e["thr"]
    return out


def _reached(live, starts):
    seen, todo = set(starts), list(starts)
    while todo:
        u = todo.pop()
        for a, b in live:
            if a == u and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("model", ["IC", "LT"])
def test_hill_climbing_equals_plain_greedy(spark, club, model):
    from seedflow.operators import weights
    from seedflow.operators.influence import hill_climb

    g = club.with_weights(weights.weighted_cascade(club.edges))
    edges, worlds = g.edges.collect(), 6
    live, seeds = [_live(edges, s, model) for s in range(worlds)], []
    for _ in range(4):
        total = {v: sum(len(_reached(w, [*seeds, v])) for w in live) for v in range(g.n) if v not in seeds}
        seeds.append(min(total, key=lambda v: (-total[v], v)))
    got = hill_climb(g, 4, worlds, model=model)
    assert got.seeds == seeds and got.spread * worlds == sum(len(_reached(w, seeds)) for w in live)
    assert hill_climb(g, 2, worlds, model=model, strategy="frontier").seeds == seeds[:2]


def test_stored_sets_know_what_they_are_of(spark, club, tmp_path):
    from seedflow.operators import weights
    from seedflow.operators.influence import Sets, imm
    from seedflow.sources import edges as E

    path, g = str(tmp_path / "store"), club.with_weights(weights.weighted_cascade(club.edges))
    first = E.reload_sets(g, path, "IC").grow(40)
    assert first.drawn == 40
    E.store_sets(first, path)
    E.store_sets(first, path)  # written again, a range replaces itself
    again = E.reload_sets(g, path, "IC")
    assert again.drawn == 40 and again.rows.count() == first.rows.count()
    E.store_sets(again.grow(70), path, 40)
    third = E.reload_sets(g, path, "IC")
    assert third.drawn == 70 and sorted(map(tuple, third.rows.collect())) == sorted(map(tuple, Sets(g, "IC").grow(70).rows.collect()))
    for other, model, seed in ((club, "IC", 0), (g, "LT", 0), (g, "IC", 1)):
        with pytest.raises(ValueError):
            E.reload_sets(other, path, model, seed)
    assert imm(g, 2, sets=third).seeds and third.drawn >= 70


def test_capped_estimates_say_so(club):
    from seedflow.operators import weights
    from seedflow.operators.influence import imm, opimc, tim

    g = club.with_weights(weights.weighted_cascade(club.edges))
    for run in (imm, opimc, tim):
        assert run(g, 2, 0.5).guaranteed and not run(g, 2, 0.1, max_sets=20).guaranteed


@pytest.mark.parametrize("name", ["imm", "imm_lt"])
def test_imm_draws_all_sets_that_it_needs(monkeypatch, name):
    """Before, the queries stopped at 2,000,000 sets. Seeds that cover 2^-13 of 100,000 vertices need more; nothing is drawn here."""
    from types import SimpleNamespace

    from seedflow.functions import bounds
    from seedflow.operators.coverage import Greedy
    from seedflow.plans import catalog

    class Few(influence.Sets):
        def grow(self, theta):
            self.drawn = max(self.drawn, theta)
            return self

        def greedy(self, k, theta=None):
            return Greedy(list(range(k)), [1] * k, 2.0**-13)

    n = 100_000
    monkeypatch.setattr(influence, "Sets", Few)
    monkeypatch.setattr(influence, "as_frame", lambda graph, result: result)
    monkeypatch.setattr(catalog, "ev", lambda spark, sf_dir: SimpleNamespace(n=n))
    got = catalog.QUERIES[name](None, "")
    e, l = math.sqrt(2) * 0.5, 1 + 1 / math.log2(n)
    assert got.details["theta_primes"] == [bounds.imm_theta_prime(x, e, l, 5, n) for x in range(1, 14)]
    assert got.sets == bounds.imm_theta(0.5, l, 5, n * 2.0**-13 / (1 + e), n) > 2_000_000 and got.guaranteed
    assert cli.parser().parse_args(["imm", "-i", "graph.tsv"]).max_sets == 0  # no limit


def test_communities_together_equal_each_alone(spark, club):
    from seedflow.operators import weights
    from seedflow.operators.influence import community_imm
    from tests.conftest import LABELS

    g = club.with_weights(weights.weighted_cascade(club.edges))
    labels = spark.createDataFrame([(i + 1, int(c)) for i, c in enumerate(LABELS.split())], "orig long, community long")
    together = {(r["vid"], r["community"], round(r["gain"], 9)) for r in community_imm(g, labels, 3).collect()}
    alone = []
    for c in range(4):
        alone += [(r["vid"], r["community"], round(r["gain"], 9)) for r in community_imm(g, labels.filter(f"community = {c}"), 3).collect()]
    assert together == set(sorted(alone, key=lambda r: (-r[2], r[0]))[:3])


def test_bit_sweep_is_reachability():
    from seedflow.operators.sampling import sweep

    rng = np.random.default_rng(3)
    tail, head = rng.integers(0, 40, 90), np.sort(rng.integers(0, 40, 90))
    starts = np.arange(40)
    mask = sweep(40, tail, head, starts)
    for s in starts:
        assert {v for v in range(40) if int(mask[v]) >> int(s) & 1} == _reached(list(zip(tail.tolist(), head.tolist(), strict=True)), [int(s)])


def test_short_lines_raise(spark):
    from seedflow.sources.edges import parse_lines

    lines = lambda *t: spark.createDataFrame([(x,) for x in t], "value string")
    assert parse_lines(lines("1 2 0.5 x", "", "# 1"), True).count() == 1
    for bad, weighted in (("1", False), ("1 2", True)):
        with pytest.raises(Exception, match="lacks a field"):
            parse_lines(lines(bad), weighted).collect()


@pytest.mark.parametrize("weight", [0.1, 0.5, 1.0])
def test_bits_agree_with_the_byte_map(spark, cyclic, weight):
    g = cyclic.with_weights(weights.constant(cyclic.edges, weight))
    want = rows(rrr_sets(g, 150, strategy="local"), "sid", "v")
    assert rows(rrr_sets(g, 150, strategy="bits"), "sid", "v") == want == rows(rrr_sets(g, 150), "sid", "v")
    with pytest.raises(ValueError):
        rrr_sets(g, 5, "LT", strategy="bits")
    loose = Graph.build(spark.createDataFrame([(1, 2, 0.0), (3, 4, 1.0)], "src long, dst long, weight double"))
    assert rows(rrr_sets(loose, 70, strategy="bits"), "sid", "v") == rows(rrr_sets(loose, 70, strategy="local"), "sid", "v")


@pytest.mark.parametrize("model", ["IC", "LT"])
def test_sketches_bound_the_reach(cyclic, model):
    """No bound is below the true reach, bounds are close where worlds are many, and joins give what arrays give."""
    g = cyclic.with_weights(weights.weighted_cascade(cyclic.edges))
    for count, slack in ((1, 6.0), (400, 1.3)):
        spread = influence.Spread(g, count, model=model)
        gain = dict(rows(spread.gains(g.vertices.select(F.col("vid").alias("v"))), "v", "gain"))
        bound = dict(rows(spread.bounds(), "v", "bound"))
        assert set(gain) == set(bound) and all(gain[v] <= bound[v] <= slack * gain[v] + 8 for v in gain)
    a, b = (dict(rows(influence.Spread(g, 3, strategy=s, model=model).bounds(), "v", "bound")) for s in ("local", "frontier"))
    assert all(abs(a[v] - b[v]) <= 1 for v in a)


def test_hill_climbing_evaluates_few(spark):
    from seedflow.sources import generators

    g = Graph.build(generators.rmat(spark, 11, 8), weigh=weights.weighted_cascade)
    got = influence.hill_climb(g, 3, 300)
    assert len(got.seeds) == 3 and got.details["Evaluated"] < g.n / 4
    spread = influence.Spread(g, 300)
    first = max(rows(spread.gains(g.vertices.select(F.col("vid").alias("v"))), "v", "gain"), key=lambda r: (r[1], -r[0]))
    assert got.seeds[0] == first[0]


def test_distributed_counts_are_kept(wc):
    """Counts are lowered where few members go and counted again where few are left; either way the greedy is the same."""
    sets = rrr_sets(wc, 400)
    want = max_coverage(sets, 12, 400, "local")
    got = max_coverage(sets, 12, 400, "distributed", 0)
    assert (got.seeds, got.gains) == (want.seeds, want.gains) and {how for how, _ in got.rounds} >= {"lowered"}
    left = [n for _, n in got.rounds]
    assert left == sorted(left, reverse=True)
    star = [(i, 0) for i in range(90)] + [(i, i % 7 + 1) for i in range(100)]
    df = wc.edges.sparkSession.createDataFrame(star, "sid long, v long")
    got = max_coverage(df, 5, 100, "distributed", 0)
    assert got.rounds[0] == ("recounted", 10) and (got.seeds, got.gains) == (max_coverage(df, 5, 100, "local").seeds, max_coverage(df, 5, 100, "local").gains)


def test_lazy_greedy_brings_few_members(wc, monkeypatch):
    """Beyond the driver's limit, only the leading candidates' members are brought, and the greedy is the same, ties included."""
    from seedflow.operators import coverage as C

    sets = rrr_sets(wc, 400)
    want = max_coverage(sets, 12, 400, "local")
    for entries, candidates in ((1, 5), (150, 3), (10**6, 5), (10**6, 1000)):
        got = C.greedy_lazy(sets, 12, 400, entries, candidates)
        assert (got.seeds, got.gains) == (want.seeds, want.gains) and max(n for _, n in got.rounds) <= entries
        assert len(got.rounds) == (12 if entries == 1 else len(got.rounds)) and (candidates < 1000 or len(got.rounds) == 1)
    monkeypatch.setattr(C, "LAZY_ENTRIES", 150)
    got = max_coverage(sets, 12, 400, local_entries=100)
    assert (got.seeds, got.gains, got.fraction) == (want.seeds, want.gains, want.fraction) and {how for how, _ in got.rounds} == {"lazy"}
    every = sets.sparkSession.createDataFrame(hand_made(), "sid long, v long")
    assert C.greedy_lazy(every, 5, 1100).seeds == [2, 3, 1] and C.greedy_lazy(every.limit(0), 3, 0).seeds == []


def test_blocks_agree_with_the_byte_map(spark, cyclic):
    """Small blocks, so that hubs lie in several; no block is larger than it may be."""
    from seedflow.operators.blocks import Blocks, sets_by_blocks
    from seedflow.operators.sampling import root_of

    g = cyclic.with_weights(weights.weighted_cascade(cyclic.edges))
    blocks = Blocks(g, "dst", edges=5)
    try:
        assert blocks.largest <= 5 and blocks.table.agg(F.sum("n")).first()[0] == g.m
        hubs = blocks.table.groupBy("first").count().filter("count > 1").count()
        assert hubs > 0
        rooted = samples(spark, 30, 170).select("sid", root_of(F.col("sh"), g.n).alias("v"))
        assert rows(sets_by_blocks(blocks, rooted, "sample", 0), "sid", "v") == rows(rrr_sets(g, 170, start=30, strategy="local"), "sid", "v")
    finally:
        blocks.drop()


def test_races_agree_and_follow_the_weights(spark, cyclic):
    g = cyclic.with_weights(weights.lt_normalize(cyclic.edges))
    one, two = (rows(rrr_sets(g, 40, "LTR", strategy=s), "sid", "v") for s in ("local", "frontier"))
    assert one == two
    h = Graph.build(spark.createDataFrame([(0, 3, 0.5), (1, 3, 0.2), (2, 3, 0.0)], "src long, dst long, weight double"))
    got = dict(map(tuple, live_parents(h, 6000, race=True).groupBy("parent").count().collect()))
    assert set(got) == {0, 1} and abs(got[0] / 6000 - 0.5) < 0.03 and abs(got[1] / 6000 - 0.2) < 0.03
    with pytest.raises(ValueError):
        reach(g, samples(spark, 0, 1).withColumn("v", F.lit(0).cast("long")), "LTR", forward=True)


def test_a_stored_graph_knows_what_it_is_of(spark, tmp_path, club_edges):
    one, two = tmp_path / "a.tsv", tmp_path / "b.tsv"
    one.write_text("".join(f"{a} {b}\n" for a, b, _ in club_edges))
    two.write_text("".join(f"{a + 100} {b + 100}\n" for a, b, _ in club_edges))
    store = ["--graph-store-dir", str(tmp_path / "g"), "-o", str(tmp_path / "o.json"), "-k", "2", "--rrsets", "40"]
    first = cli.main(["imm", "-i", str(one), *store], spark)[0]
    copy = tmp_path / "copy.tsv"
    copy.write_text("".join(reversed(one.read_text().splitlines(keepends=True))))
    assert cli.main(["imm", "-i", str(copy), *store], spark)[0]["Seeds"] == first["Seeds"]
    for other in (["-i", str(two)], ["-i", str(one), "-d", "LT"], ["-i", str(one), "--seed", "3"], ["-i", str(one), "-u"], ["-i", str(one), "--distribution", "const"]):
        with pytest.raises(ValueError, match="is of another"):
            cli.main(["imm", *other, *store], spark)


def test_weights_become_integers_as_they_are_loaded(spark, tmp_path):
    from seedflow.sources.edges import load_graph

    (tmp_path / "w.tsv").write_text("1 2 0.5\n2 3 1.0\n3 1 0.001\n")
    for bits, want in ((8, {127, 255, 0}), (16, {32767, 65535, 65})):
        edges = load_graph(spark, str(tmp_path / "w.tsv"), weighted=True, bits=bits).edges
        assert {r["wq"] for r in edges.collect()} == want and all(r["thr"] == (r["wq"] + 1) << (32 - bits) for r in edges.collect())


def test_parts_stop_once_they_cannot_win(spark):
    """With a heap of the two best, the weak parts take part in the first round only; the best picks are those of all rounds."""
    from seedflow.operators.coverage import greedy_grouped

    rows_ = [(p, 100 * p + i, v) for p in range(5) for i in range(8) for v in ({0: (i % 2,), 1: (i % 4,)}.get(p, (i,)))]
    sets = spark.createDataFrame(rows_, "part long, sid long, v long")
    k = spark.range(5).select(F.col("id").alias("part"), F.lit(6).alias("k"))
    scale = spark.range(5).select(F.col("id").alias("part"), F.lit(1.0).alias("scale"))
    every = rows(greedy_grouped(sets, k, 6), "part", "rank", "v", "gain")
    some = rows(greedy_grouped(sets, k, 6, scale, 2), "part", "rank", "v", "gain")
    assert set(some) < set(every) and [r for r in some if r[1] > 1] == [(0, 2, 1, 4), (1, 2, 1, 2)]
    assert sorted(every, key=lambda r: (-r[3], r[2]))[:2] == sorted(some, key=lambda r: (-r[3], r[2]))[:2]


def test_a_round_ahead_changes_nothing(wc):
    plain = influence.opimc(wc, 3, 0.12)
    ahead = influence.opimc(wc, 3, 0.12, ahead_bytes=1 << 30)
    assert (ahead.seeds, ahead.sets, ahead.spread) == (plain.seeds, plain.sets, plain.spread) and plain.details["rounds"] > 1
    used = ahead.details["ahead"]
    assert used["taken"] == plain.details["rounds"] - 1 and used["cancelled"] <= 1 and not used["refused"]
    small = influence.opimc(wc, 3, 0.12, ahead_bytes=100)
    assert small.seeds == plain.seeds and small.details["ahead"]["refused"] and not small.details["ahead"]["taken"]


def test_a_cancelled_round_ends_its_jobs(spark, wc):
    from seedflow.operators.influence import Ahead, Sets

    sets = [Sets(wc, "IC", "r1"), Sets(wc, "IC", "r2")]
    ahead = Ahead(sets, 3_000_000)
    ahead.cancel()
    tracker = spark.sparkContext.statusTracker()
    assert not ahead.thread.is_alive() and not set(tracker.getJobIdsForGroup(ahead.group)) & set(tracker.getActiveJobsIds())
    assert all(s.drawn == 0 and s.rows is None for s in sets)


def test_community_lists_are_read_in_splits(spark, tmp_path):
    from pyspark.sql import functions as F  # noqa: F811

    from seedflow.sources.edges import read_communities

    labels = [(i * 7) % 11 for i in range(400)]
    (tmp_path / "c").mkdir()
    text = "".join(f"  {a} {b}\t{c}\n" + ("\n" if a == 3 else "") for a, b, c in zip(labels[:297:3], labels[1:297:3], labels[2:297:3], strict=True))
    (tmp_path / "c" / "a.txt").write_text(text)
    (tmp_path / "c" / "b.txt").write_text(" ".join(map(str, labels[297:])))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        assert spark.read.text(str(tmp_path / "c" / "a.txt")).select(F.input_file_block_start()).distinct().count() > 3
        assert sorted(map(tuple, read_communities(spark, str(tmp_path / "c")).collect())) == [(i + 1, c) for i, c in enumerate(labels)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
