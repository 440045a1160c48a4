"""The registered graph queries, each with the SQL that it must agree with where SQL can express it.

The graph of most queries is ``ev``: users of consecutive events, weighted cascade, 64 sampled worlds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bounds
from ..functions.rng import ONE, fold_int, fold_sql, salted
from ..operators import influence, weights
from ..functions.session import checkpoint, fresh_path
from ..operators.coverage import coverage, greedy_grouped, max_coverage, partition, uncovered_by
from ..operators.coverage import seed_coverage as covered_by
from ..operators.graph import Graph
from ..operators.sampling import live_edges, live_parents, root_of, rrr_sets, samples, simulate
from ..sources import edges as stored
from ..sources import binary, generators, tables
from ..sources.edges import parse_lines

THETA, WORLDS, REPLICAS = 64, 16, 16
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def ev(spark: SparkSession, sf_dir: str, weigh=weights.weighted_cascade) -> Graph:
    return Graph.build(tables.event_edges(spark, sf_dir), weigh=weigh)


def _chain(source: str, first: int, keys: list[str], out: str, keep: str) -> str:
    """Nested subqueries that fold one key after the other, so no long operand is repeated."""
    sql = f"SELECT {keep}, {fold_sql(first, keys[0])} AS {out} FROM {source}"
    for key in keys[1:]:
        sql = f"SELECT {keep}, {fold_sql(out, key)} AS {out} FROM ({sql})"
    return sql


#: ev with dense ids; E: src, dst, k, eh, thr (weighted cascade); V: orig, vid; N: number of vertices.
EV = f"""
WITH RECURSIVE pairs AS (
  SELECT DISTINCT user_id AS s, nxt AS d FROM (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt <> user_id
), V AS MATERIALIZED (
  SELECT orig, row_number() OVER (ORDER BY orig) - 1 AS vid FROM (SELECT s AS orig FROM pairs UNION SELECT d FROM pairs)
), G AS (SELECT a.vid AS src, b.vid AS dst, 0::BIGINT AS k FROM pairs JOIN V a ON s = a.orig JOIN V b ON d = b.orig
), H AS ({_chain("G", salted("edge"), ["src", "dst", "k"], "eh", "src, dst, k")}
), E AS MATERIALIZED (SELECT *, {ONE} // count(*) OVER (PARTITION BY dst) AS thr FROM H
), N AS (SELECT count(*) AS n FROM V)"""


def _samples_sql(name: str, count: int, stream: str) -> str:
    return f", {name} AS MATERIALIZED (SELECT sid, {fold_sql(salted(stream), 'sid')} AS sh FROM range({count}) r(sid))"


ROOTS = _samples_sql("S", THETA, "sample") + f", R AS MATERIALIZED (SELECT sid, sh, ({fold_sql(salted('root'), 'sh')} % (SELECT n FROM N))::BIGINT AS v FROM S)"
RRR = ROOTS + f""", rrr AS (
  SELECT sid, sh, v FROM R
  UNION
  SELECT sid, sh, src FROM (SELECT rrr.sid, rrr.sh, E.src, thr, {fold_sql('eh', 'rrr.sh')} AS c FROM rrr JOIN E ON E.dst = rrr.v) WHERE c < thr
)"""
VHASH = f", P AS MATERIALIZED (SELECT vid, {fold_sql(salted('vertex'), 'vid')} AS vh FROM V), I AS MATERIALIZED (SELECT src, dst, sum(thr) OVER (PARTITION BY dst ORDER BY src, k) AS hi, thr FROM E)"
RRR_LT = ROOTS + VHASH + f""", rrr AS (
  SELECT sid, sh, v FROM R
  UNION
  SELECT sid, sh, src FROM (SELECT rrr.sid, rrr.sh, I.src, I.hi, I.thr, {fold_sql('vh', 'rrr.sh')} AS c FROM rrr JOIN P ON vid = rrr.v JOIN I ON I.dst = rrr.v) WHERE c < hi AND c >= hi - thr
)"""


@query(EV + RRR + " SELECT v, count(*) AS covered FROM rrr GROUP BY v ORDER BY covered DESC, v LIMIT 10")
def rrr_coverage_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(rrr_sets(ev(spark, sf_dir), THETA)).orderBy(F.desc("covered"), "v").limit(10)


@query(EV + " SELECT orig, vid FROM V")
def graph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir, None).vertices


@query(EV + " SELECT vid, count(src) AS degree FROM V LEFT JOIN E ON src = vid GROUP BY vid")
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir, None).degree("src")


@query(EV + " SELECT vid, count(src) AS degree FROM V LEFT JOIN E ON dst = vid GROUP BY vid")
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir, None).degree("dst")


@query(EV + " SELECT (SELECT n FROM N) AS vertices, count(*) AS edges FROM E")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ev(spark, sf_dir, None)
    return spark.createDataFrame([(g.n, g.m)], "vertices long, edges long")


@query("SELECT DISTINCT o_custkey::BIGINT AS src, l_suppkey::BIGINT + 1048576 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def purchase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.purchase_edges(spark, sf_dir)


@query("SELECT a.l_partkey::BIGINT AS part, count(DISTINCT b.l_partkey) AS degree FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey GROUP BY 1")
def part_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.part_edges(spark, sf_dir).groupBy(F.col("src").alias("part")).agg(F.count("*").alias("degree"))


@query(EV + " SELECT dst AS src, src AS dst FROM E")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir, None).transpose().edges.select("src", "dst")


@query(EV + " SELECT dst FROM E WHERE src = 0")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir, None).neighbors(0).select("dst")


@query("WITH p AS (SELECT DISTINCT user_id AS s, nxt AS d FROM (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt <> user_id) SELECT s AS src, d AS dst FROM p UNION ALL SELECT d, s FROM p")
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.undirected(tables.event_edges(spark, sf_dir))


@query("WITH l AS (SELECT CASE WHEN event_id % 7 = 0 THEN '# note' WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN user_id || ' ' || event_id || ' 0.5 % x' ELSE '  ' || user_id || chr(9) || event_id || '   0.25 more' END AS v, user_id, event_id FROM events) SELECT user_id AS src, event_id AS dst, 0.25::DOUBLE AS weight FROM l WHERE v <> '' AND v NOT LIKE '%#%' AND v NOT LIKE '%\\%%' ESCAPE '\\'")
def parse_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.expr("CASE WHEN event_id % 7 = 0 THEN '# note' WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN concat(user_id, ' ', event_id, ' 0.5 % x') ELSE concat('  ', user_id, '\t', event_id, '   0.25 more') END")
    return parse_lines(e.select(line.alias("value")), weighted=True)


@query(EV + " SELECT src, dst, 0.25::DOUBLE AS weight, 1073741824::BIGINT AS thr FROM E")
def weights_const(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.constant(ev(spark, sf_dir, None).edges, 0.25).select("src", "dst", "weight", "thr")


@query(EV + f" SELECT src, dst, {fold_sql('eh', salted('weight'))}::BIGINT AS thr FROM E")
def weights_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.uniform(ev(spark, sf_dir, None).edges).select("src", "dst", "thr")


_CDF = lambda x: 0.5 * (1 + math.erf((x - 0.5) / math.sqrt(2)))
_LOW, _SPAN = 2 * _CDF(0.0) - 1, 2 * (_CDF(1.0) - _CDF(0.0))
_B = f"({2 / (math.pi * 0.147)!r}::DOUBLE + l / 2)"


@query(
    EV + f", Q AS (SELECT src, dst, ({fold_sql('eh', salted('weight'))} + 0.5::DOUBLE) / {float(ONE)}::DOUBLE * {_SPAN!r}::DOUBLE + {_LOW!r}::DOUBLE AS x FROM E), Y AS (SELECT *, ln(1 - x * x) AS l FROM Q) "
    f"SELECT src, dst, round(greatest(0, least(1, 0.5::DOUBLE + {math.sqrt(2)!r}::DOUBLE * sign(x) * sqrt(sqrt({_B} * {_B} - l / 0.147::DOUBLE) - {_B}))), 4) AS weight FROM Y"
)
def weights_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.truncated_normal(ev(spark, sf_dir, None).edges).select("src", "dst", F.round("weight", 4).alias("weight"))


@query(EV + " SELECT src, dst, thr FROM E")
def weights_wc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).edges.select("src", "dst", "thr")


@query(EV + f", U AS (SELECT src, dst, {fold_sql('eh', salted('weight'))} / {float(ONE)} AS w FROM E), T AS (SELECT dst, sum(w) AS t FROM U GROUP BY dst) SELECT src, dst, round(w / (t + {fold_sql(salted('rest'), 'dst')} / {float(ONE)}), 9) AS weight FROM U JOIN T USING (dst)")
def lt_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = weights.lt_normalize(weights.uniform(ev(spark, sf_dir, None).edges))
    return edges.select("src", "dst", F.round("weight", 9).alias("weight"))


@query(EV + f" SELECT src, dst, floor({fold_sql('eh', salted('weight'))} / {float(ONE)} * 255)::INTEGER AS wq FROM E")
def weights_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.quantize(weights.uniform(ev(spark, sf_dir, None).edges), 8).select("src", "dst", "wq")


@query(EV + " SELECT orig, orig AS back FROM V")
def id_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ev(spark, sf_dir, None)
    ids = g.vertices.select("orig", F.col("orig").alias("back"))
    return g.to_original(g.to_dense(ids, "back"), "back").select("orig", "back")


COMMUNITY = ", C AS (SELECT vid, orig % 4 AS community FROM V), X AS (SELECT a.community, src, dst FROM E JOIN C a ON a.vid = src JOIN C b ON b.vid = dst WHERE a.community = b.community)"


@query(EV + COMMUNITY + " SELECT community, count(DISTINCT v) AS vertices FROM (SELECT community, src AS v FROM X UNION ALL SELECT community, dst FROM X) GROUP BY community")
def community_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ev(spark, sf_dir, None)
    inside = g.communities(g.vertices.select("orig", (F.col("orig") % 4).alias("community")))
    return inside.groupBy("community").agg((F.max(F.greatest("src", "dst")) + 1).alias("vertices"))


@query(EV + COMMUNITY + " SELECT community, count(*) AS edges FROM X GROUP BY community")
def community_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ev(spark, sf_dir, None)
    return g.communities(g.vertices.select("orig", (F.col("orig") % 4).alias("community"))).groupBy("community").agg(F.count("*").alias("edges"))


@query(EV + " SELECT vid AS orig, orig % 4 AS community FROM V")
def community_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as a text list, and read again in splits."""
    path = fresh_path(spark, "communities")
    ev(spark, sf_dir, None).vertices.orderBy("vid").select((F.col("orig") % 4).cast("string")).write.text(path)
    return stored.read_communities(spark, path, first=0)


@query(EV + ROOTS + " SELECT sid, v FROM R")
def rrr_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, 0, THETA).select("sid", root_of(F.col("sh"), ev(spark, sf_dir, None).n).alias("v"))


@query(EV + RRR + " SELECT sid, v FROM rrr")
def rrr_members_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rrr_sets(ev(spark, sf_dir), THETA)


@query(EV + RRR + " SELECT sid, count(*) AS size FROM rrr GROUP BY sid")
def rrr_sizes_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rrr_sets(ev(spark, sf_dir), THETA).groupBy("sid").agg(F.count("*").alias("size"))


@query(EV + RRR + " SELECT sid, count(*) AS size FROM rrr GROUP BY sid")
def rrr_frontier_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distributed strategy, whatever the graph's size."""
    return rrr_sets(ev(spark, sf_dir), THETA, strategy="frontier").groupBy("sid").agg(F.count("*").alias("size"))


@query(EV + RRR + " SELECT sid, v FROM rrr")
def rrr_bits_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 samples in one pass over the edges a hop."""
    return rrr_sets(ev(spark, sf_dir), THETA, strategy="bits")


HALF = RRR.replace("c < thr", f"c < {ONE // 2}")


@query(EV + HALF + " SELECT sid, count(*) AS size FROM rrr GROUP BY sid")
def rrr_sizes_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight 1/2 on every edge, where samples hold most of the graph."""
    g = ev(spark, sf_dir, None)
    return rrr_sets(g.with_weights(weights.constant(g.edges, 0.5)), THETA).groupBy("sid").agg(F.count("*").alias("size"))


@query(EV + RRR_LT + " SELECT sid, count(*) AS size FROM rrr GROUP BY sid")
def rrr_sizes_lt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rrr_sets(ev(spark, sf_dir), THETA, "LT").groupBy("sid").agg(F.count("*").alias("size"))


@query(EV + RRR_LT + " SELECT sid, count(*) AS size FROM rrr GROUP BY sid")
def rrr_frontier_lt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rrr_sets(ev(spark, sf_dir), THETA, "LT", strategy="frontier").groupBy("sid").agg(F.count("*").alias("size"))


@query(EV + RRR + " SELECT sid, v FROM rrr")
def rrr_blocks_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacency in blocks, samples in words: the strategy for graphs of any size."""
    return rrr_sets(ev(spark, sf_dir), THETA, strategy="blocks")


def _race_sql(worlds: str) -> str:
    """RP: sid, v, parent of the exponential races of the worlds S."""
    time = lambda coin, weight: f"-ln(({coin} + 0.5::DOUBLE) / {float(ONE)}::DOUBLE) / ({weight})"
    return f""", RT AS (SELECT dst, greatest({ONE} - sum(thr), 0)::BIGINT AS rest FROM E GROUP BY dst
), RX AS (
  SELECT sid, dst AS v, src AS parent, {time("c", "thr")} AS t FROM (SELECT sid, dst, src, thr, {fold_sql("eh", "sh")} AS c FROM E, {worlds} WHERE thr > 0)
  UNION ALL
  SELECT sid, vid, NULL, {time("c", "rest")} FROM (SELECT sid, vid, rest, {fold_sql("vh", "sh")} AS c FROM P JOIN RT ON dst = vid, {worlds} WHERE rest > 0)
), RP AS MATERIALIZED (SELECT sid, v, parent FROM (SELECT *, row_number() OVER (PARTITION BY sid, v ORDER BY t, parent) AS r FROM RX) WHERE r = 1 AND parent IS NOT NULL)"""


RRR_RACE = ROOTS + VHASH + _race_sql("S") + ", rrr AS (SELECT sid, v FROM R UNION SELECT rrr.sid, parent FROM rrr JOIN RP ON RP.sid = rrr.sid AND RP.v = rrr.v)"


@query(EV + RRR_RACE + " SELECT sid, v FROM rrr")
def rrr_race_lt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live parents by exponential races, on the cluster: an aggregate, without an order of a vertex's in-edges."""
    return rrr_sets(ev(spark, sf_dir), THETA, "LTR", strategy="frontier")


@query(EV + RRR_RACE + " SELECT sid, v FROM rrr")
def rrr_race_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rrr_sets(ev(spark, sf_dir), THETA, "LTR")


@query(EV + _samples_sql("S", WORLDS, "sample") + VHASH + _race_sql("S") + " SELECT sid, v, parent FROM RP")
def lt_race_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_parents(ev(spark, sf_dir), WORLDS, race=True)


@query(EV + _samples_sql("S", WORLDS, "sample") + f" SELECT sid, count(*) AS edges FROM (SELECT sid, thr, {fold_sql('eh', 'sh')} AS c FROM E, S) WHERE c < thr GROUP BY sid")
def live_edges_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_edges(ev(spark, sf_dir), WORLDS).groupBy("sid").agg(F.count("*").alias("edges"))


@query(EV + _samples_sql("S", WORLDS, "sample") + f" SELECT sid, count(DISTINCT dst) AS heads FROM (SELECT sid, dst, thr, {fold_sql('eh', 'sh')} AS c FROM E, S) WHERE c < thr GROUP BY sid")
def bitmask_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of live edges, kept as bitmaps of 32 KiB blocks and counted by their bits."""
    heads = live_edges(ev(spark, sf_dir), WORLDS).withColumn("block", F.bitmap_bucket_number("dst"))
    masks = heads.groupBy("sid", "block").agg(F.bitmap_construct_agg(F.bitmap_bit_position("dst")).alias("mask"))
    return masks.groupBy("sid").agg(F.sum(F.bitmap_count("mask")).alias("heads"))


@query(EV + _samples_sql("S", WORLDS, "sample") + VHASH + f" SELECT sid, v, src AS parent FROM (SELECT sid, vid AS v, {fold_sql('vh', 'sh')} AS c FROM P, S) JOIN I ON dst = v WHERE c < hi AND c >= hi - thr")
def lt_live_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_parents(ev(spark, sf_dir), WORLDS)


WIDTH = ", D AS (SELECT dst, count(*) AS d FROM E GROUP BY dst), W AS (SELECT sid, sum(coalesce(d, 0))::BIGINT AS width FROM rrr LEFT JOIN D ON dst = v GROUP BY sid)"


@query(EV + RRR + WIDTH + " SELECT sid, width FROM W")
def rrr_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ev(spark, sf_dir)
    return influence.widths(g, rrr_sets(g, THETA))


@query(EV + RRR + WIDTH + " SELECT round(avg(1 - pow(1 - width / (SELECT count(*) FROM E), 3)), 9) AS kappa FROM W")
def kpt_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ev(spark, sf_dir)
    return spark.createDataFrame([(influence.kpt_mean(g, rrr_sets(g, THETA), 3),)], "kappa double").select(F.round("kappa", 9).alias("kappa"))


def _greedy_sql(k: int) -> str:
    out = ", L AS MATERIALIZED (SELECT sid, v FROM rrr)"
    for i in range(1, k + 1):
        rest = " AND ".join(f"sid NOT IN (SELECT sid FROM L WHERE v = (SELECT v FROM g{j}))" for j in range(1, i))
        out += f", g{i} AS MATERIALIZED (SELECT {i}::BIGINT AS rank, v, count(*) AS gain FROM L{' WHERE ' + rest if rest else ''} GROUP BY v ORDER BY gain DESC, v LIMIT 1)"
    return out + " " + " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(1, k + 1))


@query(EV + RRR + _greedy_sql(3))
def max_coverage_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = max_coverage(rrr_sets(ev(spark, sf_dir), THETA), 3, THETA)
    return spark.createDataFrame(list(zip(range(1, 4), got.seeds, got.gains)), "rank long, v long, gain long")


@query(EV + RRR + _greedy_sql(3))
def max_coverage_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rounds on the cluster: counts are kept and lowered."""
    got = max_coverage(rrr_sets(ev(spark, sf_dir), THETA), 3, THETA, strategy="distributed", local_entries=0)
    return spark.createDataFrame(list(zip(range(1, 4), got.seeds, got.gains)), "rank long, v long, gain long")


@query(EV + RRR + _greedy_sql(6))
def max_coverage_handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds on the cluster until half of the members are covered, then on the driver."""
    sets = checkpoint(rrr_sets(ev(spark, sf_dir), THETA))
    got = max_coverage(sets, 6, THETA, strategy="distributed", local_entries=sets.count() // 2)
    return spark.createDataFrame(list(zip(range(1, 7), got.seeds, got.gains)), "rank long, v long, gain long")


def _parts_sql(parts: int, k: int) -> str:
    out = ", L AS MATERIALIZED (SELECT sid, v FROM rrr)"
    for p in range(parts):
        for i in range(1, k + 1):
            rest = "".join(f" AND sid NOT IN (SELECT sid FROM L WHERE v = (SELECT v FROM p{p}_{j}))" for j in range(1, i))
            out += f", p{p}_{i} AS MATERIALIZED (SELECT {p}::BIGINT AS part, {i} AS rank, v, count(*) AS gain FROM L WHERE sid % {parts} = {p}{rest} GROUP BY v ORDER BY gain DESC, v LIMIT 1)"
    return out + " SELECT part, rank, v, gain FROM (" + " UNION ALL ".join(f"SELECT * FROM p{p}_{i}" for p in range(parts) for i in range(1, k + 1)) + ")"


def _parted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sets = rrr_sets(ev(spark, sf_dir), THETA).withColumn("part", F.col("sid") % 4)
    return sets.select("part", "sid", "v"), spark.range(4).select(F.col("id").alias("part"), F.lit(3).alias("k"))


@query(EV + RRR + _parts_sql(4, 3))
def community_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy rounds of all parts together, each on its own sets."""
    sets, k = _parted(spark, sf_dir)
    return greedy_grouped(sets, k, 3)


@query(EV + RRR + _parts_sql(4, 3) + " ORDER BY gain * (part + 1) DESC, v LIMIT 5")
def community_greedy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all parts by weighted gain; parts whose gains fall below them stop early."""
    sets, k = _parted(spark, sf_dir)
    weight = k.select("part", (F.col("part") + 1).cast("double").alias("scale"))
    best = greedy_grouped(sets, k, 3, weight, 5)
    return best.orderBy(F.desc(F.col("gain") * (F.col("part") + 1)), "v").limit(5)


@query(EV + RRR + " SELECT count(DISTINCT sid) AS covered FROM rrr WHERE v IN (0, 1, 2)")
def seed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(covered_by(rrr_sets(ev(spark, sf_dir), THETA), [0, 1, 2]),)], "covered long")


@query(EV + RRR + ", L AS MATERIALIZED (SELECT sid, v FROM rrr) SELECT v, count(*) AS covered FROM L WHERE sid NOT IN (SELECT sid FROM L WHERE v = 0) GROUP BY v")
def coverage_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(uncovered_by(rrr_sets(ev(spark, sf_dir), THETA), 0))


@query(EV + RRR + ", L AS MATERIALIZED (SELECT sid, v FROM rrr) SELECT sid IN (SELECT sid FROM L WHERE v = 0) AS holds, count(DISTINCT sid) AS sets FROM L GROUP BY 1")
def partition_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition(rrr_sets(ev(spark, sf_dir), THETA), 0).groupBy("holds").agg(F.count("*").alias("sets"))


@query(EV + _samples_sql("S", REPLICAS, "simulation") + f""", hop AS (
  SELECT sid, sh, v, 0 AS h FROM S, (VALUES (0), (1), (2)) t(v)
  UNION
  SELECT sid, sh, dst, h + 1 FROM (SELECT hop.sid, hop.sh, E.dst, h, thr, {fold_sql('eh', 'hop.sh')} AS c FROM hop JOIN E ON E.src = hop.v WHERE h < (SELECT n FROM N) AND h < 200) WHERE c < thr
), first AS (SELECT sid, v, min(h) AS h FROM hop GROUP BY ALL) SELECT sid AS replica, count(*) AS activated, (max(h) + 1)::BIGINT AS rounds FROM first GROUP BY sid""".replace("h < (SELECT n FROM N) AND h < 200", "h < 60"))
def sim_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate(ev(spark, sf_dir), [0, 1, 2], REPLICAS)


def _lt_rounds_sql(seeds: list[int], most: int = 40) -> str:
    """Rounds one after the other: a vertex joins when the weights of its active tails reach its coin. The graph's activity ends long before the last one."""
    out = VHASH + f", a0 AS MATERIALIZED (SELECT sid, sh, v, 0 AS h FROM S, (VALUES {', '.join(f'({s})' for s in seeds)}) t(v))"
    for i in range(1, most + 1):
        out += f""", a{i} AS MATERIALIZED (SELECT * FROM a{i - 1} UNION ALL SELECT sid, sh, dst, {i} FROM (
  SELECT t.*, {fold_sql('vh', 't.sh')} AS c FROM (SELECT sid, sh, dst, sum(thr) AS w FROM a{i - 1} JOIN E ON src = v GROUP BY sid, sh, dst) t
  JOIN P ON vid = dst LEFT JOIN a{i - 1} o ON o.sid = t.sid AND o.v = t.dst WHERE o.v IS NULL) WHERE w >= c)"""
    return out + f" SELECT sid AS replica, count(*) AS activated, (max(h) + 1)::BIGINT AS rounds FROM a{most} GROUP BY sid"


@query(EV + _samples_sql("S", REPLICAS, "simulation") + _lt_rounds_sql([0, 1, 2]))
def sim_lt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate(ev(spark, sf_dir), [0, 1, 2], REPLICAS, "LT")


CLOSURE = _samples_sql("S", 4, "sample") + f""", T AS (
  SELECT sid, sh, vid AS o, vid AS v FROM S, V
  UNION
  SELECT sid, sh, o, dst FROM (SELECT T.sid, T.sh, T.o, E.dst, thr, {fold_sql('eh', 'T.sh')} AS c FROM T JOIN E ON E.src = T.v) WHERE c < thr
), Z AS MATERIALIZED (SELECT sid, o, v FROM T)"""


@query(EV + CLOSURE + ", B AS MATERIALIZED (SELECT DISTINCT sid, v FROM Z WHERE o = 0) SELECT o AS v, ((SELECT count(*) FROM B) + count(*) FILTER (b IS NULL))::BIGINT AS total FROM (SELECT Z.o, B.v AS b FROM Z LEFT JOIN B USING (sid, v)) WHERE o <> 0 GROUP BY o")
def hc_marginal_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return influence.marginal_spread(ev(spark, sf_dir), [0], 4)


@query(EV + CLOSURE + """, h1 AS MATERIALIZED (SELECT o FROM Z GROUP BY o ORDER BY count(*) DESC, o LIMIT 1),
B AS MATERIALIZED (SELECT DISTINCT sid, v FROM Z WHERE o = (SELECT o FROM h1)),
h2 AS (SELECT o FROM (SELECT Z.o, B.v AS b FROM Z LEFT JOIN B USING (sid, v)) WHERE o <> (SELECT o FROM h1) GROUP BY o ORDER BY count(*) FILTER (b IS NULL) DESC, o LIMIT 1)
SELECT 1::BIGINT AS rank, orig AS vertex FROM h1 JOIN V ON vid = o UNION ALL SELECT 2, orig FROM h2 JOIN V ON vid = o""")
def hc_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ev(spark, sf_dir)
    return influence.as_frame(g, influence.hill_climb(g, 2, 4))


CLOSURE_LT = _samples_sql("S", 4, "sample") + VHASH + f""", T AS (
  SELECT sid, sh, vid AS o, vid AS v FROM S, V
  UNION
  SELECT sid, sh, o, dst FROM (SELECT T.sid, T.sh, T.o, I.dst, I.hi, I.thr, {fold_sql('vh', 'T.sh')} AS c FROM T JOIN I ON I.src = T.v JOIN P ON vid = I.dst) WHERE c < hi AND c >= hi - thr
), Z AS MATERIALIZED (SELECT sid, o, v FROM T)"""


@query(ORACLES["hc_k2"].replace(CLOSURE, CLOSURE_LT))
def hc_lt_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ev(spark, sf_dir)
    return influence.as_frame(g, influence.hill_climb(g, 2, 4, model="LT"))


@query(EV + RRR + " SELECT sid, count(*) AS size FROM rrr GROUP BY sid")
def rrr_store_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the sets are stored; the store is opened again and grows by the other half, which is stored as well."""
    g, path = ev(spark, sf_dir), fresh_path(spark, "rrr-store")
    stored.store_sets(stored.reload_sets(g, path, "IC").grow(THETA // 2), path)
    again = stored.reload_sets(g, path, "IC")
    stored.store_sets(again.grow(THETA), path, THETA // 2)
    return stored.reload_sets(g, path, "IC").rows.groupBy("sid").agg(F.count("*").alias("size"))


U8 = ", QE AS MATERIALIZED (SELECT src, dst, k, eh, (floor(1.0::DOUBLE / count(*) OVER (PARTITION BY dst) * 255)::BIGINT + 1) * 16777216 AS thr FROM E)"


@query(EV + U8 + RRR.replace("JOIN E ON E.dst", "JOIN QE ON QE.dst").replace(" E.src", " QE.src") + " SELECT sid, count(*) AS size FROM rrr GROUP BY sid")
def rrr_sizes_ic_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights stored as integers of 8 bits, read again and sampled from."""
    path = fresh_path(spark, "graph-u8")
    stored.write_graph(ev(spark, sf_dir), path, bits=8)
    return rrr_sets(stored.reload_graph(spark, path), THETA).groupBy("sid").agg(F.count("*").alias("size"))


def _drawn_sql(name: str, stream: str, count: str, model: str = "IC") -> str:
    """``name``: sid, v of the first ``count`` (an expression) sets of a stream."""
    step = (
        f"SELECT t.sid, t.sh, E.src, thr AS hi, thr, {fold_sql('eh', 't.sh')} AS c FROM {name}_x t JOIN E ON E.dst = t.v"
        if model == "IC"
        else f"SELECT t.sid, t.sh, I.src, I.hi, I.thr, {fold_sql('vh', 't.sh')} AS c FROM {name}_x t JOIN P ON vid = t.v JOIN I ON I.dst = t.v"
    )
    return f""", {name}_s AS MATERIALIZED (SELECT sid, {fold_sql(salted(stream), "sid")} AS sh FROM (SELECT unnest(range(({count})::BIGINT)) AS sid)
), {name}_x AS (
  SELECT sid, sh, ({fold_sql(salted("root"), "sh")} % (SELECT n FROM N))::BIGINT AS v FROM {name}_s
  UNION
  SELECT sid, sh, src FROM ({step}) WHERE c < hi AND c >= hi - thr
), {name} AS MATERIALIZED (SELECT sid, v FROM {name}_x)"""


def _picks_sql(name: str, source: str, count: str, k: int) -> str:
    """``name``: rank, v, gain of the greedy over the first ``count`` sets of ``source``."""
    out = ""
    for i in range(1, k + 1):
        rest = "".join(f" AND sid NOT IN (SELECT sid FROM {source} WHERE v = (SELECT v FROM {name}{j}))" for j in range(1, i))
        out += f", {name}{i} AS MATERIALIZED (SELECT {i}::BIGINT AS rank, v, count(*) AS gain FROM {source} WHERE sid < ({count}){rest} GROUP BY v ORDER BY gain DESC, v LIMIT 1)"
    return out + f", {name} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM {name}{i}" for i in range(1, k + 1)) + ")"


_LB = lambda n, k: f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"
_N, _K = 1500, 10
_TAIL = "ln(6 / 0.05)"
_HALF = f"(2 * pow((1 - exp(-1)) * sqrt({_TAIL}) + sqrt((1 - exp(-1)) * ({_LB(_N, _K)} + {_TAIL})), 2))"
_SEEDS, _EPS, _A = 5, 0.5, "(1 - exp(-1))"
_CHOOSE = "(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"
_FINAL = " SELECT rank, orig AS vertex FROM {} JOIN V ON vid = v"


def _imm_sql(model: str, guesses: int = 9) -> str:
    """Guesses 2^-x of the share that the best seeds cover, with as many sets as each needs; the first that holds gives the bound."""
    out = EV + VHASH + f""", Q AS MATERIALIZED (
  SELECT *, (2 + 2.0::DOUBLE / 3 * e) * (l * ln(n) + lb + ln(log2(n))) AS work FROM (
    SELECT n, 1 + 1 / log2(n) AS l, {math.sqrt(2)!r}::DOUBLE * {_EPS} AS e, greatest(floor(log2(n)), 2) - 1 AS last, {_CHOOSE.format(n="n", k=f"least({_SEEDS}, n // 2)")} AS lb FROM N)
), TX AS MATERIALIZED (SELECT x, floor(work * pow(2, x) / (e * e))::BIGINT AS theta FROM Q, range(1, {guesses + 1}) r(x) WHERE x <= last)"""
    out += _drawn_sql("D", "sample", "SELECT max(theta) FROM TX", model)
    for x in range(1, guesses + 1):
        out += _picks_sql(f"d{x}_", "D", f"SELECT theta FROM TX WHERE x = {x}", _SEEDS)
    tried = " UNION ALL ".join(f"SELECT {x} AS x, sum(gain) AS covered FROM d{x}_" for x in range(1, guesses + 1))
    out += f""", FX AS (SELECT x, theta, covered / theta AS f FROM ({tried}) JOIN TX USING (x) WHERE covered / theta >= pow(2, -x) ORDER BY x LIMIT 1
), TH AS MATERIALIZED (
  SELECT coalesce(floor(2 * n * pow({_A} * sqrt(l * ln(n) + ln(2)) + sqrt({_A} * (lb + l * ln(n) + ln(2))), 2) / {_EPS * _EPS} / (n * f / (1 + e))), (SELECT max(theta) FROM TX))::BIGINT AS theta FROM Q LEFT JOIN FX ON true
)"""
    return out + _drawn_sql("Z", "sample", "SELECT theta FROM TH", model) + _picks_sql("pick", "Z", "SELECT theta FROM TH", _SEEDS) + _FINAL.format("pick")


def _opimc_sql(turns: int = 6) -> str:
    """Two streams of sets that double until the bounds of both meet."""
    out = EV + f""", Q AS MATERIALIZED (
  SELECT *, CASE WHEN most > first THEN greatest(ceil(log2(most / first)), 1) ELSE 1 END AS rounds FROM (
    SELECT n, ceil(half) AS first, ceil(n * half / {_EPS * _EPS * _SEEDS}) AS most FROM (SELECT n, 2 * pow({_A} * sqrt({_TAIL}) + sqrt({_A} * ({_CHOOSE.format(n="n", k=_SEEDS)} + {_TAIL})), 2) AS half FROM N))
), QD AS MATERIALIZED (SELECT *, ln(3 * rounds / 0.05) AS a FROM Q)"""
    out += _drawn_sql("D", "r1", f"SELECT first * {2 ** (turns - 1)} FROM QD") + _drawn_sql("C", "r2", f"SELECT first * {2 ** (turns - 1)} FROM QD")
    rows = []
    for t in range(1, turns + 1):
        theta = f"SELECT first * {2 ** (t - 1)} FROM QD"
        out += _picks_sql(f"o{t}_", "D", theta, _SEEDS)
        covered = f"(SELECT count(DISTINCT sid) FROM C WHERE sid < ({theta}) AND v IN (SELECT v FROM o{t}_))"
        alpha = f"(pow(sqrt({covered} + 2 * a / 9) - sqrt(a / 2), 2) - a / 18) / pow(sqrt((SELECT sum(gain) FROM o{t}_) / {_A} + a / 2) + sqrt(a / 2), 2)"
        rows.append(f"SELECT {t} AS t, {alpha} AS alpha, rounds FROM QD WHERE {t} <= rounds")
    chosen = " UNION ALL ".join(f"SELECT rank, v FROM o{t}_ WHERE (SELECT t FROM OT) = {t}" for t in range(1, turns + 1))
    return out + f", OT AS MATERIALIZED (SELECT t FROM ({' UNION ALL '.join(rows)}) WHERE alpha >= {_A} - {_EPS} OR t = rounds ORDER BY t LIMIT 1), o AS ({chosen})" + _FINAL.format("o")


def _tim_sql(most: int, guesses: int = 9) -> str:
    """The mean share of edges into a set estimates the spread of k seeds; its guess is refined by a greedy and fresh sets."""
    e = 5 * (_EPS**2 / (_SEEDS + 1)) ** (1 / 3)
    out = EV + f""", Q AS MATERIALIZED (SELECT n, greatest(floor(log2(n)), 2) - 1 AS last FROM N
), TX AS MATERIALIZED (SELECT i, floor((6 * ln(n) + 6 * ln(log2(n))) * pow(2, i))::BIGINT AS c FROM Q, range(1, {guesses + 1}) r(i) WHERE i <= last)"""
    out += _drawn_sql("D", "r1", "SELECT max(c) FROM TX")
    out += f""", DG AS (SELECT dst, count(*) AS d FROM E GROUP BY dst
), KW AS MATERIALIZED (SELECT sid, 1 - pow(1 - sum(coalesce(d, 0)) / (SELECT count(*) FROM E), {_SEEDS}) AS share FROM D LEFT JOIN DG ON dst = v GROUP BY sid
), KM AS MATERIALIZED (SELECT i, c, avg(share) AS mean FROM TX JOIN KW ON sid < c GROUP BY i, c
), K1 AS MATERIALIZED (
  SELECT coalesce((SELECT greatest(n * mean / 2, 1) FROM KM, Q WHERE mean > pow(2, -i) ORDER BY i LIMIT 1), 1.0) AS kpt, coalesce((SELECT c FROM KM WHERE mean > pow(2, -i) ORDER BY i LIMIT 1), (SELECT max(c) FROM TX)) AS drawn
), RF AS MATERIALIZED (SELECT least({most}, ceil((2 + {e!r}::DOUBLE) * n * ln(n) / ({e!r}::DOUBLE * {e!r}::DOUBLE * kpt)))::BIGINT AS refine FROM Q, K1)"""
    out += _picks_sql("guess", "D", "SELECT drawn FROM K1", _SEEDS) + _drawn_sql("C", "r2", "SELECT refine FROM RF")
    out += f""", KP AS MATERIALIZED (SELECT greatest(kpt, (SELECT count(DISTINCT sid) FROM C WHERE v IN (SELECT v FROM guess)) / refine * n / (1 + {e!r}::DOUBLE)) AS plus FROM K1, RF, Q
), TH AS MATERIALIZED (SELECT least({most}, ceil((8 + 2 * {_EPS}) * n * (ln(n) + {_CHOOSE.format(n="n", k=_SEEDS)} + ln(2)) / {_EPS * _EPS} / plus))::BIGINT AS theta FROM KP, Q)"""
    return out + _drawn_sql("Z", "sample", "SELECT theta FROM TH") + _picks_sql("pick", "Z", "SELECT theta FROM TH", _SEEDS) + _FINAL.format("pick")


@query(_imm_sql("IC"))
def imm(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ev(spark, sf_dir)
    return influence.as_frame(g, influence.imm(g, 5, 0.5))


@query(_imm_sql("LT"))
def imm_lt(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ev(spark, sf_dir)
    return influence.as_frame(g, influence.imm(g, 5, 0.5, "LT"))


@query(_opimc_sql())
def opimc(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ev(spark, sf_dir)
    return influence.as_frame(g, influence.opimc(g, 5, 0.5))


@query(_tim_sql(200_000))
def tim(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ev(spark, sf_dir)
    return influence.as_frame(g, influence.tim(g, 5, 0.5, max_sets=200_000))


@query(EV + " SELECT src, dst, floor(1.0::DOUBLE / count(*) OVER (PARTITION BY dst) * 255)::INTEGER AS wq FROM E")
def binary_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published binary layout, written and read in ranges; on a file system that all executors share."""
    path = fresh_path(spark, "graph").removeprefix("file://")
    binary.write_binary(ev(spark, sf_dir).transpose(), path, 8)
    return binary.read_binary(spark, path, "backward", 8).transpose().edges.select("src", "dst", "wq")


@query()
def community_imm(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ev(spark, sf_dir)
    return influence.community_imm(g, g.vertices.select("orig", (F.col("orig") % 4).alias("community")), 5, max_sets=50_000)


@query(
    f"SELECT round({_LB(_N, _K)}, 6) AS log_binomial, ceil({_HALF})::BIGINT AS opim_first, ceil({_N} * {_HALF} / (0.25 * {_K}))::BIGINT AS opim_most, "
    f"floor(2 * {_N} * pow((1 - exp(-1)) * sqrt(ln({_N}) + ln(2)) + sqrt((1 - exp(-1)) * ({_LB(_N, _K)} + ln({_N}) + ln(2))), 2) / 0.25 / 100)::BIGINT AS imm_theta, "
    f"floor((2 + 2.0 / 3 * 0.5) * (ln({_N}) + {_LB(_N, _K)} + ln(log2({_N}))) * 8 / 0.25)::BIGINT AS imm_theta_prime"
)
def sample_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, most = bounds.opim_limits(0.5, 0.05, _K, _N)
    row = (round(bounds.log_binomial(_N, _K), 6), first, most, bounds.imm_theta(0.5, 1, _K, 100, _N), bounds.imm_theta_prime(3, 0.5, 1, _K, _N))
    return spark.createDataFrame([row], "log_binomial double, opim_first long, opim_most long, imm_theta long, imm_theta_prime long")


_WS = lambda purpose: f"({fold_sql(fold_sql(fold_int(77, purpose), 'id'), 'j')}) / {float(ONE)}"


@query(f"SELECT id AS src, CASE WHEN {_WS(2)} < 0.5 THEN (id + 1 + floor({_WS(3)} * 255)) % 256 ELSE (id + j) % 256 END::BIGINT AS dst FROM range(256) a(id), range(1, 9) b(j)")
def watts_strogatz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.watts_strogatz(spark, 256)


_U = lambda purpose, a, b: f"({fold_sql(fold_sql(fold_int(77, purpose), a), b)}) / {float(ONE)}::DOUBLE"


@query(
    f"""WITH RECURSIVE L AS (
  SELECT id, 0::BIGINT AS s, 0 AS i, {_U(1, 'id', 0)} AS u FROM range(4096) r(id)
  UNION ALL
  SELECT id, s * 2 + (u >= 0.57 + 0.19)::BIGINT, i + 1, {_U(1, 'id', 'i + 1')} FROM L WHERE i < 8
) SELECT s AS src, count(*) AS degree FROM L WHERE i = 8 GROUP BY s"""
)
def rmat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.rmat(spark, 8).groupBy("src").agg(F.count("*").alias("degree"))


@query(
    f"""WITH RECURSIVE L AS (
  SELECT id, 0::BIGINT AS v, id AS t, false AS done, 0 AS i FROM range(2048) r(id)
  UNION ALL
  SELECT id, CASE WHEN stop THEN v ELSE pick // 2 // 8 END, CASE WHEN stop THEN t ELSE pick // 2 END, stop OR pick % 2 = 0, i + 1
  FROM (SELECT *, done OR t <= 0 AS stop, floor({fold_sql(fold_int(77, 4), 't')} / {float(ONE)}::DOUBLE * t * 2)::BIGINT AS pick FROM L WHERE i < 64)
) SELECT v AS dst, count(*) AS degree FROM L WHERE i = 64 GROUP BY v"""
)
def barabasi_albert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.barabasi_albert(spark, 256).groupBy("dst").agg(F.count("*").alias("degree"))


@query(
    f"SELECT id AS src, (CASE WHEN {_U(5, 'id', 'j')} < 0.5 THEN floor({_U(7, 'id', 'j')} * 256) ELSE least(id // 16 * 16 + floor({_U(6, 'id', 'j')} * 16), 255) END)::BIGINT AS dst FROM range(256) a(id), range(1, 7) b(j)"
)
def planted_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.planted(spark, 256)




@query()
def lfr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.lfr(spark, 1024)
