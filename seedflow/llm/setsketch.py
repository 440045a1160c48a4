"""Near-duplicate texts by SetSketch registers: banded, estimated by likelihood, and verified.

A text is the set of its ``SHINGLE``-word shingles (64-bit hashes). Its sketch has ``REGISTERS`` registers of
two bytes. Every shingle gives each register an exponentially distributed value; they are drawn in ascending
order, by spacings, to registers in a pseudorandom order of the shingle, until they can lower no register
any more. A register is the least value of all shingles, as its power of ``BASE``, truncated to two
bytes. The larger power of two sketches is the sketch of the union (``merged``), and two registers are equal
with a probability of the sets' Jaccard similarity, or a little more.

Join: equal sets are merged first. Runs of ``BAND`` registers are hashed to buckets. A pair of one bucket is
compared by its counts of larger, smaller and equal registers: given both sizes, these have a likelihood for
every similarity, and the pair is a candidate unless the likelihood at ``LEAST`` is below the greatest one by
``DOUBT`` standard deviations. Verification begins with an exact bound that needs no sets: the sets' bitmaps of
parities (``verify``) differ in at most as many bits as the sets in shingles. What passes is verified by the whole
sets; a pair goes there from its first common band only. A pair of similarity 0.85 shares no
band with probability (1 - 0.85^5)^25 = 4e-7, and is dropped by its estimate with one of about 1e-9.

Rounds: (1) every text with the text of least key in each bucket, which is linear in rows; (2) between texts
that are not linked yet, a spanning forest of the candidates, those of most equal registers first; (3) all
candidates between components that are still apart. Buckets of one component are dropped by two aggregates
before their sketches are read. Small buckets are dealt to shards; one of more than ``MOST`` texts is cut into
blocks, and only texts outside its largest component meet every block, so a group of copies that is linked
already costs a row a text. Components: star contraction, of which the least id is taken.

Defined cases: a text without words (null, too) has the empty set and is linked with nothing, copies of it
included; fewer words than a shingle are one shingle; equal rows give equal results; null ids are not least
unless all ids of a component are null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import verify
from .common import checkpoint, checkpoint_table, join_hot, load
from .simhash import Linked, components

SHINGLE = 3
LEAST = (85, 100)
REGISTERS, BAND = 128, 5
BANDS = REGISTERS // BAND
BASE, RATE = 1.001, 20.0
TOP = (1 << 16) - 1
DOUBT = 6.0
SHARD, MOST = 8192, 4096
#: Texts a task in stages over pairs and edges, which are few, and the least number of these tasks.
TEXTS_A_TASK, TASKS = 25_000, 8
#: Pairs that are compared at a time, and texts that are sketched at a time.
PAIRS, TEXTS = 1 << 14, 256
BROADCAST_ROWS = 100_000


# -- sketches


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def sketches(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """One row of registers (uint16) for each set of hashes; of the empty set, zeros. ``registers``: a power of two."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    least = np.full(len(sets) * registers, np.inf)
    owner = np.repeat(np.arange(len(sets)), sizes)
    h = _mixed(np.concatenate([*sets, np.zeros(0, np.uint64)]) + np.uint64(0x9E3779B97F4A7C15))
    order = _mixed(h ^ np.uint64(0xD1B54A32D192ED03))
    # a quadratic permutation of the registers: any offset, an odd factor, an even square
    start, step, square = order.astype(np.int64) & registers - 1, order >> np.uint64(16) | np.uint64(1), order >> np.uint64(40) << np.uint64(1)
    step, square = (v.astype(np.int64) & registers - 1 for v in (step, square))
    x = np.zeros(len(h))
    for j in range(registers):
        if not len(h):
            break
        u = ((_mixed(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        x -= np.log(u) / (RATE * (registers - j))
        np.minimum.at(least, owner * registers + (start + step * j + square * (j * j % registers) & registers - 1), x)
        open_ = x < least.reshape(-1, registers).max(axis=1)[owner]
        if not open_.all():
            owner, h, x, start, step, square = (v[open_] for v in (owner, h, x, start, step, square))
    with np.errstate(divide="ignore"):
        power = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(power, 0, TOP).astype(np.uint16).reshape(-1, registers)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def log_likelihood(j: np.ndarray, na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Of similarity j for sets of these sizes, of which so many registers of the first are larger, smaller and equal."""
    u, v = na / (na + nb), nb / (na + nb)
    chance = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = chance(u - v * j), chance(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda n, x: np.where(n > 0, n * np.log(x), 0.0)
        return part(more, p) + part(less, q) + part(equal, np.maximum(1 - p - q, 0))


def estimate(na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray, steps: int = 32) -> np.ndarray:
    """The similarity of greatest likelihood, by golden-section search; the likelihood has one peak."""
    lo, hi, ratio = np.zeros(len(na)), np.minimum(na / nb, nb / na), (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        left = log_likelihood(a, na, nb, more, less, equal) > log_likelihood(b, na, nb, more, less, equal)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2


def plausible(x: np.ndarray, y: np.ndarray, na: np.ndarray, nb: np.ndarray, least: tuple[int, int] = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs of sketches may have the similarity, and their numbers of equal registers."""
    at, size = least[0] / least[1], x.shape[1]
    equal = (x == y).sum(axis=1)
    ok = verify.may(na, nb, least) & (equal >= size * at - DOUBT * np.sqrt(size * at * (1 - at)))
    i = np.flatnonzero(ok)
    if len(i):
        counts = (na[i].astype(float), nb[i].astype(float), (x[i] > y[i]).sum(axis=1), (x[i] < y[i]).sum(axis=1), equal[i])
        best = estimate(*counts)
        with np.errstate(invalid="ignore"):
            gap = 2 * (log_likelihood(best, *counts) - log_likelihood(np.minimum(at, np.minimum(counts[0] / counts[1], counts[1] / counts[0])), *counts))
        # registers that no similarity explains (of sets that nearly hold each other) are no evidence against it
        ok[i] = (best >= at) | ~(gap > DOUBT**2)
    return ok, equal


# -- texts


def nodes_of(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """id, th (a hash of the text), key, size, sketch and bits of the set of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                sets = [verify.shingles(t.as_py(), shingle) for t in b.column(2)]
                found = sketches(sets)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([verify.key_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in found], pa.binary()), pa.array([verify.bitmap(s) for s in sets], pa.binary())],
                    names=["id", "th", "key", "size", "sketch", "bits"],
                )

    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, th long, key long, size long, sketch binary, bits binary")


def sets_of(docs: DataFrame, text_col: str, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """key, set (sorted hashes as bytes) of the texts whose hashes ``th`` are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                got = [verify.shingles(t.as_py(), shingle) for t in b.column(0).slice(at, 64)]
                yield pa.RecordBatch.from_arrays([pa.array([verify.key_of(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], names=["key", "set"])

    texts = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    some = join_hot(texts, wanted, "th")
    return some.select("text").mapInArrow(run, "key long, set binary").dropDuplicates(["key"])


# -- candidates


def buckets(nodes: DataFrame) -> DataFrame:
    """bucket, band, key: a row for each band."""
    wide = 2 * BAND
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", k * wide + 1, wide)) for k in range(BANDS)])
    return nodes.select("key", F.posexplode(bands).alias("band", "bucket"))


def compared(nodes: DataFrame, pairs: DataFrame, least: tuple[int, int], tasks: int) -> DataFrame:
    """The pairs (u, v) of keys that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("a", "b"))
            p, q = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("p", "q"))
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            ok = plausible(x, y, na, nb, least)[0] & verify.close(p, q, na + nb, least)
            yield b.select(["u", "v"]).filter(pa.array(ok))

    side = lambda key, n, s, t: nodes.select(F.col("key").alias(key), F.col("size").alias(n), F.col("sketch").alias(s), F.col("bits").alias(t))
    one = checkpoint(join_hot(pairs, side("u", "na", "a", "p"), "u", broadcast=0).coalesce(tasks))
    return join_hot(one, side("v", "nb", "b", "q"), "v", broadcast=0).select("u", "v", "na", "nb", "a", "b", "p", "q").mapInArrow(run, "u long, v long")


def in_bucket_pairs(start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), j from start[i] to stop[i] - 1, at most ``PAIRS`` at a time."""
    for i in range(0, len(start), PAIRS):
        n = np.maximum(stop[i : i + PAIRS] - start[i : i + PAIRS], 0)
        ends, at = np.cumsum(n), 0
        for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            k = np.arange(at, min(at + PAIRS, int(ends[-1])))
            of = np.searchsorted(ends, k, side="right")
            yield i + of, start[i + of] + k - (ends[of] - n[of])


def forest(root: np.ndarray, i: np.ndarray, j: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, what connects all that they connect: each component's pair of most equal registers, again and again."""
    links, out = Linked(np.unique(root, return_index=True)[1][np.unique(root, return_inverse=True)[1]]), []
    while True:
        a, b = links.root[i], links.root[j]
        new = a != b
        if not new.any():
            break
        i, j, equal, a, b = i[new], j[new], equal[new], a[new], b[new]
        ends, pair = np.concatenate([a, b]), np.tile(np.arange(len(i)), 2)
        order = np.lexsort((pair, -equal[pair], ends))
        best = np.unique(pair[order][np.concatenate([[True], ends[order][1:] != ends[order][:-1]])])
        out.append(best_pairs := (i[best], j[best]))
        links.found(*best_pairs)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (i[:0], j[:0])


def members_of(entries: DataFrame, nodes: DataFrame, roots: DataFrame, shard: int, most: int, tasks: int) -> DataFrame:
    """Texts of the buckets that hold several components, with the task (k, block) they go to and whether they are probes there."""
    rooted = checkpoint(join_hot(entries, roots, "key", "u", "left").select("bucket", "band", "key", F.coalesce("root", "key").alias("root")))
    per = rooted.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("bucket", "n")
    open_ = checkpoint(join_hot(rooted, checkpoint(per.coalesce(tasks)), "bucket").coalesce(tasks))
    # a bucket's largest component only waits for probes
    large = open_.filter(F.col("n") > most).groupBy("bucket", "root").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.max(F.struct("m", "root")).alias("w"))
    large = checkpoint(large.select("bucket", F.col("w.root").alias("main")).coalesce(tasks))
    cut = join_hot(open_, large, "bucket", how="left").withColumn("blocks", F.ceil(F.col("n") / most).cast("int"))
    own = F.when(F.col("n") > most, F.pmod(F.xxhash64("key"), F.col("blocks"))).otherwise(0).cast("int")
    cut = cut.withColumn("own", own).withColumn("block", F.explode(F.when((F.col("n") > most) & (F.col("root") != F.col("main")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
    total = open_.count()
    small = F.pmod(F.xxhash64("bucket"), F.lit(max(total // shard, 1)))
    dealt = cut.select(
        F.when(F.col("n") > most, F.col("bucket")).otherwise(small).alias("k"), (F.col("n") > most).alias("heavy"), "block", "bucket", "band", "key", "root",
        # 0: waits; 1: probes, and waits here; 2: only probes here
        F.when(F.col("n") <= most, 1).when(F.col("root") == F.col("main"), 0).when(F.col("block") == F.col("own"), 1).otherwise(2).alias("role"),
    )
    return join_hot(dealt, nodes.select("key", "size", "sketch", "bits"), "key", broadcast=0)


def candidates(members: DataFrame, how: str, least: tuple[int, int]) -> DataFrame:
    """Distinct pairs (u, v), u > v, of ``members`` of different components that may be similar; ``how``: forest or all."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        bucket, band, name, root, size, role = (t.column(c).to_numpy() for c in ("bucket", "band", "key", "root", "size", "role"))
        order = np.lexsort((role == 2, bucket))  # texts that wait stand first
        bucket, band, name, root, size, role = (v[order] for v in (bucket, band, name, root, size, role))
        x = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(len(name), -1)[order]
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(name), -1)[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        size_of = np.diff(np.append(cut, len(bucket)))
        start = np.repeat(cut, size_of)
        stop = start + np.repeat(np.add.reduceat(role != 2, cut, dtype=np.int64), size_of)
        probes = np.flatnonzero(role > 0)
        found = []
        for p, j in in_bucket_pairs(start[probes], stop[probes]):
            i = probes[p]
            # a pair of two probes is met from both sides
            fresh = (root[i] != root[j]) & ((role[j] == 0) | (name[i] > name[j]))
            i, j = i[fresh], j[fresh]
            ok, equal = plausible(x[i], x[j], size[i], size[j], least)
            i, j, equal = i[ok], j[ok], equal[ok]
            near = verify.close(bits[i], bits[j], size[i] + size[j], least)
            i, j, equal = i[near], j[near], equal[near]
            here = (x[i, : BANDS * BAND] == x[j, : BANDS * BAND]).reshape(len(i), BANDS, BAND).all(axis=2).argmax(axis=1) == band[i]
            i, j, equal = i[here], j[here], equal[here]
            if how == "forest":
                found.append((i, j, equal))
                if sum(len(f[0]) for f in found) > 1 << 20:
                    found = [_least(root, name, found)]
            elif len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(name[i], name[j])), pa.array(np.minimum(name[i], name[j]))], names=["u", "v"])
        if found:
            i, j, _ = _least(root, name, found)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(name[i], name[j])), pa.array(np.minimum(name[i], name[j]))], names=["u", "v"])

    return members.groupBy("k", "heavy", "block").applyInArrow(run, "u long, v long").distinct()


def _least(root: np.ndarray, name: np.ndarray, found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    i, j, equal = (np.concatenate(v) for v in zip(*found, strict=True))
    a, b = forest(root, i, j, equal)
    known = {(p, q): e for p, q, e in zip(i.tolist(), j.tolist(), equal.tolist(), strict=True)}
    return a, b, np.array([known[p, q] for p, q in zip(a.tolist(), b.tolist(), strict=True)], np.int64)


# -- the join


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: tuple[int, int] = LEAST, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """id, n_shingles, component_id (the least id of all that is linked with the row), kept (whether that is its own)."""
    rows = checkpoint_table(nodes_of(docs, id_col, text_col, shingle), "setsketch-rows")
    nodes = checkpoint_table(rows.filter("size > 0").select("key", "th", "size", "sketch", "bits").dropDuplicates(["key"]), "setsketch-nodes")
    tasks = max(nodes.count() // TEXTS_A_TASK, TASKS)
    entries = checkpoint(buckets(nodes))
    hubs = checkpoint(entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("hub")).filter("n > 1").select("bucket", "hub").coalesce(tasks))
    shared = checkpoint(join_hot(entries, hubs, "bucket").select("bucket", "band", "key", "hub").coalesce(tasks))
    stars = checkpoint(shared.filter("key <> hub").select(F.col("key").alias("u"), F.col("hub").alias("v")).distinct().coalesce(tasks))
    stars = checkpoint(compared(nodes, stars, least, tasks).coalesce(tasks))
    some = shared.select("key").distinct().coalesce(tasks)
    wanted = checkpoint(nodes.join(some, "key", "left_semi").select("th").distinct().coalesce(tasks))
    sets = checkpoint_table(sets_of(docs, text_col, wanted, shingle), "setsketch-sets")
    edges = checkpoint(verify.verified(sets, stars, least).coalesce(tasks))
    tried = stars
    for how in ("forest", "all"):
        members = members_of(shared.select("bucket", "band", "key"), nodes, components(edges, tasks), shard, most, tasks)
        found = checkpoint(candidates(members, how, least).coalesce(tasks).join(tried, ["u", "v"], "left_anti").coalesce(tasks))
        edges = checkpoint(edges.union(verify.verified(sets, found, least)).coalesce(tasks))
        tried = tried.union(found)
    rooted = join_hot(rows.select("id", "key", "size"), components(edges, tasks), "key", "u", "left").withColumn("root", F.coalesce("root", "key"))
    full = checkpoint(rooted.filter("size > 0").select("id", "size", "root"))
    ids = checkpoint(full.groupBy("root").agg(F.min("id").alias("component_id")).coalesce(tasks))
    named = join_hot(full, ids, "root").select("id", "size", "component_id").union(rows.filter("size = 0").select("id", "size", F.col("id").alias("component_id")))
    return named.select("id", F.col("size").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents
), s AS MATERIALIZED (SELECT DISTINCT rid, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d WHERE len(w) > 0
), n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid
), e AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY ALL) p
  JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * common >= 85 * (na.n + nb.n - common)
), r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), c AS (SELECT r.a AS rid, min(doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""

QUERIES = {"op13_setsketch_neardup": op13_setsketch_neardup}
ORACLES = {"op13_setsketch_neardup": SQL}
