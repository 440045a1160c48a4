"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: 64-bit XXH64 (seed 42) of every ``SHINGLE``-word shingle, repeats included (or of every
distinct one once); a bit is set when more than half of the hashes set it.

Join: equal fingerprints are merged first. The 64 bits are cut into ``budget + 1`` slices; fingerprints
within ``budget`` differing bits agree in one slice at least, so each is sent to ``budget + 1`` groups,
by the first bits of each slice, as many as make groups of about ``TARGET`` rows. Group sizes are
counted; a group of more than ``MOST`` rows is cut again, first by its whole slice, then by slices of
its other bits, and so on, which keeps all links and no group large. A group is one sorted array, whose
bits are put in an order with its slice in front: a binary trie, whose nodes are ranges of the array.
Node pairs are traversed together, level by level: equal branches keep the number of differing bits,
crossing branches add one, and a pair beyond the error budget is pruned with everything below it. The
budget is 0 in the slice. Of the rest, one half holds ``budget // 2`` differing bits at most, so two
tries are traversed, each half of the rest coming first in one of them with that budget. A pair of nodes
whose leaves are known to be linked with each other is pruned as well, and a group returns the edges of
a spanning forest, not its pairs, so a dense group of n fingerprints gives n - 1 edges. A first traversal
with budget 1 links most of a dense group, so that the second one prunes it.

Components: large-star / small-star rounds over the edges, each checkpointed, until nothing changes.

Near copies (``near_copies``, ``deduplicate``): texts of a Jaccard similarity of 4/5 or more on 5-word
shingles (``verify``), whose fingerprints of distinct words are within ``WIDE`` bits; the same join finds
the candidates, in three rounds. The first compares each fingerprint with its neighbour in the trie and
with the hub of what it is linked to (the one next to the majority of each bit), the second takes a
spanning forest of the candidates between what the first one joined; both are linear. The third takes all
candidates between components that are still apart. Sizes and bitmaps of the shingle sets drop
candidates inside the groups, before they are written. Texts of that similarity whose fingerprints are
further apart are not found: the README states the measured recall.

Defined cases: a null or wordless text has fingerprint 0, which is linked like any other; fewer words
than a shingle are one shingle; equal rows give equal results; a null id is last in the order of ids;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import verify
from .common import checkpoint, checkpoint_table, join_hot, load

SHINGLE = 4
BUDGET = 4
#: Differing bits of two sets of distinct words whose texts are compared.
WIDE = 7
TARGET, MOST = 4096, 65536
#: Cuts of a group that stays large.
CUTS = 4
#: Node pairs in one step of a traversal, and leaf pairs that are compared without going deeper.
STEP = 1 << 19
LEAVES = 512


def fingerprint(text: str | None, shingle: int = SHINGLE, distinct: bool = False) -> int:
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    k = min(shingle, n)
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - k + 1].tolist()
    parts = [joined[a:b] for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(p, 42) for p in (set(parts) if distinct else parts)], dtype=">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (the fingerprint's 64 bits as a signed long)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f)], names=["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


# -- one group


def arranged(x: np.ndarray, mask: int, swap: bool) -> tuple[np.ndarray, int, int]:
    """Fingerprints with the bits of ``mask`` in front, and the number of these and of the bits in the first half of the rest; ``swap`` turns the halves."""
    fixed = [b for b in range(63, -1, -1) if mask >> b & 1]
    rest = [b for b in range(63, -1, -1) if not mask >> b & 1]
    half = len(rest) // 2
    rest = rest[half:] + rest[:half] if swap else rest
    out = np.zeros(len(x), np.uint64)
    for b in fixed + rest:
        out = out << np.uint64(1) | (x >> np.uint64(b) & np.uint64(1))
    return out, len(fixed), len(rest) - half if swap else half


class Linked:
    """Leaves of one trie and what links them: the least linked leaf of each, and which ranges are of one component."""

    def __init__(self, root: np.ndarray):
        self.root = root
        self._runs()

    def _runs(self) -> None:
        self.run = np.concatenate([[0], np.cumsum(self.root[1:] != self.root[:-1])]) if len(self.root) else self.root

    def found(self, i: np.ndarray, j: np.ndarray) -> None:
        changed = False
        while True:
            a, b = self.root[i], self.root[j]
            new = a != b
            if not new.any():
                break
            changed = True
            i, j, a, b = i[new], j[new], a[new], b[new]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up
        if changed:
            self._runs()

    def joined(self, lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
        r = self.run
        return (r[lo_a] == r[hi_a - 1]) & (r[lo_b] == r[hi_b - 1]) & (self.root[lo_a] == self.root[lo_b])


class Apart(Linked):
    """Leaves whose components are given; pairs of different ones are collected, where sizes and bitmaps allow the similarity.

    As a ``forest``, a pair joins its components at once: a spanning forest of the pairs is collected, not all of them.
    """

    def __init__(self, root: np.ndarray, size: np.ndarray, bits: np.ndarray, forest: bool):
        super().__init__(root)
        self.size, self.bits, self.forest, self.pairs = size.astype(np.int64), bits, forest, []

    def found(self, i: np.ndarray, j: np.ndarray) -> None:
        may = (self.root[i] != self.root[j]) & verify.may(self.size[i], self.size[j])
        i, j = i[may], j[may]
        for at in range(0, len(i), 1 << 14):
            a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            near = verify.close(self.bits[a], self.bits[b], self.size[a] + self.size[b]) & (self.root[a] != self.root[b])
            a, b = a[near], b[near]
            if not self.forest:
                self.pairs.append((a, b))
                continue
            while len(a):
                x, y = self.root[a], self.root[b]
                top, low = np.maximum(x, y), np.minimum(x, y)
                order = np.lexsort((low, top))
                first = order[np.flatnonzero(np.concatenate([[True], top[order][1:] != top[order][:-1]]))]  # what joins each component
                self.pairs.append((a[first], b[first]))
                super().found(a[first], b[first])
                new = self.root[a] != self.root[b]
                a, b = a[new], b[new]


def traverse(x: np.ndarray, links: Linked, limit: np.ndarray, budget: int) -> None:
    """Traverse the node pairs of the sorted array ``x``; limit[d]: the differing bits that a pair may have after level d."""
    n = len(x)
    if n < 2:
        return
    zeros = np.zeros((64, n + 1), np.int32)
    for d in range(64):
        np.cumsum((x >> np.uint64(63 - d)) & np.uint64(1) == 0, out=zeros[d, 1:])
    stack = [(0, *(np.array([k], np.int64) for k in (0, n, 0, n, 0)))]
    while stack:
        depth, la, ha, lb, hb, err = stack.pop()
        own = la == lb
        open_ = ~links.joined(la, ha, lb, hb) & ~(own & (ha - la < 2) & (hb - lb < 2))
        la, ha, lb, hb, err, own = la[open_], ha[open_], lb[open_], hb[open_], err[open_], own[open_]
        size = (ha - la) * (hb - lb)
        leaf = (size <= LEAVES) | ((depth >= 64) & (size <= STEP))
        at = np.flatnonzero(leaf)
        for part in np.split(at, np.flatnonzero(np.diff(np.cumsum(size[at]) // (8 * STEP))) + 1) if len(at) else []:
            m = size[part]
            which = np.repeat(np.arange(len(m)), m)
            k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            width = (hb - lb)[part][which]
            i, j = la[part][which] + k // width, lb[part][which] + k % width
            near = (i != j) & (np.bitwise_count(x[i] ^ x[j]) <= budget)
            if near.any():
                links.found(i[near], j[near])
        la, ha, lb, hb, err, own = (v[~leaf] for v in (la, ha, lb, hb, err, own))
        if not len(la):
            continue
        if depth >= 64:  # many equal fingerprints: cut one side
            ma = (la + ha) // 2
            new = [np.concatenate(v) for v in zip((la, ma, lb, hb, err), (ma, ha, lb, hb, err), strict=True)]
        else:
            z = zeros[depth]
            ma, mb = la + z[ha] - z[la], lb + z[hb] - z[lb]
            cross = err < limit[depth]
            other = cross & ~own
            new = [
                np.concatenate(v)
                for v in zip((la, ma, lb, mb, err), (ma, ha, mb, hb, err), (la[cross], ma[cross], mb[cross], hb[cross], err[cross] + 1), (ma[other], ha[other], lb[other], mb[other], err[other] + 1), strict=True)
            ]
        some = (new[1] > new[0]) & (new[3] > new[2])
        new = [v[some] for v in new]
        for k in range(0, len(new[0]), STEP):
            stack.append((depth + 1, *(v[k : k + STEP] for v in new)))


def limits(fixed: int, half: int, budget: int) -> np.ndarray:
    out = np.full(65, budget)
    out[: fixed + half] = budget // 2
    out[:fixed] = 0
    return out


def linked(x: np.ndarray, mask: int = 0, budget: int = BUDGET) -> np.ndarray:
    """For every fingerprint of ``x`` (uint64, any order), one index for all that it is linked to through pairs that agree in ``mask``."""
    root = np.arange(len(x))
    for swap in (False, True):
        y, fixed, half = arranged(x, mask, swap)
        order = np.argsort(y, kind="stable")
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        links, y = Linked(np.arange(len(x))), y[order]
        links.found(np.arange(len(x)), place[root[order]])
        same = np.flatnonzero(y[1:] == y[:-1])
        links.found(same, same + 1)
        limit = limits(fixed, half, budget)
        for most in (1, budget) if budget > 1 else (budget,):
            traverse(y, links, np.minimum(limit, most), most)
        root = order[links.root[place]]
    return root


def apart(x: np.ndarray, root: np.ndarray, size: np.ndarray, bits: np.ndarray, mask: int, budget: int, forest: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) within the budget that agree in ``mask``, have different roots and may be similar; a pair may come more than once."""
    _, first, root = np.unique(root, return_index=True, return_inverse=True)
    for swap in (False, True):
        y, fixed, half = arranged(x, mask, swap)
        order = np.argsort(y, kind="stable")
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        # a component is told by the place of one of its leaves
        links = Apart(place[first][root][order], size[order], bits[order], forest)
        traverse(y[order], links, limits(fixed, half, budget), budget)
        for i, j in links.pairs:
            yield order[i], order[j]


def nearby(x: np.ndarray, mask: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A linear number of pairs: neighbours within the budget, each fingerprint with the hub of what it is linked to, and with itself if it is linked to any."""
    root = linked(x, mask, budget)
    order = np.lexsort((x, root))
    cut = np.flatnonzero(np.concatenate([[True], root[order][1:] != root[order][:-1]]))
    sizes = np.diff(np.append(cut, len(x)))
    bits = np.unpackbits(x[order].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    most = np.packbits(2 * np.add.reduceat(bits, cut, axis=0, dtype=np.int64) > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    far = np.bitwise_count(x[order] ^ np.repeat(most, sizes))
    first = np.lexsort((far, np.repeat(np.arange(len(cut)), sizes)))[cut]
    yield (several := order[np.repeat(sizes > 1, sizes)]), several
    hub, i = order[np.repeat(first, sizes)], order
    for a, b in ((i, hub), (order[1:], order[:-1])):
        near = (a != b) & (root[a] == root[b]) & (np.bitwise_count(x[a] ^ x[b]) <= budget)
        yield a[near], b[near]


# -- the join


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def slices(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` cut into ``parts`` runs, each joined with ``mask``."""
    rest = [b for b in range(63, -1, -1) if not mask >> b & 1]
    return [mask | sum(1 << b for b in rest[len(rest) * k // parts : len(rest) * (k + 1) // parts]) for k in range(parts)]


def dealt(fps: DataFrame, n: int, budget: int, target: int = TARGET, most: int = MOST) -> tuple[DataFrame, dict[int, int]]:
    """Rows of ``fps`` (fp, ...) with mask and value: the groups they are sent to; and the slice of every mask."""
    bits = max(int(np.ceil(np.log2(max(n, 1) / target))), 2) if n > 0 else 2
    full, into = {}, {}
    for s in slices(0, budget + 1):
        top = [b for b in range(63, -1, -1) if s >> b & 1][:bits]
        mask = sum(1 << b for b in top)
        full[mask] = s
        into[mask] = [s] if mask != s else slices(s, budget + 1)
    keyed = lambda df, masks: df.withColumn("mask", F.explode(masks)).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    part, done = keyed(fps, F.array(*[F.lit(_signed(m)).cast("long") for m in full])), []
    for _ in range(CUTS):
        heavy = checkpoint(part.groupBy("mask", "value").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).drop("_n"))
        here = [r[0] & (1 << 64) - 1 for r in heavy.select("mask").distinct().collect()]  # bounded by the number of masks
        if not here:
            break
        done.append(part.join(heavy, ["mask", "value"], "left_anti"))
        deeper = {m: into.get(m) or slices(m, budget + 1) for m in here}
        full |= {s: s for masks in deeper.values() for s in masks}
        choice = F.create_map(*[c for m, masks in deeper.items() for c in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(s)).cast("long") for s in masks]))])
        part = keyed(part.join(heavy, ["mask", "value"], "left_semi").withColumnRenamed("mask", "_m").drop("value"), choice[F.col("_m")]).drop("_m").distinct()
    for d in done:
        part = part.unionByName(d)
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * (budget + 1) // 500_000)
    return part.repartition(tasks, "mask", "value"), full


def links(fps: DataFrame, n: int, budget: int = BUDGET, target: int = TARGET, most: int = MOST) -> DataFrame:
    """Edges (u, v), u > v as signed longs, that link all fingerprints of ``fps`` (distinct, n rows) within the budget."""
    ship(fps.sparkSession)
    groups, full = dealt(fps.select("fp"), n, budget, target, most)

    def join(key: tuple, table: pa.Table) -> pa.Table:
        x = table.column("fp").to_numpy()
        root = linked(x.view(np.uint64), full[key[0].as_py() & (1 << 64) - 1], budget)
        at = np.flatnonzero(root != np.arange(len(x)))
        return pa.table({"u": np.maximum(x[at], x[root[at]]), "v": np.minimum(x[at], x[root[at]])})

    return groups.groupBy("mask", "value").applyInArrow(join, "u long, v long")


def candidates(nodes: DataFrame, n: int, how: str, budget: int = WIDE, target: int = TARGET, most: int = MOST) -> DataFrame:
    """Pairs (u, v), u >= v, of nodes (key, fp, size; but for ``nearby`` also root and bits) within the budget, to be verified.

    ``nearby``: see there; ``forest``: what connects nodes of different roots; ``all``: all of different roots.
    """
    ship(nodes.sparkSession)
    groups, full = dealt(nodes, n, budget, target, most)

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        k, x, size = (table.column(c).to_numpy() for c in ("key", "fp", "size"))
        x, mask = x.view(np.uint64), full[key[0].as_py() & (1 << 64) - 1]
        if how == "nearby":
            pairs = nearby(x, mask, budget)
        else:
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(x), -1)
            pairs = apart(x, table.column("root").to_numpy(), size, bits, mask, budget, how == "forest")
        for i, j in pairs:
            may = verify.may(size[i], size[j])
            u, v = np.maximum(k[i[may]], k[j[may]]), np.minimum(k[i[may]], k[j[may]])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return groups.groupBy("mask", "value").applyInArrow(join, "u long, v long").distinct()


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """u, root: the least node that every node of the edges (u, v), u != v, can reach; roots themselves are left out.

    ``tasks``: tasks of a round at most, where edges are known to be few.
    """
    few = lambda df: df if tasks is None else df.coalesce(tasks)
    edges = checkpoint(few(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.withColumnRenamed("v", "root")
        state = now
        both = edges.select("u", "v").union(edges.select("v", "u"))
        least = few(both.groupBy("u").agg(F.min("v").alias("m"))).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = few(few(both.filter("v > u").join(least, F.col("u") == F.col("k"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(few(few(small.union(least.select("u", F.col("m").alias("v")))).distinct()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """id, fp (long), component_id (the least id of the component) of every row."""
    rows = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    fps = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    roots = components(links(fps.select("fp"), fps.count(), budget))
    # a component's fingerprints, its root included, with their least ids; a component may be large, so only its sums meet by root
    members = checkpoint(roots.select(F.col("u").alias("fp"), "root").union(roots.select("root", "root").distinct()).join(fps, "fp"))
    least = members.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = checkpoint(join_hot(members.select("fp", "root"), checkpoint(least), "root").select("fp", "component_id"))
    alone = fps.join(named.select("fp"), "fp", "left_anti").select("fp", F.col("least_id").alias("component_id"))
    return join_hot(rows, checkpoint(named.union(alone)), "fp").select("id", "fp", "component_id")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = WIDE, target: int = TARGET, most: int = MOST) -> DataFrame:
    """id, tie (``row_hash``), root (one key for each component of verified near copies) of every row."""
    ship(docs.sparkSession)
    rows = checkpoint_table(verify.nodes(docs.select(F.col(id_col).alias("id"), row_hash(docs).alias("tie"), F.col(text_col).alias("text")), lambda t: fingerprint(t, 1, distinct=True)), "neardup-rows")
    nodes = checkpoint_table(rows.select("key", "fp", "size", "bits").dropDuplicates(["key"]), "neardup-nodes")
    near = checkpoint(candidates(nodes.select("key", "fp", "size"), nodes.count(), "nearby", budget, target, most))
    # whoever has a candidate at all: only their sets and bitmaps go on
    some = checkpoint(near.filter("u = v").select(F.col("u").alias("key")))
    n = some.count()
    sets = checkpoint_table(verify.sets_of(docs.select(text_col), some), "neardup-sets")
    left = checkpoint_table(nodes.join(some, "key"), "neardup-left")
    edges = checkpoint(verify.verified(sets, near.filter("u > v")))
    for how in ("forest", "all"):
        rooted = join_hot(left, components(edges), "key", "u", "left").withColumn("root", F.coalesce("root", "key"))
        found = checkpoint(candidates(rooted, n, how, budget, target, most))
        edges = edges.union(checkpoint(verify.verified(sets, found)))
    return join_hot(rows.select("id", "tie", "key"), components(edges), "key", "u", "left").select("id", "tie", F.coalesce("root", "key").alias("root"))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; rows that share it are equal. Columns that hold maps count by their JSON."""
    maps = {f.name for f in docs.schema.fields if "map<" in f.dataType.simpleString()}
    value = lambda c: F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) if c in maps else F.col(f"`{c}`")
    return F.xxhash64(*[value(c) for c in docs.columns], *[F.col(f"`{c}`").isNull() for c in docs.columns])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = WIDE) -> DataFrame:
    """One row of each component of near copies, with all its columns: that of the least id, nulls last, then of the least ``row_hash``; of wholly equal rows, one."""
    rows = near_copies(docs, id_col, text_col, budget)
    row = next(n for k in range(len(docs.columns) + 1) if (n := f"_row{k or ''}") not in docs.columns)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie")).alias("w")).select(F.col("w.id").alias("_id"), F.col("w.tie").alias("_tie"))
    tied = docs.withColumn(row, row_hash(docs))
    # one exchange of the texts, by the row's hash, serves the join and the last step
    kept = tied.join(checkpoint(first), (tied[row] == first["_tie"]) & ~(~tied[f"`{id_col}`"].eqNullSafe(first["_id"])), "left_semi")
    return kept.dropDuplicates([row, id_col]).drop(row)


def op8_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_neardup": op8_simhash_neardup}
ORACLES: dict[str, str] = {}
