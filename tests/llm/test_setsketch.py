import random
import re

import numpy as np
from pyspark.sql import functions as F

from seedflow.llm import setsketch as K
from tests.llm.conftest import ROWS


def shingles(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def answer(rows, least=85):
    """(id, number of shingles, component, kept), by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= least * len(a | b) and find(i) != find(j):
                root[find(i)] = find(j)
    own = {}
    for i, (d, _) in enumerate(rows):
        own.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min((x for x in own[find(i)] if x is not None), default=None)
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def copies(seed, bases=12, each=18):
    """Texts with near copies, copies of copies, and shared passages, around the threshold."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(bases):
        text = [word() for _ in range(rng.randint(5, 150))] + passage * rng.randint(0, 1)
        made = [text]
        for _ in range(each):
            t = list(rng.choice(made))
            for _ in range(rng.randint(0, max(len(t) // 40, 1))):
                t[rng.randrange(len(t))] = word()
            made.append(t)
        rows += [" ".join(t) for t in made]
    rows += ["a b", "A  b", "a", "a b c", "", "", None] + [rows[0]] * 30
    rng.shuffle(rows)
    return list(enumerate(rows))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_equals_all_pairs(spark):
    rows = copies(1)
    assert sorted(map(tuple, K.near_duplicates(table(spark, rows)).collect()), key=str) == answer(rows)


def test_heavy_buckets_are_cut_into_blocks(spark):
    rows = copies(2, bases=3, each=60)
    assert sorted(map(tuple, K.near_duplicates(table(spark, rows), shard=40, most=8).collect()), key=str) == answer(rows)


def test_registers():
    rng = np.random.default_rng(5)
    for size, share in ((40, 0.9), (400, 0.85), (3000, 0.5)):
        same, got = 0, []
        for _ in range(20):
            both = rng.integers(0, 2**63, int(size * share)).astype(np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, (size - len(both)) // 2).astype(np.uint64)])) for _ in range(2))
            x, y, u, none = K.sketches([a, b, np.unique(np.concatenate([a, b])), a[:0]])
            assert (K.merged(x, y) == u).all() and not none.any() and u.any()
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            same += (x == y).mean() / 20
            n = [np.array([float(v)]) for v in (len(a), len(b), (x > y).sum(), (x < y).sum(), (x == y).sum())]
            got.append(K.estimate(*n)[0] - true)
        assert abs(same - true) < 0.04 and abs(np.mean(got)) < 0.03 and np.std(got) < 0.06


def test_a_sketch_does_not_depend_on_its_batch():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 700, 3, 5000, 0, 90)]
    together = K.sketches(sets)
    assert all((K.sketches([s])[0] == t).all() for s, t in zip(sets, together, strict=True))


def test_plausible_drops_no_similar_pair():
    """At the threshold, with sets of equal and of very different sizes."""
    rng = np.random.default_rng(7)
    for more in (0, 60):
        x, y, na, nb = [], [], [], []
        for _ in range(400):
            a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
            b = np.concatenate([a[: 340 if more else 370], rng.integers(0, 2**63, 0 if more else 30).astype(np.uint64)])
            s = K.sketches([a, np.unique(b)])
            x.append(s[0]), y.append(s[1]), na.append(len(a)), nb.append(len(b))
        ok, _ = K.plausible(np.array(x), np.array(y), np.array(na), np.array(nb))
        assert ok.all()
    far = [K.sketches([np.unique(rng.integers(0, 2**63, 400).astype(np.uint64)) for _ in range(2)]) for _ in range(50)]
    assert not K.plausible(np.array([f[0] for f in far]), np.array([f[1] for f in far]), np.full(50, 400), np.full(50, 400))[0].any()


def test_odd_rows(spark, odd, empty, sf_dir):
    got = sorted(map(tuple, K.op13_setsketch_neardup(spark, sf_dir).collect()), key=str)
    want = answer([(r[0], r[1]) for r in ROWS])
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(k == (d == c) for d, _, c, k in got)
    assert K.near_duplicates(empty).count() == 0
    many = odd.withColumn("key", F.lit(1)).withColumn("root", F.lit("x"))
    assert K.near_duplicates(many).count() == len(ROWS)
