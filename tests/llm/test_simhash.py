import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from seedflow.llm import simhash as S
from tests.llm.conftest import ROWS


def slow(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(len(w) - 3, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def classes(values, budget=4):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@given(st.text(alphabet="abC É\n\t", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert S.fingerprint(text) == slow(text)


def near(rng, n, flips):
    base, out = [rng.getrandbits(64) for _ in range(n)], []
    for b in base:
        out.append(b)
        for _ in range(rng.randint(0, 4)):
            out.append(out[-1] ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, flips))}))
    return out


def groups(labels):
    """The same number for all that share a label, in order of first sight."""
    return [list(dict.fromkeys(labels)).index(r) for r in labels]


def test_tries_find_every_link_and_no_other():
    for seed in range(6):
        x = np.unique(np.array([*near(random.Random(seed), 120, 6), 0, 1, 2**64 - 1], np.uint64))
        for budget in (1, 4, 7):
            assert groups(S.linked(x, 0, budget).tolist()) == groups(classes(x.tolist(), budget))
    assert S.linked(np.zeros(0, np.uint64)).tolist() == []


def test_a_dense_ball_is_one_component():
    x = np.unique(np.array([sum({1 << a, 1 << b}) for a in range(64) for b in range(64)], np.uint64))
    assert len(set(S.linked(x).tolist())) == 1


def test_pairs_of_given_components():
    """All pairs within the budget but those inside a component; equal fingerprints occur more than once."""
    rng = random.Random(4)
    x = np.array(near(rng, 60, 5) + [5] * 40 + [7], np.uint64)
    root, size = np.array([rng.randrange(30) for _ in x]), np.full(len(x), 10)
    for budget in (0, 4, 7):
        want = {(i, j) for i in range(len(x)) for j in range(i) if (int(x[i]) ^ int(x[j])).bit_count() <= budget and root[i] != root[j]}
        bits = np.zeros((len(x), 32), np.uint64)
        pairs = lambda forest: {(max(i, j), min(i, j)) for a, b in S.apart(x, root, size, bits, 0, budget, forest) for i, j in zip(a.tolist(), b.tolist(), strict=True)}  # noqa: B023, E731
        assert pairs(False) == want
        some, links = pairs(True), S.Linked(np.arange(len(x)))
        assert some <= want and len(some) <= 2 * len(x)
        for i, j in [*some, *((i, min(k for k in range(len(x)) if root[k] == root[i])) for i in range(len(x)))]:
            links.found(np.array([i]), np.array([j]))
        assert all(links.root[i] == links.root[j] for i, j in want)
    for a, b in S.nearby(x, 0, 4):
        assert (np.bitwise_count(x[a] ^ x[b]) <= 4).all() and len(a) <= len(x)


def test_distributed_join_with_many_groups(spark):
    """Small groups and groups that are cut again and again give the same components."""
    x = list(dict.fromkeys(near(random.Random(9), 300, 5) + [3 << 50 | 1 << k for k in range(40)]))
    rows = [(i, int(np.array([v], np.uint64).view(np.int64)[0])) for i, v in enumerate(x)]
    fps = spark.createDataFrame(rows, "id long, fp long")
    want = groups(classes(x))
    for target, most in ((4096, 65536), (8, 64), (4, 3)):
        roots = {r["u"]: r["root"] for r in S.components(S.links(fps.select("fp"), len(rows), target=target, most=most)).collect()}
        assert groups([roots.get(f, f) for _, f in rows]) == want


def test_no_group_is_larger_than_it_may_be(spark):
    """A prefix that half of the fingerprints share makes groups that are cut again."""
    fps = spark.range(2000).selectExpr("if(id % 2 = 0, xxhash64(id), shiftrightunsigned(xxhash64(id), 13)) fp")
    dealt, full = S.dealt(fps, 2000, 4, target=64, most=100)
    sizes = [r["count"] for r in dealt.groupBy("mask", "value").count().collect()]
    assert max(sizes) <= 100 and {r["mask"] & 2**64 - 1 for r in dealt.select("mask").distinct().collect()} <= set(full)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(300, 200), (200, 250)]
    got = {r["u"]: r["root"] for r in S.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {250: 200, 300: 200}
    assert S.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(spark, odd, empty, sf_dir):
    rows = S.op8_simhash_neardup(spark, sf_dir).collect()
    ids = sorted((r[0], slow(r[1])) for r in ROWS if r[0] is not None)
    want = classes([f for _, f in ids])
    expected = {i: ids[w][0] for (i, _), w in zip(ids, want, strict=True)}
    assert len(rows) == len(ROWS)
    assert all(r["component_id"] == expected[r["doc_id"]] and int(r["fingerprint"], 16) == dict(ids)[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    assert S.near_duplicates(empty).count() == 0
    kept = S.deduplicate(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([None, 1, 2, 4, 5, 7], key=str)


def test_one_row_stays_of_each_component_whatever_its_id(spark):
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in ("red", "blue", "green", "grey")]
    rows = [(None, texts[0], 1), (None, texts[1], 2), (1, texts[2], 3), (1, texts[3], 4), (None, texts[2], 5), (None, texts[0], 1), (2, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    want = sorted([(None, texts[0], 1), (None, texts[1], 2), (1, texts[2], 3), (1, texts[3], 4), (2, None, 6)], key=str)
    for n in (1, 5):
        assert sorted(map(tuple, S.deduplicate(docs.repartition(n)).collect()), key=str) == want
