import random

import numpy as np

from seedflow.llm import simhash as S
from seedflow.llm import verify as V


def sets(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def expected(texts):
    root, s = list(range(len(texts))), [sets(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(s[i], s[j]) >= 0.8 - 1e-12:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def corpus(seed):
    """Texts, and near copies of each with some words changed: similarities on both sides of 0.8, below a line that many share."""
    rng, out = random.Random(seed), []
    line = " ".join(f"line{i}" for i in range(12))
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(1, 150))]
        out.append(" ".join(words))
        for _ in range(rng.randint(0, 5)):
            words = list(words)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(5000)}"
            out.append(" ".join(words) + (" " + line if rng.random() < 0.2 else ""))
    return [*out, None, "", " \n", line, line.upper()]


def test_no_link_but_between_similar_texts_and_nearly_all_of_them(spark):
    texts = corpus(4)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = expected(texts)
    for target, most in ((4096, 65536), (8, 16)):
        got = {r["id"]: r["root"] for r in S.near_copies(docs, target=target, most=most).collect()}
        for root in set(got.values()):
            assert len({want[i] for i in got if got[i] == root}) == 1
        assert len(set(texts)) - len(set(got.values())) >= 0.9 * (len(set(texts)) - len(set(want)))


def test_links_within_the_budget_are_all_found(spark):
    """With all bits as budget every pair is a candidate, so the components are those of plain comparison."""
    texts = corpus(5)[:80] + [None, " ", ""]
    want = expected(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for budget in (7, 15):
        got = {r["id"]: r["root"] for r in S.near_copies(docs, budget=budget).collect()}
        prints = [S.fingerprint(t, 1, distinct=True) for t in texts]
        s, root = [sets(t) for t in texts], list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= budget and jaccard(s[i], s[j]) >= 0.8 - 1e-12:
                    a, b = root[i], root[j]
                    root = [min(a, b) if r in (a, b) else r for r in root]
        assert len({(got[i], w) for i, w in enumerate(root)}) == len(set(got.values())) == len(set(root))
    assert root == want


def test_copies_that_only_a_hub_links(spark):
    """Each copy differs from the text in one place of its own, so two copies are below the threshold; no pair but those with the hub links them."""
    base = [f"w{i}" for i in range(62)]
    texts = [" ".join(base)] + [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(6, 56)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["root"] for r in S.near_copies(docs).collect()]
    assert max(got.count(r) for r in set(got)) >= 48


def test_bitmaps_differ_in_no_more_bits_than_shingles():
    rng = random.Random(2)
    for n in (0, 5, 300, 9000):
        words = [f"w{rng.randrange(900)}" for _ in range(n)]
        a, b = (V.shingles(" ".join(words[k:])) for k in (0, 7))
        bits = int.from_bytes(V.bitmap(a)) ^ int.from_bytes(V.bitmap(b))
        assert bits.bit_count() <= len(set(a.tolist()) ^ set(b.tolist()))
        rows = [np.frombuffer(V.bitmap(s), np.uint64)[None, :] for s in (a, b)]
        assert V.close(*rows, np.array([9 * bits.bit_count()]))[0] and (not bits or not V.close(*rows, np.array([9 * bits.bit_count() - 1]))[0])


def test_extra_columns_of_any_kind(spark, odd):
    """Maps, and a column with the name of a working column, come through; wholly equal rows are one."""
    from pyspark.sql import functions as F

    wide = odd.withColumn("_row", F.lit(7)).withColumn("m", F.create_map(F.lit("a"), F.col("n_chars"))).withColumn("s", F.struct(F.create_map(F.lit(1), F.lit("x")).alias("in")))
    got, plain = S.deduplicate(wide), S.deduplicate(odd)
    assert got.columns == wide.columns and {r["_row"] for r in got.collect()} == {7}
    assert sorted(map(str, (r["doc_id"] for r in got.collect()))) == sorted(map(str, (r["doc_id"] for r in plain.collect())))
