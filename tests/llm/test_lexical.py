import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seedflow.llm import lexical as X
from tests.llm.conftest import ROWS


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def answer(docs, items, k=10):
    """The ranking as it is told, document by document."""
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in terms(text) if c[w])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 300}"
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[0][1]) for i in range(40)] + [(7, "rare Rare word"), (None, "rare rare word"), (None, None), (n + 99, "")]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 12)))) for i in range(25)] + [(25, "RARE rare w1"), (3, "w1 w2 w3"), (3, "w1 w2 w3"), (26, None), (None, "rare"), (27, "absent")]
    return docs, items


def run(spark, docs, items, k=10, width=16):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    return Counter(map(tuple, X.search(X.build_index(d, width=width), q, k).collect()))


def test_terms_are_counted_by_bytes():
    """Before, a regular expression ran over every text."""
    texts = [t for _, t, *_ in ROWS] + ["a", None, "b", "", " ", "c-d", "é1 \x7f_z", "日本 語", "x" * 1000]
    for a in (pa.array(texts), pa.array(texts)[3:], pa.array(texts, pa.large_string()), pa.array([], pa.string()), pa.array([None], pa.string()), pa.array(texts)[-5:-5]):
        assert X.count_terms(a).tolist() == [len(terms(t)) for t in a.to_pylist()]


def test_ranking_equals_brute_force(spark):
    docs, items = corpus(1, 300)
    assert run(spark, docs, items) == answer(docs, items)


def test_short_segments_and_other_k(spark):
    docs, items = corpus(2, 120)
    assert run(spark, docs, items, k=3, width=1) == answer(docs, items, 3)
    assert run(spark, docs, items, k=50, width=7) == answer(docs, items, 50)


@given(st.integers(1, 10**6), st.integers(1, 10**7), st.integers(1, 10**6), st.integers(1, 10**9))
@settings(max_examples=300, deadline=None)
def test_bytes_bound_impacts(tf, length, documents, total):
    exact = X.impact(np.array([tf]), X.norm(np.array([length]), documents, total))
    byte = X.quantised(exact)
    assert 0 <= exact[0] <= X.TOP and X.LOWER[byte[0]] <= exact[0] <= X.UPPER[byte[0]] and X.UPPER[byte[0]] - X.LOWER[byte[0]] <= X.TOP // 255


def test_few_documents_are_rescored(spark):
    """The first level leaves little more than k documents of a query: bounds are tight."""
    rng = random.Random(3)
    held = X.Segment(4096)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 2000}" for _ in range(rng.randint(5, 300)))) for i in range(4000)]
    for d, t in docs:
        held.add(d, t)
    import pyarrow as pa

    rows = pa.Table.from_batches(list(held.rows(0, 4000, sum(held.lengths), pa.int64()))).slice(1)
    holding = dict(zip(rows.column("term").to_pylist(), rows.column("n").to_pylist(), strict=True))
    asked = [Counter(terms(t)[:20]) for _, t in docs[:30]]
    block = X.Block(asked, holding, 4000)
    keep = pa.array([t in block.by_term for t in rows.column("term").to_pylist()])
    q, *_ = X.bounds(block, rows.filter(keep), 10)
    assert max(Counter(q.tolist()).values()) < 60 and min(Counter(q.tolist()).values()) >= 10


def test_odd_rows(spark, odd, empty, sf_dir):
    items = [(1, "one two"), (2, "MIT license word1 and"), (3, None), (4, "日本語 köln line")]
    spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x")).write.mode("overwrite").parquet(f"{sf_dir}/benchmark.parquet")
    got = Counter(map(tuple, X.op12_lexical_search(spark, sf_dir).collect()))
    assert got == answer([(r[0], r[1]) for r in ROWS], items)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert X.search(X.build_index(empty), q).count() == 0 and X.search(X.build_index(odd), q.limit(0)).count() == 0
    names = defaultdict(int)
    for r in X.search(X.build_index(odd, "source"), q).collect():
        names[r["id"]] += 1
    assert set(names) <= {"a", "b", "c", None}
