import random

import numpy as np
from pyspark.sql import functions as F

from seedflow.llm import toxicity as T
from tests.llm.conftest import ROWS


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = [rng.choice(plain) for _ in range(rng.randint(30, 200))]
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scumbag", "moronic"])
        rows.append((i, " ".join(words), int(rng.random() < 0.8), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows[:600]], "doc_id long, quality int, toxic int")
    chain = T.fit_from_tables(docs, labels)
    found = {r["doc_id"]: r["toxic"] for r in T.score(docs, chain).collect()}
    right = sum(found[i] == bool(x) for i, _, _, x in rows[600:])
    assert right / 300 > 0.97
    oof = chain.held_out[:, -1] >= T.THRESHOLD
    assert len(oof) == 600
    kept = T.clean_documents(docs, labels).collect()
    assert {r["doc_id"] for r in kept} == {i for i, f in found.items() if not f}


def test_chain_feeds_earlier_probabilities_forward():
    rng = np.random.default_rng(0)
    counts = [(50, {f"t{j}": 1 for j in rng.choice(30, 8, replace=False)} | ({"bad": 2} if i % 5 == 0 else {})) for i in range(400)]
    y = np.array([[i % 2, i % 5 == 0, i % 5 == 0] for i in range(400)], int)
    chain = T.train_chain(counts, y, np.arange(400) % 4, ("a", "b", "c"))
    assert [len(w) for w, _ in chain.models] == [2 * len(chain.vocabulary) + k for k in range(3)]
    assert chain.models[2][0][-1] > chain.models[2][0][-2]  # b says more about c than a does
    p = chain.predict(counts)
    assert p.shape == (400, 3) and ((p[:, 2] >= 0.5) == (y[:, 2] == 1)).all()


def test_chain_equals_plain_loops():
    """Out-of-fold probabilities and scores, category by category and row by row, with nothing but single models."""
    rows = corpus(160, 5)
    counts = [T.terms_of(t) for _, t, *_ in rows]
    y = np.array([[1 - q, (1 - q) * x, x] for *_, q, x in rows], int)
    folds = np.arange(len(rows)) % 3
    chain = T.train_chain(counts, y, folds)

    def row(i, vocabulary, before):
        n, terms = counts[i]
        out = []
        for t in sorted(vocabulary, key=vocabulary.get):
            c = terms.get(t, 0)
            out += [np.log(1 + c), np.log(1 + T.PER * c / n)]
        return out + before

    held = [[] for _ in rows]
    for c in range(3):
        new = [0.0] * len(rows)
        for f in range(3):
            inside = [i for i in range(len(rows)) if folds[i] != f]
            vocabulary = T.choose([counts[i] for i in inside], y[inside, -1])
            w, b = T.fit(np.array([row(i, vocabulary, held[i]) for i in inside], np.float32), y[inside, c].astype(np.float32))
            for i in range(len(rows)):
                if folds[i] == f:
                    new[i] = 1 / (1 + np.exp(-(sum(a * v for a, v in zip(w, row(i, vocabulary, held[i]), strict=True)) + b)))
        held = [h + [p] for h, p in zip(held, new, strict=True)]
    assert np.abs(chain.held_out - np.array(held)).max() < 1e-3
    scored = []
    for i in range(len(rows)):
        p = []
        for w, b in chain.models:
            p.append(1 / (1 + np.exp(-(sum(a * v for a, v in zip(w, row(i, chain.vocabulary, p), strict=True)) + b))))
        scored.append(p)
    assert np.abs(chain.predict(counts) - np.array(scored)).max() < 1e-4


def test_long_texts_lose_no_frequent_term(spark, monkeypatch):
    """A term that stands once at the end of a long text is kept if enough texts have it."""
    long = " ".join(f"t{i}" for i in range(9000)) + " often often"
    docs = spark.createDataFrame([(1, long), (2, "a few words"), *[(k, f"t8999 often own{k}") for k in range(3, 3 + T.LEAST)]], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(1, 3 + T.LEAST)], "doc_id long, quality int, toxic int")
    got = {r["n_words"]: dict(zip(r["terms"], r["times"], strict=True)) for r in T.labelled_terms(docs, labels).collect()}
    assert got[9002] == {"t8999": 1, "often": 2} and got[3] in ({}, {"t8999": 1, "often": 1})
    assert T.labelled_terms(docs, labels).count() == 2 + T.LEAST
    monkeypatch.setattr(T, "VOCABULARY", 1)
    assert {tuple(r["terms"]) for r in T.labelled_terms(docs, labels).collect()} == {("often",), ()}


def test_one_class_and_no_labels(spark, odd, empty, sf_dir):
    rows = T.op4_toxicity(spark, sf_dir).collect()
    assert len(rows) == len(ROWS)
    assert all(r["p_toxic"] == 0 and not r["toxic"] for r in rows if r["doc_id"] in (2, 3, 6))
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scored = T.score(odd, T.fit_from_tables(odd, nothing)).collect()
    assert not any(r["toxic"] for r in scored)
    assert T.score(empty, T.fit_from_tables(empty, nothing)).count() == 0
    assert T.clean_documents(odd, nothing).columns == odd.columns


def test_copies_of_a_text_are_one_training_row(spark):
    """The text of the least hash has many copies, which disagree about their labels."""
    texts = spark.createDataFrame([(f"text number {i}",) for i in range(60)], "text string").orderBy(F.xxhash64("text")).collect()
    rows = [(i, r[0]) for i, r in enumerate(texts)] + [(100 + k, texts[0][0]) for k in range(200)] + [(400, texts[1][0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + k, int(k % 4 == 0), int(k % 4 > 0)) for k in range(200)] + [(400, 0, 1)], "doc_id long, quality int, toxic int")
    got = sorted(T.labelled_terms(docs, labels, sample=20).collect(), key=lambda r: r["hash"])
    assert len(got) == 20 == len({r["hash"] for r in got})
    assert [r["terms"] for r in got] == [["numbe*", "number", "text"]] * 20  # the numbers themselves are rare
    assert [(r["quality"], r["toxic"]) for r in got] == [(0, 1)] + [(1, 0)] * 19
