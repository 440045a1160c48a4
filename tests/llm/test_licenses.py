import math
import random

import pytest

from seedflow.llm import licenses as L


def brute(text):
    words = L.words_of(text)
    phrases = {tuple(L.words_of(p)): label for p, label in L.PHRASES.items()}
    places = [(i, label) for i in range(len(words)) for p, label in phrases.items() if tuple(words[i : i + len(p)]) == p]
    labels, score = {label for _, label in places}, 1.0 if places else 0.0
    for label, t in L.TEMPLATES:
        want, half = set(L.words_of(t)), 32
        while half < len(L.words_of(t)):
            half *= 2
        for a, b in L.blocks_of(len(words), 2 * half):
            both = len(want & set(words[a:b]))
            if both >= (len(want) if len(want) < 8 else math.ceil(L.THRESHOLD * len(want) - 1e-9)):
                labels.add(label)
                score = max(score, both / len(want))
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score


def texts():
    rng = random.Random(5)
    vocabulary = sorted({w.decode() for _, t in L.TEMPLATES for w in L.words_of(t)}) + ["lorem", "ipsum", "dolor"]
    out = []
    for _ in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 20, 150, 900]))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            t = rng.choice(L.TEMPLATES)[1].split()
            words[at:at] = [w for w in t if rng.random() > 0.15]
        out.append(" ".join(words))
    return out + ["Apache\nLICENSE, cc-by MIT license!", "cc by cc by", None, ""]


def test_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:8] for r in L.scan_licenses(docs).collect()}
    for i, t in enumerate(texts()):
        assert got[i][:6] == brute(t)[:6], (i, t)
        assert abs(got[i][6] - brute(t)[6]) < 1e-12
    assert any(r[6] > 0 and r[1] == 0 for r in got.values())


def test_filters_lose_nothing():
    frequency = {w: n for n, w in enumerate(sorted({w for _, t in L.TEMPLATES for w in L.words_of(t)}))}
    index = L.TemplateIndex(L.TEMPLATES, frequency, 0.6)
    rng = random.Random(1)
    for _ in range(500):
        block = {r for r in index.rank.values() if rng.random() < 0.4}
        want = {k: len(s & block) / n for k, (_, s, n, need) in enumerate(index.items) if len(s & block) >= need}
        assert index.matches(block) == want


def test_odd_rows(spark, odd, empty, sf_dir):
    rows = L.op2_license_scan(spark, sf_dir).collect()
    assert len(rows) == odd.count()
    one = next(r for r in rows if r["doc_id"] == 1)
    assert (one["n_base"], one["first_word"], one["base_labels"]) == (1, 1, "mit")
    assert L.scan_licenses(empty).count() == 0


def test_whole_licenses_at_any_offset(spark):
    rows = [(k * 1000 + at, " ".join(["lorem"] * at) + " " + t + " ipsum" * 700) for k, (_, t) in enumerate(L.TEMPLATES) for at in (0, 17, 63, 500)]
    got = {r["doc_id"]: r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, _ in rows:
        assert L.TEMPLATES[i // 1000][0] in got[i]["labels"].split(",") and got[i]["score"] == 1.0
    assert L.indexes([("x", "ein Wort")], {})[1][0][0] == L.BLOCK
    for templates, block in (([("x", " - ")], 64), ([("x", "a " * (L.MAX_WORDS + 1))], 64), ([("x", "a")], 7)):
        with pytest.raises(ValueError):
            L.indexes(templates, {}, 0.8, block)
