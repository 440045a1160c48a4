"""The pipeline against plain Python, stage by stage and as a whole."""

from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from seedflow.llm import mixing, simhash, toxicity
from tests.llm.test_toxicity import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipe")
    rows = [(i, t.capitalize() + ".", "en", ["a", "b", None][i % 3], len(t) + 1) for i, t, *_ in corpus(300, 8)]
    clean = next(r for r in rows if "idiot" not in r[1] and "scum" not in r[1] and "moron" not in r[1])
    rows += [(1000 + k, clean[1], "en", "a", clean[4]) for k in range(5)] + [(2000, None, None, None, None), (2001, "", "en", "b", 0), (2002, "no end " * 30, "en", "b", 9)]
    # a longer text, one that is near it (one word of many changed) and one that is not (every seventh word changed)
    words = " ".join(r[1][:-1].lower() for r in rows[:300] if not {"idiot", "scum", "moron"} & set(r[1].lower().split()))[:2400].split(" ")
    long = [(2999, words), (3000, [*words[:200], "changed", *words[201:]]), (3001, [w if k % 7 else "other" for k, w in enumerate(words)])]
    rows += [(i, " ".join(w).capitalize() + ".", "en", "a", 9) for i, w in long]
    labels = [(i, q, x) for i, _, q, x in corpus(300, 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), clean[0]


def least_of_groups(texts):
    """The least id of each group of texts that a Jaccard similarity of 0.8 or more on 5-word shingles links, by comparing all pairs."""

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    sets, least = {i: shingles(t) for i, t in texts.items()}, {}
    for i in sorted(sets):
        near = {least[j] for j in least if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
        least[i] = min(near | {i})
        least |= {j: least[i] for j, r in least.items() if r in near}
    return set(least.values())


def test_stages(spark, folder):
    d, clean = folder
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in P.STAGES:
        before = docs
        docs = P.checkpoint_table(stage(spark, before, d), f"test-{name}")
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = docs
        if name == "toxicity":
            chain = toxicity.fit_from_tables(before, spark.read.parquet(f"{d}/labels.parquet"))
            p = chain.predict([toxicity.terms_of(r["text"]) for r in before.collect()])
            assert docs.count() == int((p[:, -1] < toxicity.THRESHOLD).sum()) < before.count()
        if name == "quality":
            left = {r["doc_id"] for r in docs.collect()}
            assert left & {2000, 2001, 2002} == set() and clean in left
            assert left == {r["doc_id"] for r in before.collect() if r["text"] and r["doc_id"] not in (2000, 2001, 2002)}
        if name == "neardup":
            want = least_of_groups({r["doc_id"]: r["text"] for r in before.collect()})
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(want) and clean in want
            assert not want & {1000, 1001, 1002, 1003, 1004, 3000} and 3001 in want  # copies and the near one go, the one that is too far stays
        if name == "mixing":
            taken = {r["id"]: r["taken"] for r in mixing.mix(before).collect() if r["taken"]}
            words = Counter()
            for r in docs.collect():
                words[r["doc_id"]] += len(r["text"].split())
            assert dict(words) == taken
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r["doc_id"], library.encode(r["text"])) for r in seen["mixing"].collect())
    assert sorted((r["doc_id"], r["ids"]) for r in docs.collect()) == want
    assert sorted((r["doc_id"], r["ids"]) for r in P.run(spark, d).collect()) == want
    assert docs.filter(~F.col("round_trip")).count() == 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_near_copies_go(spark):
    """One word in 60 changed: 51 of 61 shingles are shared, but the fingerprints of op8 are more than 4 bits apart."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words), "en", "a", 1), (2, " ".join([*words[:30], "other", *words[31:]]), "en", "b", 1), (3, " ".join(words[:45]), "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert (simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).bit_count() > 4
    assert sorted(r["doc_id"] for r in P.neardup_stage(spark, docs, "").collect()) == [1, 3]
