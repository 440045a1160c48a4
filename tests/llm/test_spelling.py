import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from seedflow.llm import spelling as S
from tests.llm.conftest import ROWS


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def counted(rows):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", low(text)):
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            out[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def edits(w, letters):
    for i in range(len(w) + 1):
        for c in letters:
            yield w[:i] + c + w[i:]
        if i < len(w):
            yield w[:i] + w[i + 1 :]
            for c in letters:
                yield w[:i] + c + w[i + 1 :]


def answer(words):
    letters, out = {c for w in words for c in w}, {}
    for w, n in words.items():
        near = {e for e in edits(w, letters) if e in words} - {w}
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= 2 * n else None
        out[w] = [form, None, n, len(near), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {(w, *v) for w, v in out.items()}


def table(spark, words):
    return spark.createDataFrame(list(words.items()) or [], "word string, n long").repartition(3)


def vocabulary(seed, n, letters="abé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 12))): rng.randint(3, 40) for _ in range(n)}
    words |= {"aaaaa" + "a" * i: 3 * 2**i for i in range(6)}  # runs of one letter, and a long chain of forms
    return words | {"x" * 3000: 5, "x" * 2999 + "y": 50, "x" * 3001: 7}


def test_variants_equal_brute_force(spark):
    words = vocabulary(1, 1500)
    assert set(map(tuple, S.variants(table(spark, words), shard=700).collect())) == answer(words)


def test_heavy_lists_are_cut_into_blocks(spark):
    words = vocabulary(2, 600, "ab")
    got = S.near_words(table(spark, words), shard=500, most=4).collect()
    assert len(got) == len({(r["word"], r["near"]) for r in got})
    assert Counter(r["word"] for r in got) == Counter({a[0]: a[4] for a in answer(words) if a[4]})
    tasks = S.dealt(S.checkpoint(S.postings(table(spark, words), spark.sparkContext.broadcast(S.gram_frequency(table(spark, words))))), 500, 4)
    assert tasks.filter("b1 <> b2").count() > 0


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"h{i}", "w30") for i in range(200)], "word string, form string")
    assert {r["root"] for r in S.roots(forms).collect()} == {"w37"}


def test_counts_and_odd_rows(spark, odd, empty, sf_dir):
    want = counted((r[0], r[1]) for r in ROWS)
    assert dict(map(tuple, S.word_counts(odd).collect())) == want
    assert {tuple(r) for r in S.op11_spelling_variants(spark, sf_dir).collect()} == answer(want)
    assert S.variants(S.word_counts(empty)).count() == 0
    many = odd.withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    assert S.word_counts(many).count() == len(want)


def test_planted_errors(spark):
    """The checksum takes one code point of some runs; words of the errors are found as variants of the words."""
    rows = [(i, "Überraschung überraschend " * 3) for i in range(400)]
    words = counted(rows)
    assert len(words) > 2 and dict(map(tuple, S.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == words
    got = {r["word"]: r for r in S.variants(table(spark, words)).collect()}
    assert all(r["root"] in ("Überraschung", "überraschend") for r in got.values() if abs(len(r["word"]) - 12) <= 1)
