"""Toxicity by a classifier chain.

Categories are predicted in a fixed order by logistic models; each later model sees, beside the
text's features, the probabilities of all earlier categories. For training these come out of fold:
the labelled rows are dealt to ``FOLDS`` folds by a hash of their text (copies share a fold), and a
row's probability comes from the model that was fitted without its fold. For scoring, each link of the
chain is the model fitted on all training rows.

Categories of the query, from labels the tables have:

* ``junk``: the label quality is 0;
* ``toxic_junk``: toxic and of quality 0;
* ``toxic``: the label toxic; it decides.

Features of a text: the logarithm of 1 + the number of occurrences of each vocabulary term, and of
1 + ``PER`` times its share of the text's words. Terms are whole words and word beginnings of ``STEM``
characters (marked ``*``), lower-cased; the vocabulary is the ``TERMS`` terms that hold most
information on the last category in the training rows of the smallest hash, at least ``LEAST`` rows.
For the out-of-fold models the vocabulary is chosen without the held-out fold as well.

Bounds: at most ``SAMPLE`` labelled texts are used for fitting, those with the smallest hash (a documented
parameter; all rows are scored). Rows of equal text are one of them: its labels are those of more than
half of the labelled rows; where they are even, it is of quality and not toxic. Of their terms, those of at least
``LEAST`` texts are kept, the ``VOCABULARY`` of most texts (ties by term): they are counted on the cluster over whole
texts, and no other term could enter a model. So at most ``SAMPLE`` rows of ``VOCABULARY`` counts reach the driver,
where models of ``TERMS`` terms are fitted; the model that goes to the executors has a fixed size.

Defined cases: a null or wordless text has probability 0 for every category and is not toxic; null
labels are not used; repeated rows are one training row; with no labelled rows, or only one class of a
category, that category's probability is its share among the labelled rows (0 without any); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import checkpoint_table, load

CATEGORIES = ("junk", "toxic_junk", "toxic")
#: Labelled texts that are used for fitting, and terms that a model may choose from.
SAMPLE, VOCABULARY = 4000, 50_000
FOLDS = 4
TERMS = 400
LEAST = 5
STEM = 5
PER = 200.0
STEPS = 200
L2 = 1e-3
THRESHOLD = 0.5

_PART = re.compile(r"[^\w]+")


def terms_of(text: str | None) -> tuple[int, Counter]:
    """Number of words, and occurrences of every term."""
    words = Counter(w for w in _PART.split((text or "").lower()) if w)
    out = Counter(words)
    for w, n in words.items():
        if len(w) > STEM:
            out[w[:STEM] + "*"] += n
    return sum(words.values()), out


def features(counts: list[tuple[int, dict]], vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(counts), 2 * len(vocabulary)), np.float32)
    for i, (n, terms) in enumerate(counts):
        small = terms if len(terms) <= len(vocabulary) else vocabulary
        for t in small:
            if t in vocabulary and t in terms:
                k, c = vocabulary[t], terms[t]
                x[i, 2 * k] = np.log1p(c)
                x[i, 2 * k + 1] = np.log1p(PER * c / n)
    return x


def choose(counts: list[tuple[int, dict]], y: np.ndarray, size: int = TERMS) -> dict[str, int]:
    """The terms with most mutual information with y, ties by term."""
    with_term: tuple[Counter, Counter] = (Counter(), Counter())
    for (_, terms), label in zip(counts, y, strict=True):
        with_term[int(label)].update(terms.keys())
    names = sorted(t for t, c in (with_term[0] + with_term[1]).items() if c >= LEAST)
    n1, n0 = max(int(y.sum()), 1), max(int(len(y) - y.sum()), 1)
    a, b = np.array([with_term[1][t] for t in names], float), np.array([with_term[0][t] for t in names], float)
    n = n0 + n1
    gain = np.zeros(len(names))
    for both, row, col in ((a, a + b, n1), (b, a + b, n0), (n1 - a, n - a - b, n1), (n0 - b, n - a - b, n0)):
        with np.errstate(divide="ignore", invalid="ignore"):
            gain += np.nan_to_num(both / n * np.log(both * n / (row * col)), nan=0.0, posinf=0.0, neginf=0.0)
    best = sorted(range(len(names)), key=lambda k: (-gain[k], names[k]))[:size]
    return {names[k]: i for i, k in enumerate(sorted(best))}


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent on standardised columns, weights given back for the raw ones."""
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return np.zeros(x.shape[1], np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    scale = np.sqrt((x**2).mean(axis=0)) + 0.05
    z = (x / scale).astype(np.float32)
    v = np.ones(z.shape[1], np.float32)
    for _ in range(8):  # the largest eigenvalue bounds the step
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 4.0 / (float(np.square(z @ v).sum()) / len(z) + 1)
    w, at, bias, bias_at = np.zeros(z.shape[1], np.float32), np.zeros(z.shape[1], np.float32), 0.0, 0.0
    for k in range(STEPS):
        d = sigmoid(z @ at + bias_at) - y
        new, new_bias = at - step * (z.T @ d / len(z) + L2 * at), bias_at - step * float(d.mean())
        m = k / (k + 3)
        at, bias_at = (new + m * (new - w)).astype(np.float32), new_bias + m * (new_bias - bias)
        w, bias = new.astype(np.float32), new_bias
    return (w / scale).astype(np.float32), bias


@dataclass
class Chain:
    """A fitted chain: a vocabulary, and for every category the weights of its features and of the earlier probabilities."""

    categories: tuple[str, ...]
    vocabulary: dict[str, int]
    models: list[tuple[np.ndarray, float]]
    #: out-of-fold probabilities of the training rows, for inspection
    held_out: np.ndarray | None = None

    def predict(self, counts: list[tuple[int, dict]]) -> np.ndarray:
        x = features(counts, self.vocabulary)
        p = np.zeros((len(counts), 0), np.float32)
        for w, b in self.models:
            p = np.column_stack([p, sigmoid(np.column_stack([x, p]) @ w + b)])
            p = p.astype(np.float32)
        p[np.array([n == 0 for n, _ in counts], bool)] = 0.0
        return p


def train_chain(counts: list[tuple[int, dict]], labels: np.ndarray, folds: np.ndarray, categories: tuple[str, ...] = CATEGORIES) -> Chain:
    """Fit the chain; column c of ``labels`` is category c, ``folds`` the fold of every row."""
    y = labels.astype(np.float32)
    parts = []
    for f in np.unique(folds):
        vocabulary = choose([c for c, g in zip(counts, folds, strict=True) if g != f], y[folds != f, -1])
        parts.append((folds == f, features(counts, vocabulary)))
    vocabulary = choose(counts, y[:, -1]) if len(y) else {}
    x = features(counts, vocabulary)
    held, models = np.zeros((len(y), 0), np.float32), []
    for c in range(len(categories)):
        oof = np.zeros(len(y), np.float32)
        for out, xf in parts:
            w, b = fit(np.column_stack([xf[~out], held[~out]]), y[~out, c])
            oof[out] = sigmoid(np.column_stack([xf[out], held[out]]) @ w + b)
        models.append(fit(np.column_stack([x, held]), y[:, c]))
        held = np.column_stack([held, oof])
    return Chain(categories, vocabulary, models, held)


_COUNTED = "n_words int, terms array<string>, times array<int>"


def labelled_terms(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """quality, toxic, hash, n_words, and the frequent terms and times of up to ``sample`` labelled texts, those of the smallest hash, each once."""
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).filter("quality IS NOT NULL AND toxic IS NOT NULL")
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash")
    rows = docs.select(F.col(id_col).alias("_id"), hashed).join(known, "_id")
    texts = rows.groupBy("hash").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"), (F.avg("toxic") > 0.5).cast("int").alias("toxic"))
    least = texts.orderBy("hash").limit(sample)
    chosen = docs.select(F.col(text_col).alias("_text"), hashed).join(F.broadcast(least), "hash").dropDuplicates(["hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [terms_of(t.as_py()) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([n for n, _ in got], pa.int32()), pa.array([list(t) for _, t in got], pa.list_(pa.string())), pa.array([list(t.values()) for _, t in got], pa.list_(pa.int32()))], names=["quality", "toxic", "hash", "n_words", "terms", "times"])

    counted = checkpoint_table(chosen.select("quality", "toxic", "hash", "_text").mapInArrow(run, f"quality int, toxic int, hash long, {_COUNTED}"), "toxicity-terms")
    each = counted.select("hash", F.explode(F.arrays_zip("terms", "times")).alias("t")).select("hash", F.col("t.terms").alias("term"), F.col("t.times").alias("times"))
    frequent = each.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST).orderBy(F.desc("n"), "term").limit(VOCABULARY).select("term")
    kept = each.join(F.broadcast(frequent), "term").groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("term", "times"))).alias("t"))  # VOCABULARY terms at most
    rows = counted.select("quality", "toxic", "hash", "n_words").join(kept, "hash", "left")
    no = lambda kind: F.expr(f"CAST(array() AS array<{kind}>)")
    return rows.select("quality", "toxic", "hash", "n_words", F.coalesce(F.col("t.term"), no("string")).alias("terms"), F.coalesce(F.col("t.times"), no("int")).alias("times"))


def fit_from_tables(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """The chain of ``CATEGORIES`` fitted on the labelled documents."""
    table = labelled_terms(docs, labels, sample).toArrow().sort_by([("hash", "ascending"), ("quality", "ascending"), ("toxic", "ascending")]).combine_chunks()
    # rare terms are dropped while they are still numbers
    lists = table.column("terms").combine_chunks()
    flat = lists.flatten().dictionary_encode()
    code, times = flat.indices.to_numpy(), table.column("times").combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(len(table)), lists.value_lengths().to_numpy())
    frequent = (np.bincount(code, minlength=len(flat.dictionary)) >= LEAST)[code] if len(code) else np.zeros(0, bool)
    names = flat.dictionary.to_pylist()
    counts = [(n, {}) for n in table.column("n_words").to_pylist()]
    for r, t, c in zip(row[frequent].tolist(), code[frequent].tolist(), times[frequent].tolist(), strict=True):
        counts[r][1][names[t]] = c
    quality, toxic = (np.array(table.column(c).to_pylist(), int) for c in ("quality", "toxic"))
    folds = np.array(table.column("hash").to_pylist(), np.int64) % FOLDS
    return train_chain(counts, np.column_stack([1 - quality, (1 - quality) * toxic, toxic]).reshape(-1, len(CATEGORIES)), folds)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, one probability ``p_<category>`` each, and ``toxic``: whether the last one reaches the threshold."""
    ship(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]
    light = Chain(chain.categories, chain.vocabulary, chain.models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                counts = [terms_of(t.as_py()) for t in b.column(1)]
                p = light.predict(counts).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], names=["id", *names, "toxic"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")


def clean_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    chain = fit_from_tables(docs, labels)
    light, at_text = Chain(chain.categories, chain.vocabulary, chain.models), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                p = light.predict([terms_of(t.as_py()) for t in b.column(at_text)])
                yield b.filter(pa.array(p[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score(docs, fit_from_tables(docs, load(spark, sf_dir, "labels")))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
