"""Ranked lexical search over a two-level quantised impact index.

Terms are maximal runs of ASCII letters, digits and everything beyond ASCII, with A-Z lower-cased. A
document's score for a query sums, over the query's terms with repeats, the term's integer weight times
the term's integer impact in the document (``impact``; it depends on the term's frequency in the document,
the document's length and the corpus totals).

Index (``build_index``): one pass over the texts' bytes counts documents and terms, a second one writes
segments of up to ``SEGMENT`` documents or ``SEGMENT_BYTES`` bytes of text as Parquet in the shared folder, a
row for each term of a segment: the documents' slots, and on two levels

* one byte a posting, the impact in steps of a 255th of ``TOP``, rounded upward: it gives an upper and a lower bound;
* the exact frequency, from which the exact impact follows; only rescoring reads this column.

A header row of each segment holds the documents' ids and lengths.

Search (``search``), for blocks of ``QUERIES_AT_ONCE`` queries, whose terms are sent to the executors:

1. a segment adds up both bounds of all its documents for each query, and gives back the documents whose
   upper bound reaches its own k-th largest lower bound;
2. the k-th largest lower bound over all segments is what an upper bound must reach; fewer than k
   documents with a positive lower bound set no bar but a positive upper bound;
3. every document that reaches it is rescored exactly from the second level, and the k best are kept.

Bounds are sums of integers that hold for each posting, so no document of the k best is missed. Scores are
never gathered whole: a segment works on its own, and ranks are taken with a limit on both sides of the shuffle.

Defined cases: a null or empty text has no terms, is in no result and is not counted among the documents; a
null query text gives no result; repeated documents and repeated query rows count each on its own; equal
scores go by ascending id, null ids last; an empty table or an empty query table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import checkpoint, fresh_path, load
from .licenses import words_of

K = 10
SEGMENT, SEGMENT_BYTES = 4096, 16 << 20
#: An impact is at most this.
TOP = 1_000_000
QUERIES_AT_ONCE = 256
ROWS = 20_000


#: Whether each byte of UTF-8 belongs to a term: letters and digits of ASCII, and all beyond it; ``words_of`` parts texts the same way.
IN_TERM = np.array([b > 127 or chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class Index:
    rows: DataFrame  # seg, term, slots, impacts, tfs, ids, lengths
    documents: int  # with at least one term
    terms: int  # of all documents, with repeats
    id_type: str
    width: int  # documents of a segment at most


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def norm(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    return 25 + 75 * lengths.astype(np.int64) * documents // max(terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 8 * m)


def quantised(exact: np.ndarray) -> np.ndarray:
    return (-(-exact * 255 // TOP)).astype(np.uint8)


#: What an impact of each byte is at most, and at least.
UPPER = np.arange(256, dtype=np.int64) * TOP // 255
LOWER = np.concatenate([[0], np.arange(255, dtype=np.int64) * TOP // 255 + 1])


def count_terms(texts: pa.Array) -> np.ndarray:
    """How many terms each text has: bytes of terms that begin their text, or follow another byte. Without a step in Python for a text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    inside = IN_TERM[np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]] if at[-1] > at[0] else np.zeros(0, bool)
    at = at - at[0]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = inside[first]
    return np.diff(np.searchsorted(np.flatnonzero(begins), at))


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of an array as binary values; ends: the ends of the slices, from 0."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


class Segment:
    """Documents that are gathered until they are written."""

    def __init__(self, width: int):
        self.width, self.names = width, {}
        self.ids, self.lengths, self.parts, self.bytes = [], [], [], 0

    def add(self, id_, text: str) -> None:
        words = words_of(text)
        if not words:
            return
        names = self.names
        self.parts.append(np.array([names.setdefault(w, len(names)) for w in words], np.int64))
        self.ids.append(id_)
        self.lengths.append(len(words))
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.ids) >= self.width or self.bytes >= SEGMENT_BYTES

    def rows(self, number: int, documents: int, terms: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        lengths = np.array(self.lengths, np.int64)
        names = sorted(self.names)
        place = np.empty(len(names), np.int64)
        place[[self.names[w] for w in names]] = np.arange(len(names))
        slot = np.repeat(np.arange(len(lengths)), lengths)
        key, tf = np.unique(place[np.concatenate(self.parts)] * self.width + slot, return_counts=True)
        slots = (key % self.width).astype(np.uint16)
        exact = impact(tf, norm(lengths, documents, terms)[slots])
        ends = np.concatenate([[0], np.cumsum(np.bincount(key // self.width, minlength=len(names)))])
        fields = ["seg", "term", "n", "slots", "impacts", "tfs", "ids", "lengths"]
        ids = pa.list_(id_type)

        def batch(n: int, term: pa.Array, count: pa.Array, *more: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int64)), term, count, *more], names=fields)

        no = lambda kind, n=1: pa.nulls(n, kind)
        yield batch(1, no(pa.string()), no(pa.int32()), no(pa.binary()), no(pa.binary()), no(pa.binary()), pa.array([self.ids], ids), pa.array([lengths.astype(np.int32).tobytes()], pa.binary()))
        for a in range(0, len(names), ROWS):
            b = min(a + ROWS, len(names))
            lo, hi, cut = ends[a], ends[b], ends[a : b + 1] - ends[a]
            levels = [_binary(x[lo:hi], cut) for x in (slots, quantised(exact), tf.astype(np.int32))]
            yield batch(b - a, pa.array([w.decode() for w in names[a:b]], pa.string()), pa.array(np.diff(cut).astype(np.int32)), *levels[:2], levels[2], no(ids, b - a), no(pa.binary(), b - a))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SEGMENT) -> Index:
    if not 0 < width <= 65536:
        raise ValueError("a segment holds 1 to 65536 documents")
    spark = docs.sparkSession
    ship(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = count_terms(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["documents", "terms"])

    counted = docs.select(text_col).mapInArrow(count, "documents long, terms long")
    documents, terms = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("documents", "terms")]).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k, held, kind = TaskContext.get().partitionId() << 32, 0, Segment(width), None
        for b in batches:
            kind = b.column(0).type
            for id_, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.add(id_, text.as_py())
                if held.full():
                    yield from held.rows(first + k, documents, terms, kind)
                    k, held = k + 1, Segment(width)
        if held.ids:
            yield from held.rows(first + k, documents, terms, kind)

    id_type = docs.schema[id_col].dataType.simpleString()
    path = fresh_path(spark, "lexical-index")
    schema = f"seg long, term string, n int, slots binary, impacts binary, tfs binary, ids array<{id_type}>, lengths binary"
    docs.select(id_col, text_col).mapInArrow(run, schema).write.parquet(path)
    return Index(spark.read.schema(schema).parquet(path), documents, terms, id_type, width)


class Block:
    """Some queries as term weights: for each term, the queries that hold it and its weight there, with repeats."""

    def __init__(self, counts: list[Counter], holding: dict[str, int], documents: int):
        self.size, by_term = len(counts), {}
        for q, c in enumerate(counts):
            for term, n in c.items():
                if (w := weight(documents, holding[term]) if term in holding else 0) > 0:
                    by_term.setdefault(term, []).append((q, n * w))
        self.by_term = {t: (np.array([q for q, _ in v]), np.array([w for _, w in v], np.int64)) for t, v in by_term.items()}


def bounds(block: Block, rows: pa.Table, k: int, width: int = SEGMENT) -> tuple[np.ndarray, ...]:
    """query, slot, upper, lower of the documents of one segment whose upper bound reaches the k-th largest lower bound."""
    high, low = (np.zeros((block.size, width), np.int64) for _ in range(2))
    for term, slots, impacts in zip(*(rows.column(c) for c in ("term", "slots", "impacts")), strict=True):
        q, w = block.by_term[term.as_py()]
        at, byte = np.frombuffer(slots.as_buffer(), np.uint16), np.frombuffer(impacts.as_buffer(), np.uint8)
        high[q[:, None], at] += w[:, None] * UPPER[byte]
        low[q[:, None], at] += w[:, None] * LOWER[byte]
    bar = np.partition(low, -k, axis=1)[:, -k] if k <= width else np.zeros(block.size, np.int64)
    q, slot = np.nonzero((high > 0) & (high >= bar[:, None]))
    return q, slot, high[q, slot], low[q, slot]


def rescored(block: Block, rows: pa.Table, q: np.ndarray, slot: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The exact scores of documents (``slot``) of one segment for queries."""
    slots, column = np.unique(slot, return_inverse=True)
    of = np.full(int(slots[-1]) + 1, -1)
    of[slots] = np.arange(len(slots))
    total = np.zeros((block.size, len(slots)), np.int64)
    for term, at, tfs in zip(*(rows.column(c) for c in ("term", "slots", "tfs")), strict=True):
        queries, w = block.by_term[term.as_py()]
        at = np.frombuffer(at.as_buffer(), np.uint16)
        some = at < len(of)
        some[some] = of[at[some]] >= 0
        at = at[some]
        exact = impact(np.frombuffer(tfs.as_buffer(), np.int32)[some], m[at])
        total[queries[:, None], of[at]] += w[:, None] * exact
    return total[q, column]


def _search_block(index: Index, items: list, item_type: str, k: int) -> DataFrame:
    """item, rank, id, score for some queries (item, terms)."""
    spark = index.rows.sparkSession
    counts = [c for _, c in items]
    wanted = sorted({t for c in counts for t in c})
    terms = spark.createDataFrame([(t,) for t in wanted], "term string")
    named = index.rows.filter("term IS NOT NULL").join(F.broadcast(terms), "term", "left_semi")
    holding = dict(map(tuple, named.groupBy("term").agg(F.sum("n")).collect()))  # at most the terms of this block
    block = Block(counts, holding, index.documents)
    sent, width = spark.sparkContext.broadcast(block), index.width
    weighed = spark.createDataFrame([(t,) for t in block.by_term], "term string")
    named = index.rows.filter("term IS NOT NULL").join(F.broadcast(weighed), "term", "left_semi")

    def first(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, slot, high, low = bounds(sent.value, pa.Table.from_batches(batches), k, width)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), key[0].as_py(), np.int64)), *map(pa.array, (q, slot, high, low))], names=["seg", "q", "slot", "high", "low"])

    found = checkpoint(named.select("seg", "term", "slots", "impacts").groupBy("seg").applyInArrow(first, "seg long, q long, slot long, high long, low long"))
    best = Window.partitionBy("q").orderBy(F.desc("low"))
    bars = found.filter("low > 0").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).groupBy("q").agg(F.min("low").alias("bar"), F.count("*").alias("n"))
    bars = bars.filter(F.col("n") >= k).select("q", "bar")  # at most a row a query
    left = found.join(F.broadcast(bars), "q", "left").filter(F.col("high") >= F.coalesce("bar", F.lit(1))).select("seg", "q", "slot")
    documents, total = index.documents, index.terms

    def second(key: tuple, rows: pa.Table, ask: pa.Table) -> pa.Table:
        nothing = rows.schema.field("ids").type.value_type
        if not ask.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], nothing), "score": pa.array([], pa.int64())})
        is_head = rows.column("term").is_null()
        head = rows.filter(is_head)
        ids = head.column("ids").combine_chunks().flatten()
        m = norm(np.frombuffer(head.column("lengths")[0].as_buffer(), np.int32), documents, total)
        q, slot = ask.column("q").to_numpy(), ask.column("slot").to_numpy()
        score = rescored(sent.value, rows.filter(pc.invert(is_head)), q, slot, m)
        return pa.table({"q": pa.array(q), "id": ids.take(pa.array(slot)), "score": pa.array(score)})

    heads = index.rows.filter("term IS NULL").select("seg", "term", "slots", "tfs", "ids", "lengths")
    both = named.select("seg", "term", "slots", "tfs", "ids", "lengths").unionByName(heads)
    scored = both.groupBy("seg").cogroup(left.groupBy("seg")).applyInArrow(second, f"q long, id {index.id_type}, score long")
    ranked = scored.filter("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id")))).filter(F.col("rank") <= k)
    keys = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], f"q long, item {item_type}")
    return checkpoint(ranked.join(F.broadcast(keys), "q").select("item", "rank", "id", "score"))


def search(index: Index, queries: DataFrame, k: int = K, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, rank (from 1), id, score: the k documents of each query row of highest positive score."""
    if k < 1:
        raise ValueError("k must be at least 1")
    spark, kind = queries.sparkSession, queries.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item {kind}, rank int, id {index.id_type}, score long")
    rows = ((r[0], Counter(w.decode() for w in words_of(r[1]))) for r in queries.select(item_col, text_col).toLocalIterator())
    while items := list(islice(rows, QUERIES_AT_ONCE)):
        out = out.union(_search_block(index, items, kind, k))
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(build_index(load(spark, sf_dir, "documents")), load(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS terms FROM documents
), t AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) GROUP BY ALL
), totals AS (SELECT count(*) AS n, sum(len(terms)) AS l FROM d WHERE len(terms) > 0
), m AS (SELECT rid, doc_id, 25 + ((75 * len(terms) * n) // l)::BIGINT AS m FROM d, totals WHERE len(terms) > 0
), w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, totals GROUP BY term, n
), q AS (SELECT iid, item_id, term, count(*) AS qn FROM (SELECT row_number() OVER () AS iid, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL
), s AS (
  SELECT iid, item_id, doc_id, rid, sum(qn * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {K}
"""

QUERIES = {"op12_lexical_search": op12_lexical_search}
ORACLES = {"op12_lexical_search": SQL}
