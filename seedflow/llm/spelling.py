"""Spelling variants: words within one edit, by a positional q-gram inverted index with a count filter.

Words are maximal runs of letters with A-Z lower-cased; by a checksum of document and run, one occurrence
in ``LOSSY`` loses a code point (the planted typing errors of the task). A task counts the runs of its
documents and gives back partial counts whenever it holds ``HELD`` words.

Index: a word of length n, padded by ``Q - 1`` marks on both sides, has n + Q - 1 grams of ``Q`` code points,
each with its position. One edit leaves all but ``Q`` of the longer word's grams, in order, at the same
place or (behind an insertion) one further: two words within one edit have the count filter's bound of
``max(grams) - Q`` positional grams in common. So one of the ``Q + 1`` rarest grams of each is common to
both, and only these are put into posting lists; rarity is a count of grams by ``BUCKETS`` hash buckets, of
equal ones the code decides, which is one order for all words.

Merge: posting lists are dealt out by their gram to shards of about ``SHARD`` postings. A shard's
postings stand sorted by (length, gram, position), so the lists that a word is merged with are ranges of
an array: for words of its own length those at its position, for words one longer those at its position and
the next. Every pair so found is counted over all positional grams of both words, kept if it reaches the
bound, and verified: one differing code point, or a common start and end that make up the shorter word. A pair
that meets in several lists is kept in the first alone.

Skew: a gram of more than ``MOST`` postings is cut into (position, length) lists of its own, and a list of
more than ``MOST`` postings into blocks, whose pairs are tasks. Near words are counted as rows (word, near
word), pre-aggregated, never gathered; roots follow forms by pointer jumping, with hot roots salted.

Defined cases: a null text has no words; a null id is written ``null``; repeated rows count each; words of
any length are compared within ``CELLS`` cells of memory at a time; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import checkpoint, checkpoint_table, join_hot, load

RUN = "[a-zÀ-ÿ]+"
LOSSY = 97
MIN_LENGTH, MIN_COUNT = 5, 3
Q = 4
HELD = 1 << 17
BUCKETS = 1 << 18
SHARD, MOST = 50_000, 20_000
#: Cells (pairs x grams) that are compared at a time.
CELLS = 1 << 22
BROADCAST_ROWS = 100_000


# -- words


def runs_of(text: str | None) -> list[str]:
    return re.findall(RUN, text.encode().lower().decode()) if text else []


def misspelt(prefix: int, run: str) -> str:
    """The run, or, if ``LOSSY`` divides its checksum, the run without one code point; ``prefix``: the checksum of what stands before it."""
    h = zlib.crc32(run.encode(), prefix)
    if h % LOSSY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_COUNT, length: int = MIN_LENGTH) -> DataFrame:
    """word, n: words of at least ``length`` code points that occur ``least`` times."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                prefix = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(runs_of(text.as_py())).items():
                    word = misspelt(prefix, word)
                    if len(word) >= length:
                        held[word] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    named = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# -- grams


def letters(words: list[str], n: int) -> np.ndarray:
    """Code points of words of one length, one row each (all below 256)."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), n)


def grams(chars: np.ndarray) -> np.ndarray:
    """The padded positional grams of words of one length, as numbers."""
    n = chars.shape[1]
    padded = np.ones((len(chars), n + 2 * (Q - 1)), np.uint32)
    padded[:, Q - 1 : Q - 1 + n] = chars
    out = np.zeros((len(chars), n + Q - 1), np.uint32)
    for j in range(Q):
        out = out << np.uint32(8) | padded[:, j : j + n + Q - 1]
    return out


def bucket(code: np.ndarray) -> np.ndarray:
    return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)  # the first 18 bits


def prefixes(codes: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """Places of the ``Q + 1`` rarest grams of each word, rarest first; equal grams by place."""
    rank = frequency[bucket(codes)] << np.int64(32) | codes.astype(np.int64)
    return np.argsort(rank, axis=1, kind="stable")[:, : Q + 1]


def by_length(words: list[str], most: int = CELLS) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths, and places of some of the words of that length: as many as have ``most`` letters, or one."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        step = max(most // int(n), 1)
        for k in range(0, len(at), step):
            yield int(n), at[k : k + step]


def gram_frequency(words: DataFrame) -> np.ndarray:
    """Number of grams of all words in each of ``BUCKETS`` hash buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            some = b.column(0).to_pylist()
            for n, at in by_length(some):
                total += np.bincount(bucket(grams(letters([some[i] for i in at], n)).ravel()), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    found = words.select("word").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("b").to_numpy()] = np.minimum(found.column("n").to_numpy(), (1 << 31) - 1)
    return out


def postings(words: DataFrame, frequency) -> DataFrame:
    """gram, pos, slot (its place among the word's rarest), word, len, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some, counts = b.column(0).to_pylist(), b.column(1).to_numpy()
            for n, at in by_length(some, CELLS // 8):
                own = [some[i] for i in at]
                codes = grams(letters(own, n))
                first = prefixes(codes, frequency.value)
                k = first.shape[1]
                rows = np.repeat(np.arange(len(own)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.take_along_axis(codes, first, 1).ravel().astype(np.int64)), pa.array(first.ravel().astype(np.int32)), pa.array(np.tile(np.arange(k, dtype=np.int32), len(own))),
                        pa.array(own, pa.string()).take(pa.array(rows)), pa.array(np.full(len(rows), n, np.int32)), pa.array(counts[at][rows]),
                    ],
                    names=["gram", "pos", "slot", "word", "len", "n"],
                )

    return words.select("word", "n").mapInArrow(run, "gram long, pos int, slot int, word string, len int, n long")


# -- merging


def _ranges(lo: np.ndarray, hi: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every i and every j of its range, about ``most`` at a time; a longer range is cut."""
    n = np.maximum(hi - lo, 0)
    ends, at = np.cumsum(n), 0
    while at < len(n):
        base = ends[at - 1] if at else 0
        stop = max(int(np.searchsorted(ends, base + most, side="right")), at + 1)
        for start in range(0, int(n[at]) if stop == at + 1 else 1, most):
            m = np.minimum(n[at:stop] - start, most) if stop == at + 1 else n[at:stop]
            i = np.repeat(np.arange(at, stop), m)
            yield i, np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[at:stop] + start, m)
        at = stop


class Lists:
    """The postings of one length, in the order of their lists."""

    def __init__(self, rows: np.ndarray, n: int, words: list[str], gram: np.ndarray, pos: np.ndarray, slot: np.ndarray, part: np.ndarray, frequency: np.ndarray):
        self.rows = rows[np.lexsort((pos[rows], gram[rows]))]
        self.chars = letters([words[i] for i in self.rows], n)
        self.codes = grams(self.chars)
        self.first = prefixes(self.codes, frequency)
        self.first_codes = np.take_along_axis(self.codes, self.first, 1)
        self.gram, self.pos, self.slot, self.part = gram[self.rows], pos[self.rows], slot[self.rows], part[self.rows]
        self.n = n

    def names(self, shard: np.ndarray) -> np.ndarray:
        """The list of each posting as a number: the gram's rank among the shard's, then the position."""
        return np.searchsorted(shard, self.gram) << np.int64(32) | self.pos


def near_pairs(words: list[str], gram: np.ndarray, pos: np.ndarray, slot: np.ndarray, role: np.ndarray, part: np.ndarray, apart: bool, frequency: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of two words that are within one edit and meet here first.

    ``role`` 0: any; 1: not the longer word; 2: only the longer word. ``apart``: pairs of different ``part`` only.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    shard = np.unique(gram)
    pos = pos.astype(np.int64)
    for n in np.unique(lengths):
        n = int(n)
        own = np.flatnonzero((lengths == n) & (role != 2))
        if not len(own):
            continue
        a = Lists(own, n, words, gram, pos, slot, part, frequency)
        key = a.names(shard)
        stop = np.searchsorted(key, key, side="right")
        yield from _pairs(a, a, _ranges(np.arange(len(key)) + 1, stop, max(CELLS // (n + Q), 1)), apart)
        longer = np.flatnonzero((lengths == n + 1) & (role != 1))
        if not len(longer):
            continue
        b = Lists(longer, n + 1, words, gram, pos, slot, part, frequency)
        other = b.names(shard)
        # positions p and p + 1 of one gram stand next to each other
        yield from _pairs(a, b, _ranges(np.searchsorted(other, key), np.searchsorted(other, key + 1, side="right"), max(CELLS // (n + Q), 1)), apart)


def _pairs(a: Lists, b: Lists, found: Iterator[tuple[np.ndarray, np.ndarray]], apart: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n, k, same = a.n, a.n + Q - 1, a.n == b.n
    bound = b.n + Q - 1 - Q
    for i, j in found:
        if apart:
            cut = a.part[i] != b.part[j]
            i, j = i[cut], j[cut]
        # count filter
        x = a.codes[i]
        common = x == b.codes[j, :k]
        if not same:
            common |= x == b.codes[j, 1:]
        enough = common.sum(axis=1) >= bound
        i, j = i[enough], j[enough]
        if not len(i):
            continue
        # verification
        x, y = a.chars[i], b.chars[j]
        if same:
            near = (x != y).sum(axis=1) == 1
        else:
            start = np.cumprod(x == y[:, :n], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
            end = np.cumprod((x == y[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
            near = start + end >= n
        i, j = i[near], j[near]
        if not len(i):
            continue
        # the first common posting of the two words
        p, q = a.first[i][:, :, None], b.first[j][:, None, :]
        meet = (a.first_codes[i][:, :, None] == b.first_codes[j][:, None, :]) & ((p == q) | ((p + 1 == q) & (not same)))
        first = meet.reshape(len(i), -1).argmax(axis=1)
        here = first == a.slot[i] * meet.shape[2] + b.slot[j]
        yield a.rows[i[here]], b.rows[j[here]]


def dealt(lists: DataFrame, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """Postings with the task (k1, k2, k3, b1, b2) that they go to, their role there and their block."""
    sizes = checkpoint(lists.groupBy("gram").agg(F.count("*").alias("_n")))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    heavy = checkpoint(sizes.filter(F.col("_n") > most).select("gram"))
    shards = max(total // shard, 1)
    light = lambda df: df.select(
        F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("k1"), F.lit(-1).alias("k2"), F.lit(-1).alias("k3"), F.lit(0).alias("b1"), F.lit(0).alias("b2"), F.lit(0).alias("role"), F.lit(0).alias("part"), "gram", "pos", "slot", "word", "n"
    )
    count = heavy.count()
    if not count:
        return light(lists)
    small = F.broadcast if count <= BROADCAST_ROWS else (lambda d: d)
    cells = F.array(
        F.struct(F.col("pos").alias("k2"), F.col("len").alias("k3"), F.lit(1).alias("role")),
        F.struct(F.col("pos").alias("k2"), (F.col("len") - 1).alias("k3"), F.lit(2).alias("role")),
        F.struct((F.col("pos") - 1).alias("k2"), (F.col("len") - 1).alias("k3"), F.lit(2).alias("role")),
    )
    cut = lists.join(small(heavy), "gram", "left_semi").withColumn("_c", F.explode(cells)).select("*", "_c.*").drop("_c")
    blocks = checkpoint(cut.groupBy("gram", "k2", "k3").agg(F.ceil(F.count("*") / most).cast("int").alias("_b")).filter("_b > 1"))
    small = F.broadcast if blocks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else (lambda d: d)
    cut = cut.join(small(blocks), ["gram", "k2", "k3"], "left").withColumn("_b", F.coalesce("_b", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("word"), F.col("_b")).cast("int"))
    cut = cut.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    cut = cut.select(F.col("gram").alias("k1"), "k2", "k3", F.least("part", "_j").alias("b1"), F.greatest("part", "_j").alias("b2"), "role", "part", "gram", "pos", "slot", "word", "n")
    return light(lists.join(small(heavy) if count <= BROADCAST_ROWS else heavy, "gram", "left_anti")).unionByName(cut)


def near_words(words: DataFrame, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """word, near, near_n: every pair of ``words`` (word, n; distinct, of at least ``Q + 1`` code points below 256) within one edit, in both directions."""
    ship(words.sparkSession)
    frequency = words.sparkSession.sparkContext.broadcast(gram_frequency(words))
    lists = checkpoint_table(postings(words, frequency), "spelling-postings")

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        word, n = t.column("word").combine_chunks(), t.column("n").to_numpy()
        gram, pos, slot, role, part = (t.column(c).to_numpy() for c in ("gram", "pos", "slot", "role", "part"))
        for i, j in near_pairs(word.to_pylist(), gram, pos, slot, role, part, key[3].as_py() != key[4].as_py(), frequency.value):
            for x, y in ((i, j), (j, i)):
                yield pa.RecordBatch.from_arrays([word.take(pa.array(x)), word.take(pa.array(y)), pa.array(n[y])], names=["word", "near", "near_n"])

    tasks = dealt(lists, shard, most)
    return tasks.groupBy("k1", "k2", "k3", "b1", "b2").applyInArrow(merge, "word string, near string, near_n long")


# -- forms and roots


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word of ``forms`` (word, form; forms have no cycle): the last form."""
    chain = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        step = join_hot(chain, chain.select(F.col("word").alias("_w"), F.col("root").alias("_r")), "root", "_w", "left")
        step = checkpoint(step.select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")))
        chain = step.select("word", "root")
        if not step.filter("_moved").limit(1).count():
            return chain


def variants(words: DataFrame, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``words`` (word, n)."""
    best = near_words(words, shard, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    best = checkpoint(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("b.m") >= 2 * F.col("n"), F.col("b")).alias("b")))
    out = best.select("word", "n", "n_near", F.col("b.w").alias("form"), (-F.col("b.m")).alias("form_n"))
    last = roots(out.filter(F.col("form").isNotNull()))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(checkpoint_table(word_counts(load(spark, sf_dir, "documents")), "spelling-words"))


_CRC = "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({})), '..'), lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"

#: The checksum is a fold over bytes; words within one edit share what is left when a letter is taken from one or both.
SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), run AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, 'null') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
  ) GROUP BY ALL
), hashed AS (SELECT run, n, {_CRC.format("id || ':' || run")} AS h, length(run) AS len FROM run, crc
), lost AS (SELECT CASE WHEN h % {LOSSY} = 0 THEN substr(run, 1, (h % len)::BIGINT) || substr(run, (h % len)::BIGINT + 2) ELSE run END AS word, n FROM hashed
), w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM lost WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}
), cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word
), ranked AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near
), best AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN (SELECT * FROM ranked WHERE r = 1) x ON x.word = w.word
), chain AS (
  SELECT word, word AS at, form AS up FROM best
  UNION ALL SELECT chain.word, chain.up, best.form FROM chain JOIN best ON best.word = chain.up
)
SELECT best.word, form, chain.at AS root, n, n_near, form_n FROM best JOIN chain ON chain.word = best.word AND chain.up IS NULL
"""

QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLES = {"op11_spelling_variants": SQL}
