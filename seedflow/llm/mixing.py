"""Mixing sources to target weights, by blocks.

Every source's documents, in a fixed order, are one stream of words that is cut into blocks; a document
overlaps one or more blocks. Targets come from the weights by water filling, never above ``CAP`` times a
source's size; of equal ratios of limit and weight, the first source in order tells the level. A block has
``BLOCK`` words, or a ``GRAIN``-th of the source's target where that is less (one word at least), so rounding
to whole blocks moves a source by less than a hundredth. The mix is a list of slots in output shards of
``SHARD_SLOTS`` slots:

1. every source gets its number of slots (blocks * target / size); the slots of all sources stand in
   line, and a pseudorandom permutation of the line deals them to shards. The counts of sources in a
   shard are then a multinomial draw conditional on the totals (without the noise in the totals that
   would push a source off its target or above its cap);
2. each shard has a span of its own of every source's index permutations, its share of the source's
   blocks, and takes as many of it as its count says: once, then again through the permutation of the
   next turn, up to ``CAP`` turns. So the draw decides which blocks are taken how often. What a shard's
   count has above ``CAP`` spans goes to the source's other shards in proportion to the room they have;
3. blocks are joined to documents by (source, index), and a document's taken words are summed up.

Both permutations are swap-or-not shuffles: rounds of arithmetic on the index alone, exact for any
length, so that no sort is needed. All is DataFrame functions. Hot sources: positions in a source are
prefix sums in two levels over ``CHUNKS`` hashed chunks, and room in a source's shards in two levels over
``CHUNK_SHARDS`` shards; slots are exploded in pieces of
``PIECE``; joins are on (source, index). Tables of one row a source are ordered in one task; there is
one row a (source, shard) with blocks. Reruns agree: nothing depends on partitioning or time.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a
document without words takes 0; equal rows are separate documents, each with its own place; an empty
table gives an empty result; the operator reads the named columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, load, source_key

BLOCK = 128
#: A source takes at least so many blocks, if its target has as many words.
GRAIN = 64
#: An output shard is one training batch: so many blocks.
SHARD_SLOTS = 256
WEIGHTS = (5, 2, 1)
CAP = 3
CHUNKS = 512
CHUNK_SHARDS = 4096
PIECE = 4096
ROUNDS = 16
SEED = 20
#: A table of sources up to this many rows is sent to every executor; a larger one is joined by shuffle.
BROADCAST_ROWS = 10_000


def _md5_int(text: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(text), at, 7), 16, 10).cast("long")


def rounds(name: Column, n: Column) -> Column:
    """The rounds of a swap-or-not permutation of 0 to n - 1: pivots and coefficients from md5(name:round)."""

    def one(r: Column) -> Column:
        t = F.concat(name, F.lit(":"), r.cast("string"))
        return F.struct((_md5_int(t, 1) * 268435456 + _md5_int(t, 8)).alias("p"), _md5_int(t, 15).alias("m"), _md5_int(t, 22).alias("c"), n.alias("n"))

    return F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), one)


def permuted(index: Column, how: Column) -> Column:
    """The place of ``index`` under the permutation ``how`` of ``rounds``."""

    def swap(x: Column, r: Column) -> Column:
        other = (r["p"] - x) % r["n"]
        other = F.when(other < 0, other + r["n"]).otherwise(other)
        y = F.greatest(x, other)
        bit = F.shiftright((r["m"] * 2 + 1) * (y % 4294967296) + r["c"] * 65537 + F.shiftright(y, 32) * 2654435761, 28).bitwiseAND(1)
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(how, index, swap)


def place(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: str) -> DataFrame:
    """Rows with their size, source key and the chunk and rank which order them inside their source."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(
        F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("tie"), *more,
    )
    # rows without an id are told apart by their size
    name = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.col("size").cast("string"))
    out = out.withColumn("chunk", (_md5_int(name, 1) % CHUNKS).cast("int"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("key", "chunk").orderBy("id", "size", "tie")))


def targets(placed: DataFrame, block: int = BLOCK, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """key, source_size, target, block, n_blocks, slots, first_slot, all_slots: one row a source. ``block``: the longest block."""
    per = placed.groupBy("key").agg(F.sum("size").alias("source_size"))
    # the key of a null source is empty, and stands last
    order = F.row_number().over(Window.orderBy((F.col("key") == ""), "key")) - 1
    weighed = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("limit", F.col("source_size") * cap).withColumn("ratio", F.col("limit") / F.col("w"))
    up = Window.orderBy("ratio", (F.col("key") == ""), "key")
    rest = up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - (F.sum("limit").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("limit"))) / F.sum("w").over(rest)
    filled = weighed.withColumn("level", level).withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", (F.col("key") == "").alias("last"), "key", "level"))).over(everything)["level"])
    return (
        filled.withColumn("target", F.least(F.col("limit").cast("double"), F.col("w") * F.col("level")))
        .withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("target") / GRAIN))).cast("long"))
        .withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")))
        .withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("n_blocks") * F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("first_slot", F.sum("slots").over(Window.orderBy((F.col("key") == ""), "key")) - F.col("slots"))
        .select("key", "source_size", "target", "block", "n_blocks", "slots", "first_slot", F.sum("slots").over(everything).alias("all_slots"))
    )


def _pieces(df: DataFrame, count: str, base: Column) -> DataFrame:
    """One row for each number of base to base + count - 1, column ``n``; exploded in two steps, dealt out between them."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is given is not coalesced: the rows are few, what they become is much
    parts = df.filter(F.col(count) > 0).withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / PIECE)))).repartition(tasks)
    first = F.col("_part") * PIECE
    return parts.withColumn("n", F.explode(F.sequence(base + first, base + F.least(first + PIECE, F.col(count)) - 1))).drop("_part")


def shard_counts(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """key, shard, start, span, n: the shard's span of the source's indexes, and how many slots it takes; drawn, and kept within ``CAP`` spans."""
    line = sources.withColumn("how", rounds(F.lit(f"{seed}:line"), F.col("all_slots")))
    line = _pieces(line, "slots", F.col("first_slot")).select("key", F.floor(permuted(F.col("n"), F.col("how")) / shard_slots).alias("shard"))
    drawn = line.groupBy("key", "shard").agg(F.count("*").alias("drawn"))
    shards = F.ceil(F.col("all_slots") / shard_slots)
    blocks = F.col("n_blocks")
    # shards that have a span: all of them, or those of the source's few blocks
    k = F.when(blocks >= shards, F.col("i")).otherwise(F.ceil((F.col("i") + 1) * shards / blocks) - 1).cast("long")
    owned = sources.filter("slots > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(shards, blocks) - 1)))
    owned = owned.select("key", "slots", k.alias("shard"), F.floor(blocks * k / shards).alias("start"), F.floor(blocks * (k + 1) / shards).alias("_end")).withColumn("span", F.col("_end") - F.col("start"))
    both = owned.join(drawn, ["key", "shard"], "left")
    both = both.withColumn("kept", F.least(F.coalesce("drawn", F.lit(0)), CAP * F.col("span"))).withColumn("room", CAP * F.col("span") - F.col("kept"))
    both = checkpoint(both.withColumn("chunk", F.floor(F.col("shard") / CHUNK_SHARDS)))
    sums = both.groupBy("key").agg((F.first("slots") - F.sum("kept")).alias("missing"), F.sum("room").alias("rooms"))
    chunks = both.groupBy("key", "chunk").agg(F.sum("room").alias("_n")).withColumn("_base", F.sum("_n").over(Window.partitionBy("key").orderBy("chunk")) - F.col("_n")).drop("_n")
    inside = F.sum("room").over(Window.partitionBy("key", "chunk").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_in", inside).join(chunks, ["key", "chunk"]).join(_small(sums), "key").withColumn("upto", F.col("_base") + F.col("_in"))
    share = lambda c: F.when(F.col("rooms") > 0, F.floor(c.cast("decimal(19,0)") * F.col("missing").cast("decimal(19,0)") / F.col("rooms"))).otherwise(0).cast("long")
    return both.select("key", "shard", "start", "span", (F.col("kept") + share(F.col("upto")) - share(F.col("upto") - F.col("room"))).cast("long").alias("n"))


def draw(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """shard, key, block: the mix, one row a slot."""
    counts = shard_counts(sources, shard_slots, seed).withColumnRenamed("n", "count")
    numbered = _pieces(counts, "count", F.lit(0).cast("long")).join(_small(sources.select("key", "n_blocks")), "key")
    turns = F.transform(F.sequence(F.lit(0), F.lit(CAP - 1)), lambda e: rounds(F.concat(F.lit(f"{seed}:"), F.col("key"), F.lit(":"), e.cast("string")), F.col("n_blocks")))
    numbered = numbered.join(_small(sources.select("key", turns.alias("turns"))), "key")
    turn = F.get("turns", F.floor(F.col("n") / F.col("span")).cast("int"))
    return numbered.select("shard", "key", permuted(F.col("start") + F.col("n") % F.col("span"), turn).alias("block"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table of sources if it is proven small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _started(placed: DataFrame) -> DataFrame:
    """With ``start``, the number of words before the document in its source."""
    chunks = placed.groupBy("key", "chunk").agg(F.sum("size").alias("_n")).withColumn("_base", F.sum("_n").over(Window.partitionBy("key").orderBy("chunk")) - F.col("_n")).drop("_n")
    inside = F.sum("size").over(Window.partitionBy("key", "chunk").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return placed.withColumn("_in", inside).join(chunks, ["key", "chunk"]).withColumn("start", F.col("_base") + F.col("_in")).drop("_base", "_in")


def _parts(started: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each block that a document overlaps, with the source's block length ``long``."""
    started = started.join(_small(sources.select("key", F.col("block").alias("long"))), "key")
    return started.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("long")), F.floor((F.col("start") + F.greatest(F.col("size") - 1, F.lit(0))) / F.col("long")))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """id, key, chunk, rank, size, start, source_size, target, long (the source's block length), taken; times: how often each
    block is taken that the document overlaps, first to last; shards: the output shards that hold some of them."""
    placed = checkpoint(place(docs, id_col, text_col, source_col).drop("tie"))
    sources = checkpoint(targets(placed, block))
    times = draw(sources, shard_slots, seed).groupBy("key", "block").agg(F.count("*").alias("times"), F.collect_set("shard").alias("shards"))  # a block is taken CAP times at most
    joined = _parts(_started(placed), sources).join(times, ["key", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("long")) - F.greatest(F.col("start"), F.col("block") * F.col("long"))
    per = joined.groupBy("key", "chunk", "rank", "id", "size", "start").agg(
        F.sum(words * F.col("times")).cast("long").alias("taken"), F.sort_array(F.collect_list(F.struct("block", "times"))).alias("_t"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("size") > 0, F.col("shards")))))).alias("shards"),
    )
    return per.withColumn("times", F.transform("_t", lambda t: t["times"])).drop("_t").join(_small(sources.select("key", "source_size", "target", F.col("block").alias("long"))), "key")


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, key, block, text: the output shards, one row a slot, with the words of its block joined by spaces. Write it partitioned by shard."""
    placed = checkpoint(place(docs, id_col, text_col, source_col, text_col))
    sources = checkpoint(targets(placed, block))
    slots = checkpoint(draw(sources, shard_slots, seed))
    first = F.col("block") * F.col("long") - F.col("start")
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), 0)
    parts = _parts(_started(placed.filter("size > 0")), sources)
    cut = parts.select("key", "block", "start", F.array_join(F.slice(words, F.greatest(first, F.lit(0)).cast("int") + 1, F.least(F.col("size"), first + F.col("long")).cast("int") - F.greatest(first, F.lit(0)).cast("int")), " ").alias("_w"))
    whole = cut.groupBy("key", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "_w"))), lambda p: p["_w"]), " ").alias("text"))
    return slots.join(whole, ["key", "block"]).select("shard", "key", "block", "text")


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix as documents: all columns, one row for each time (1 to 3) a document, or part of it, is taken.

    Where all of a document is taken, its text stays as it is; else ``text`` holds the taken words,
    joined by spaces, and ``n_chars`` its length.
    """
    taken = mix(docs, block=block, seed=seed).filter("taken > 0").select("key", "chunk", "rank", "start", "times", "long")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    texts = place(docs.withColumn("_row", whole), "doc_id", "text", "source", "_row").select("key", "chunk", "rank", "_row")
    both = texts.join(taken, ["key", "chunk", "rank"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.array_max("times").cast("int"))))
    words = F.regexp_extract_all(F.col("_row")["text"], F.lit(WORD), 0)
    first = F.floor(F.col("start") / F.col("long"))
    some = F.array_join(F.filter(words, lambda w, i: F.get("times", (F.floor((F.col("start") + i) / F.col("long")) - first).cast("int")) >= F.col("_copy")), " ")
    text = F.when(F.array_min("times") >= F.col("_copy"), F.col("_row")["text"]).otherwise(some)
    out = both.withColumn("_text", text)
    return out.select(*[(F.col("_text") if c == "text" else F.char_length("_text").cast("long") if c == "n_chars" else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also n_shards and first_shard: how many output shards hold some of the document, and the least of them."""
    mixed = mix(load(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.size("shards").cast("long").alias("n_shards"), F.array_min("shards").alias("first_shard"))


def _sql_int(text: str, at: int) -> str:
    return f"('0x' || substr(md5({text}), {at}, 7))::BIGINT"


def _sql_rounds(name: str, n: str) -> str:
    t = f"({name} || ':' || r)"
    return f"list_transform(range(1, {ROUNDS + 1}), lambda r: {{'x': 0::BIGINT, 'p': {_sql_int(t, 1)} * 268435456 + {_sql_int(t, 8)}, 'm': {_sql_int(t, 15)}, 'c': {_sql_int(t, 22)}, 'n': ({n})::BIGINT}})"


def _sql_permuted(index: str, how: str) -> str:
    other = "(((r.p - a.x) % r.n + r.n) % r.n)"
    y = f"greatest(a.x, {other})"
    bit = f"(((r.m * 2 + 1) * ({y} % 4294967296) + r.c * 65537 + ({y} >> 32) * 2654435761) >> 28) & 1"
    return f"list_reduce(list_prepend({{'x': ({index})::BIGINT, 'p': 0::BIGINT, 'm': 0::BIGINT, 'c': 0::BIGINT, 'n': 0::BIGINT}}, {how}), lambda a, r: {{'x': CASE WHEN {bit} = 1 THEN {other} ELSE a.x END, 'p': r.p, 'm': r.m, 'c': r.c, 'n': r.n}}).x"


SQL = f"""
WITH d0 AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    row_number() OVER () AS rid FROM documents
), d AS (
  SELECT *, {_sql_int("(coalesce(doc_id::VARCHAR, 'null') || ':' || size)", 1)} % {CHUNKS} AS chunk FROM d0
), s1 AS (
  SELECT key, sum(size)::BIGINT AS source_size, ([{", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)}])[(row_number() OVER (ORDER BY key = '', key) - 1) % {len(WEIGHTS)} + 1] AS w FROM d GROUP BY key
), s2 AS (SELECT *, source_size * {CAP} AS cap, source_size * {CAP} / w AS ratio FROM s1
), s3 AS (
  SELECT *, (sum(source_size) OVER () - (sum(cap) OVER (ORDER BY ratio, key = '', key ROWS UNBOUNDED PRECEDING) - cap))::DOUBLE
    / sum(w) OVER (ORDER BY ratio, key = '', key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s2
), s4 AS (
  SELECT key, source_size, least(cap::DOUBLE, w * (SELECT lev FROM s3 WHERE ratio >= lev ORDER BY ratio, key = '', key LIMIT 1)) AS target FROM s3
), s45 AS (
  SELECT *, ceil(source_size / block)::BIGINT AS n_blocks FROM (SELECT *, greatest(1, least({BLOCK}, floor(target / {GRAIN})))::BIGINT AS block FROM s4)
), s5 AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(n_blocks * target / source_size) ELSE 0 END::BIGINT AS slots FROM s45
), s AS (
  SELECT *, (sum(slots) OVER (ORDER BY key = '', key) - slots)::BIGINT AS first_slot, (sum(slots) OVER ())::BIGINT AS all_slots FROM s5
), line AS (
  SELECT key, {_sql_permuted("i", "how")} // {SHARD_SLOTS} AS shard FROM (SELECT key, {_sql_rounds(f"'{SEED}:line'", "all_slots")} AS how, unnest(range(first_slot, first_slot + slots)) AS i FROM s)
), drawn AS (SELECT key, shard, count(*) AS drawn FROM line GROUP BY ALL
), k AS (SELECT *, (all_slots + {SHARD_SLOTS} - 1) // {SHARD_SLOTS} AS shards FROM s WHERE slots > 0
), own AS (
  SELECT key, slots, shard, n_blocks * shard // shards AS start, n_blocks * (shard + 1) // shards - n_blocks * shard // shards AS span
  FROM (SELECT key, slots, n_blocks, shards, CASE WHEN n_blocks >= shards THEN i ELSE ((i + 1) * shards + n_blocks - 1) // n_blocks - 1 END AS shard FROM (SELECT *, unnest(range(least(shards, n_blocks))) AS i FROM k))
), kept AS (SELECT own.*, least(coalesce(drawn, 0), {CAP} * span) AS kept, {CAP} * span - least(coalesce(drawn, 0), {CAP} * span) AS room FROM own LEFT JOIN drawn USING (key, shard)
), fill AS (
  SELECT *, (slots - sum(kept) OVER (PARTITION BY key))::HUGEINT AS missing, (sum(room) OVER (PARTITION BY key))::HUGEINT AS rooms,
    (sum(room) OVER (PARTITION BY key ORDER BY shard ROWS UNBOUNDED PRECEDING))::HUGEINT AS upto FROM kept
), counts AS (
  SELECT key, shard, start, span, (kept + CASE WHEN rooms > 0 THEN upto * missing // rooms - (upto - room) * missing // rooms ELSE 0 END)::BIGINT AS n FROM fill
), turns AS (
  SELECT key, n_blocks, e, {_sql_rounds(f"'{SEED}:' || key || ':' || e", "n_blocks")} AS how FROM s, range({CAP}) t(e)
), slot AS (
  SELECT key, shard, start, span, unnest(range(n)) AS j FROM counts
), times AS (
  SELECT key, shard, {_sql_permuted("start + j % span", "how")} AS number FROM slot JOIN turns USING (key) WHERE e = j // span
), started AS (
  SELECT *, (sum(size) OVER (PARTITION BY key ORDER BY chunk, doc_id NULLS FIRST, size, rid ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM d
), parts AS (
  SELECT rid, key, size, start, block, unnest(range(start // block, (start + greatest(size - 1, 0)) // block + 1)) AS number FROM started JOIN (SELECT key, block FROM s) USING (key)
), taken AS (
  SELECT rid, coalesce(sum(least(start + size, (number + 1) * block) - greatest(start, number * block)) FILTER (shard IS NOT NULL), 0)::BIGINT AS taken,
    count(DISTINCT shard) FILTER (size > 0) AS n_shards, min(shard) FILTER (size > 0) AS first_shard FROM parts LEFT JOIN times USING (key, number) GROUP BY rid
)
SELECT doc_id, size, source_size, target, taken, n_shards, first_shard FROM d JOIN taken USING (rid) JOIN s USING (key)
"""

QUERIES = {"op7_mixing": op7_mixing}
ORACLES = {"op7_mixing": SQL}
