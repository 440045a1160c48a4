"""Sharding by weighted rendezvous hashing.

Every shard draws a pseudorandom score for every record key from a hash of (key, shard name); the
record goes to the shard with the least ``-ln(u) / weight``. A score depends on nothing but the key
and the one shard, so adding a shard moves only the records which the new shard wins, and a change of
one weight moves records to or from that shard alone. Placement is a plain projection: no shuffle.

Defined cases: a null key hashes as the reserved text ``null``; a null text has no bytes (crc32 of
the empty string, size 16); equal rows get the same shard and different slots; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load

#: Slots are numbered in this many hashed chunks of a shard, so that no task sorts a whole shard.
CHUNKS = 512
SHARDS = 40


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard (int, from 0) of each key, shards weighted by ``weights`` (all above 0)."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    scored = [
        F.struct(
            (-F.log((F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{i}"))), 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48) / float(w)).alias("score"),
            F.lit(i).alias("shard"),
        )
        for i, w in enumerate(weights)
    ]
    return (F.least(*scored) if len(scored) > 1 else scored[0])["shard"]


def slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", chunks: int = CHUNKS) -> DataFrame:
    """Number the rows of every shard from 0 without gaps.

    Two levels: rows are counted per (shard, chunk), the chunk counts are summed up, and rows are
    numbered inside their chunk; a shard with a third of all rows is spread over ``chunks`` tasks.
    """
    df = df.withColumn("_chunk", F.conv(F.substring(F.md5(F.coalesce(F.col(order[0]).cast("string"), F.lit("null"))), 1, 6), 16, 10).cast("int") % chunks)
    base = (
        df.groupBy(shard, "_chunk").agg(F.count("*").alias("_n"))
        .withColumn("_base", F.sum("_n").over(Window.partitionBy(shard).orderBy("_chunk")) - F.col("_n"))
        .drop("_n")
    )
    rank = F.row_number().over(Window.partitionBy(shard, "_chunk").orderBy(*order)) - 1
    return (
        df.withColumn("_rank", rank).join(base, [shard, "_chunk"])
        .withColumn(slot, (F.col("_base") + F.col("_rank")).cast("long"))
        .drop("_chunk", "_rank", "_base")
    )


def shard_documents(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row: id, size, text_crc32, law, shard, slot, grown_shard (with one more shard of mean weight)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    grown = [*weights, sum(weights) / len(weights)]
    placed = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(id_col), weights).alias("shard"),
        rendezvous(F.col(id_col), grown).alias("grown_shard"),
    )
    return slots(placed, "shard", [id_col, "text_crc32", "size"])


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(load(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


_SCORE = "-ln((('0x' || substr(md5(k || ':' || s), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / 1.0"

#: The text's CRC-32 (reflected polynomial 0xEDB88320) is a fold over its bytes.
SQL = f"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents
), sized AS (
  SELECT doc_id, k, octet_length(encode(text)) + 16 AS size, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS text_crc32
  FROM docs, crc
), scored AS (
  SELECT k, arg_min(s, ({_SCORE}, s)) FILTER (s < {SHARDS}) AS shard, arg_min(s, ({_SCORE}, s)) AS grown_shard
  FROM (SELECT DISTINCT k FROM docs), range({SHARDS + 1}) r(s) GROUP BY k
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k), 1, 6))::BIGINT % {CHUNKS}, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  grown_shard::INTEGER AS grown_shard
FROM sized JOIN scored USING (k)
"""

QUERIES = {"op1_rendezvous_sharding": op1_rendezvous_sharding}
ORACLES = {"op1_rendezvous_sharding": SQL}
