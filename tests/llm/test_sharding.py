import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seedflow.llm import sharding
from tests.llm.conftest import ROWS


def test_odd_rows_and_law(spark, odd, empty, sf_dir):
    got = sharding.op1_rendezvous_sharding(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 40) for r in got)
    assert sharding.shard_documents(empty, [1.0, 2.0]).count() == 0


def test_weights_and_growth(spark):
    w = [1.0, 2.0, 1.0]
    keys = spark.range(20_000).select("id", sharding.rendezvous(F.col("id"), w).alias("s"), sharding.rendezvous(F.col("id"), [*w, 4.0]).alias("g"))
    rows = keys.collect()
    share = Counter(r["s"] for r in rows)
    assert abs(share[1] / 20_000 - 0.5) < 0.02 and abs(share[0] / 20_000 - 0.25) < 0.02
    moved = [r for r in rows if r["s"] != r["g"]]
    assert all(r["g"] == 3 for r in moved) and abs(len(moved) / 20_000 - 0.5) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [1.0, 0.0])


def test_slots_of_a_hot_shard(spark):
    df = spark.range(5000).withColumn("shard", F.lit(0))
    got = sorted(r[0] for r in sharding.slots(df, "shard", ["id"]).select("slot").collect())
    assert got == list(range(5000))
