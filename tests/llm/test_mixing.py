from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seedflow.llm import mixing as M
from tests.llm.conftest import ROWS


def water(sizes, cap=3):
    """Targets by the rule as it is told: reshare what is above a cap until none is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level > cap * sizes[s]]
        if not over:
            return {s: fixed.get(s, w[s] * level) for s in names}
        fixed |= {s: cap * sizes[s] for s in over}


def test_permutations(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        df = spark.range(n).select(M.permuted(F.col("id"), M.rounds(F.lit("t"), F.lit(n).cast("long"))).alias("p"))
        got = [r[0] for r in df.collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(1000)) and abs(sum(abs(a - b) for a, b in enumerate(got)) / 1000 - 333) < 40


@pytest.fixture(scope="module")
def sourced(spark):
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else None if i % 17 == 0 else f"s{i % 7}"
        rows.append((i, " ".join(["w"] * (i * 37 % 900)), source))
    rows.append((400, "only three words", "tiny"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_taken(sourced):
    got = M.mix(sourced, block=16).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["key"]] += r["size"]
        taken[r["key"]] += r["taken"]
        target[r["key"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = water({(k[1:] if k else None): v for k, v in sizes.items()})
    for k, t in target.items():
        assert abs(t - want[k[1:] if k else None]) < 1e-6
        assert abs(taken[k] - t) <= max(0.02 * t, 2 * 16)
    assert len(got) == 401


def test_reruns_and_partitions_agree(sourced):
    one, two = (sorted(map(tuple, M.mix(df, block=16).select("id", "taken").collect())) for df in (sourced, sourced.repartition(5)))
    assert one == two


def test_shard_counts_are_a_draw(sourced):
    """Counts of a source over the full shards: their squared deviations from its share are those of a draw, and all slots are dealt out."""
    sources = M.checkpoint(M.targets(M.place(sourced, "doc_id", "text", "source"), 4))
    slots = {r["key"]: (r["slots"], r["all_slots"], r["n_blocks"]) for r in sources.collect()}
    counts = defaultdict(dict)
    for r in M.shard_counts(sources, shard_slots=1000).collect():
        assert 0 <= r["n"] <= M.CAP * r["span"]
        counts[r["key"]][r["shard"]] = r["n"]
    tried = 0
    for key, (n, total, blocks) in slots.items():
        assert sum(counts[key].values()) == n
        shards, p = total // 1000, n / total
        got = [counts[key].get(k, 0) for k in range(shards)]
        if n < 2 * blocks and 1000 * p > 20:  # far from the cap of three spans
            tried += 1
            chi = sum((c - 1000 * p) ** 2 for c in got) / (1000 * p * (1 - p))
            assert 0.4 * shards < chi < 1.9 * shards, (key, got)
    assert tried >= 2


def test_the_draw_decides(spark, sourced):
    """Another size of shards, or another seed, takes other blocks; the totals of each source stay."""
    times, totals = {}, {}
    sources = M.checkpoint(M.targets(M.place(sourced, "doc_id", "text", "source"), 16))
    limit = {r["key"]: r["n_blocks"] for r in sources.collect()}
    for how in ((100, 1), (500, 1), (10**9, 1), (500, 2)):
        rows = M.draw(sources, *how).groupBy("key", "block").count().collect()
        times[how] = {(r["key"], r["block"]): r["count"] for r in rows}
        totals[how] = Counter({k: sum(v for (key, _), v in times[how].items() if key == k) for k in {k for k, _ in times[how]}})
        assert all(1 <= v <= M.CAP and b < limit[k] for (k, b), v in times[how].items())
    assert len({str(sorted(t.items())) for t in times.values()}) == 4
    assert len({str(sorted(t.items())) for t in totals.values()}) == 1


def test_output_shards_hold_the_blocks(sourced):
    texts = {r["doc_id"]: r["text"] for r in sourced.collect()}
    docs = sourced.withColumn("text", F.concat_ws(" ", F.transform(F.split("text", " "), lambda w, i: F.concat(F.col("doc_id"), F.lit("."), i.cast("string")))))
    rows = M.mixed_blocks(docs, block=16, shard_slots=300).collect()
    taken = {r["id"]: r["taken"] for r in M.mix(docs, block=16, shard_slots=300).collect()}
    seen = Counter(w.split(".")[0] for r in rows for w in r["text"].split(" "))
    assert {i: seen[str(i)] for i in texts} == {i: taken[i] for i in texts}
    assert max(len(r["text"].split(" ")) for r in rows) == 16
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) > 3 and max(sizes.values()) < 450


def test_mixed_documents_hold_the_taken_words(sourced):
    taken = {r["id"]: r["taken"] for r in M.mix(sourced).collect()}
    rows = M.mixed_documents(sourced).collect()
    words = Counter()
    for r in rows:
        words[r["doc_id"]] += len(r["text"].split())
    assert dict(words) == {i: t for i, t in taken.items() if t}
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 3


def test_extra_columns_of_any_name(odd):
    wide = odd.withColumnRenamed("slot", "a.b").withColumn("taken", F.lit(1)).withColumn("key", F.lit("k"))
    assert M.mixed_documents(wide).columns == wide.columns and M.mixed_documents(wide).count() > 0


def test_odd_rows(spark, odd, empty, sf_dir):
    rows = M.op7_mixing(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r[0], len((r[1] or "").encode().split())) for r in ROWS)
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert M.mix(empty).count() == 0 and M.mixed_documents(empty).count() == 0
    assert M.mixed_documents(odd).columns == odd.columns
    plan = M.mix(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def by_source(rows):
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        taken[r["key"]] += r["taken"]
        size[r["key"]] += r["size"]
        target[r["key"]] = r["target"]
    return taken, target, size


@pytest.mark.parametrize("sizes", [[1000] * 4, [100] * 300, [90 + i for i in range(60)], [500, 500, 500, 20, 20, 20, 20, 3000], [7] * 1000, [1, 1, 1]])
def test_tied_and_small_sources(spark, sizes):
    """Targets are those of the rule as it is told, share all words out, and what is taken is near them."""
    rows = [(i, " ".join(["w"] * n), f"s{i:04d}") for i, n in enumerate(sizes)]
    taken, target, size = by_source(M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    want = water({k[1:]: n for k, n in size.items()})
    assert all(abs(t - want[k[1:]]) < 1e-6 for k, t in target.items())
    assert abs(sum(target.values()) - sum(sizes)) < 1e-6
    assert all(abs(taken[k] - t) <= max(1, t / 64) and taken[k] <= 3 * size[k] for k, t in target.items())


def test_equals_its_sql_on_ties(spark, tmp_path):
    import duckdb

    rows = [(i, " ".join(["w"] * (40 + i // 6 % 3)), None if i % 6 == 5 else f"s{i % 6}") for i in range(300)] + [(300, None, "none"), (301, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = con.execute(M.SQL)
    names = [d[0] for d in got.description]
    want = sorted(tuple(dict(zip(names, r, strict=True))[c] for c in ("doc_id", "taken", "target", "n_shards", "first_shard")) for r in got.fetchall())
    assert sorted(map(tuple, M.op7_mixing(spark, str(tmp_path)).select("doc_id", "taken", "target", "n_shards", "first_shard").collect()), key=str) == sorted(want, key=str)


def test_the_draw_decides_the_result_on_the_tables(spark):
    """With the registered shard size, the small table fills several shards, and another seed gives other counts and other takings."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sources = M.checkpoint(M.targets(M.place(docs, "doc_id", "text", "source")))
    counts = [{(r["key"], r["shard"]): r["n"] for r in M.shard_counts(sources, seed=s).collect()} for s in (1, 2)]
    shards = {k for _, k in counts[0]}
    assert len(shards) > 8 and counts[0] != counts[1]
    per = Counter()
    for (_, shard), n in counts[0].items():
        per[shard] += n
    assert all(0.7 * M.SHARD_SLOTS < n < 1.3 * M.SHARD_SLOTS for s, n in per.items() if s < max(shards))
    one, two = ({r["id"]: (r["taken"], tuple(r["shards"])) for r in M.mix(docs, seed=s).collect()} for s in (1, 2))
    assert sum(one[i] != two[i] for i in one) > len(one) / 2


def test_room_is_summed_in_two_levels(spark, sourced, monkeypatch):
    sources = M.checkpoint(M.targets(M.place(sourced, "doc_id", "text", "source"), 4))
    whole = sorted(map(tuple, M.shard_counts(sources, shard_slots=100).collect()))
    monkeypatch.setattr(M, "CHUNK_SHARDS", 5)
    assert sorted(map(tuple, M.shard_counts(sources, shard_slots=100).collect())) == whole
