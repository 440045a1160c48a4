import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest
from pathlib import Path
from tokenizers import Tokenizer

from seedflow.llm import tokens as T
from tests.llm.conftest import ROWS

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_chunks_give_the_library_s_ids(library):
    rng = random.Random(6)
    parts = [*"abC'sStTdD.,!?-<|>≠é  \x1c\x85\t\n\r 019İΣσJKé日”…", "̊", "̌", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", ". ", ", ", "... "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    e = T.ChunkEncoder(PATH, kept=500)
    for at in range(0, 3000, 100):
        ids, begin = e.encode(texts[at : at + 100], 2)
        for k, t in enumerate(texts[at : at + 100]):
            assert ids[begin[k] : begin[k + 1]].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], repr(t)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="white space"):
        T.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_odd_rows(spark, library, empty, sf_dir, tmp_path):
    rows = sorted(map(tuple, T.op9_token_orc(spark, sf_dir).collect()), key=lambda r: r[1])
    want, start = [], 0
    for doc, text in sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows == want
    T.write_tokens(empty, str(tmp_path / "none"), PATH)
    assert T.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_files_can_be_pruned(spark, tmp_path):
    docs = spark.range(5000).selectExpr("id * 3 AS doc_id", "concat('text number ', id) AS text")
    path = str(tmp_path / "orc")
    T.write_tokens(docs, path, PATH)
    one = T.read_tokens(spark, path).filter("id = 300")
    assert "EqualTo(id,300)" in one._jdf.queryExecution().executedPlan().toString()
    assert one.collect()[0]["n_tokens"] == 6 and T.read_tokens(spark, path).filter("id = 301").count() == 0
    last = -1
    for f in sorted(Path(path).glob("*.orc")):
        table = orc.ORCFile(str(f)).read()
        ids = table.column("id").to_pylist()
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]
    assert last == 14997


def test_files_have_row_indexes_and_bloom_filters(spark, tmp_path):
    """Stripes, row groups and the filters of the ids, read by ORC's own reader."""
    path = tmp_path / "orc"
    T.write_tokens(spark.range(5000).selectExpr("id * 3 AS doc_id", "concat('text number ', id) AS text").coalesce(1), str(path), PATH)
    jvm, rows = spark._jvm, 0
    for f in sorted(path.glob("*.orc")):
        conf = jvm.org.apache.hadoop.conf.Configuration()
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == T.ROW_INDEX
        read, column = reader.rows(), list(reader.getSchema().getFieldNames()).index("id") + 1
        for k, stripe in enumerate(reader.getStripes()):
            rows += stripe.getNumberOfRows()
            streams = read.readStripeFooter(stripe).getStreamsList()
            kinds = {(s.getColumn(), s.getKind().toString()) for s in streams}
            assert (column, "ROW_INDEX") in kinds and (column, "BLOOM_FILTER_UTF8") in kinds
            assert {c for c, kind in kinds if kind == "BLOOM_FILTER_UTF8"} == {column}
            every = spark.sparkContext._gateway.new_array(jvm.boolean, reader.getSchema().getMaximumId() + 1)
            for c in range(len(every)):
                every[c] = True
            index = read.readRowIndex(k, every, every)
            groups = list(index.getRowGroupIndex())[column].getEntryList()
            assert len(list(index.getBloomFilterIndex())[column].getBloomFilterList()) == len(groups) == -(-stripe.getNumberOfRows() // T.ROW_INDEX)
            bounds = [(g.getStatistics().getIntStatistics().getMinimum(), g.getStatistics().getIntStatistics().getMaximum()) for g in groups]
            assert bounds == sorted(bounds) and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
    assert rows == 5000
