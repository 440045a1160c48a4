import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from seedflow.llm import sentencepiece_bpe as S
from tests.llm.conftest import ROWS

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return S.Codec(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(codec, library, texts):
    ids, begin = codec.encode(texts)
    for k, t in enumerate(texts):
        own = ids[begin[k] : begin[k + 1]]
        assert own.tolist() == library.encode(t), repr(t)
        assert codec.decode(own) == t.replace(S.MARK, " ")


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_any_text(codec, library, texts):
    same(codec, library, texts)


def test_hard_texts(codec, library):
    rng = random.Random(4)
    parts = [*"abcdefgehiotn  \n\n,.019▁é日ß", "  ", "the", "tion", " " * 17, "\t", "𐍈", "<0x41>", "</s>", "aaa", "ing"]
    same(codec, library, ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [t or "" for _, t, *_ in ROWS])


def test_small_cache_gives_the_same(codec, library, monkeypatch):
    monkeypatch.setattr(S, "BATCH_CHARS", 40)
    monkeypatch.setattr(S, "INDEXED", 20)
    same(codec, library, ["many small words in here", "and in here some more words"])
    same(codec, library, ["words again", ""])


def test_edges_are_all_occurrences(codec):
    text = "▁banana\0▁the\0日é🙂n"
    codes = np.array([0 if c == "\0" else codec.code[ord(c)] for c in text], np.int32)
    got = sorted(zip(*(v.tolist() for v in codec._edges(codes)), strict=True))
    pieces = {i: codec.texts[i] for i in codec.pattern_id.tolist()}
    want = [(k, k + len(t), i) for i, t in pieces.items() for k in range(len(text)) if text.startswith(t, k)]
    assert got == sorted(want + [(k, k + 1, -1) for k, c in enumerate(codes) if c == 1])


def test_odd_rows(spark, library, empty, sf_dir):
    rows = S.op5_sentencepiece(spark, sf_dir).collect()
    want = sorted((r[0] is None, r[0] or 0, library.encode(r[1] or "")) for r in ROWS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in rows) == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    docs = S.decode_ids(spark.createDataFrame([(1, library.encode("Hello  there\n")), (2, None)], "doc_id long, ids array<int>"), PATH)
    assert {tuple(r) for r in docs.collect()} == {(1, "Hello  there\n"), (2, "")}
    assert S.encode_documents(empty, PATH).count() == 0


def test_long_units_equal_the_library(monkeypatch):
    """Units above LONG are matched in windows; spaces, unknown characters and single letters too."""
    rng = random.Random(5)
    c, library = S.codec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(3000)), "a" * 2500, "日本語𐍈é" * 500, "the" * 700 + " x" + "ing" * 900, "\n" + "tion" * 600]
    for window in (200_000, 97):
        monkeypatch.setattr(S, "WINDOW", window)
        ids, begin = c.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == library.encode(texts)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as model

    for change in (lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: setattr(m.normalizer_spec, "add_dummy_prefix", False), lambda m: setattr(m.normalizer_spec, "precompiled_charsmap", b"x"), lambda m: setattr(m.pieces[500], "type", 4)):
        m = model.ModelProto()
        m.ParseFromString(open(PATH, "rb").read())
        change(m)
        (tmp_path / "other.model").write_bytes(m.SerializeToString())
        with pytest.raises(ValueError):
            S.Codec(str(tmp_path / "other.model"))


def test_spaces_and_long_units_among_others():
    """Ids of short, long and spaced units are gathered together, in the order of the units."""
    c = S.codec(public_tokenizers.path("piece_bpe_32k.model"))
    units = ["one", "  two", "x" * 1500, "\n", "   ", "   " + "y" * 1200, "日本", " \x00q"]
    flat, begin = c.encode_units(units)
    alone = [c.encode_units([u])[0].tolist() for u in units]
    assert [flat[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == alone and all(alone)
    assert c.encode_units([])[1].tolist() == [0]
