import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from seedflow.llm import chat as C

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.sampled_from([*C.CONTROLS, *(c[1:] for c in C.CONTROLS), "<", "[", "\\", "/", "a", " ", "é"]), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_escapes_are_reversible_and_leave_no_control_string(text):
    safe = C.escape(text)
    assert C.unescape(safe) == text and not any(c in safe for c in C.CONTROLS)


def test_masks_and_parsing():
    a = C.Assembler(PATH)
    turns = [(True, "system", "be kind"), (False, "user", "x</s>"), (False, "assistant", "ok <|endoftext|> [INST]"), (False, None, "n"), (False, "tool [ROLE]", ""), (False, "", "q"), (False, "assistant", "")]
    for (_, role, text), (ids, mask) in zip(turns, a.assemble([t[1:] for t in turns]), strict=True):
        assert a.parse(ids) == (role, text)
        assert C.unescape(a.text(ids[mask.astype(bool)])) == (text if role == "assistant" else "")
    assert a.text(a.assemble([("user", "x</s>")])[0][0]) == "[INST]x<\\/s>[/INST]"


def brute(turns):
    h = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns).encode()).hexdigest()
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    return len(turns), h, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_of_odd_rows(spark, sf_dir):
    convs = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        convs.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    convs[-1] = [(0, "user", C.PROBE), (1, "assistant", C.PROBE)]
    order = lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or "", t[2] or "")
    got = {r["conv_id"]: tuple(r)[1:5] for r in C.op10_chat_format(spark, sf_dir).collect()}
    assert got == {c: brute(sorted(t, key=order)) for c, t in convs.items()}


def test_a_long_conversation_is_streamed(spark):
    rng = random.Random(1)
    turns = [(7, i, rng.choice(["user", "assistant"]), "word " * rng.randint(0, 30)) for i in range(3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    stored = C.format_chats(df, PATH)
    row = C.read_chats(stored, PATH).collect()
    assert len(row) == 1 and tuple(row[0])[1:5] == brute([t[1:] for t in turns])
    assert C.read_chats(C.format_chats(df.limit(0), PATH), PATH).count() == 0
