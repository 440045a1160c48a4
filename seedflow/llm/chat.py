"""Chat formatting by assembly of token segments.

Template (control strings are reserved ids above the vocabulary, never encoded as text):

* ``<s>`` opens a conversation;
* a user turn is ``[INST]`` text ``[/INST]``; an assistant turn is ``[ANS]`` text ``</s>``;
* a system turn is ``<<SYS>>`` text ``<</SYS>>``;
* any other role, null included, is ``[ROLE]`` role ``[/ROLE]`` text ``</s>`` (a null role is the
  reserved id ``[NULL]`` in place of its name).

Contents are escaped: a control string in a text gets one more backslash after its first character
(``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``), so the formatted text holds control
strings only where the template put them, and removing one backslash gives the text back. Segments
are encoded separately by a lossless byte-level tokenizer, where they lie, whatever the length of their
conversation; ids are spliced, and the loss mask (the assistants' texts) is the running sum of +1 at the
start and -1 at the end of those segments. Only then are the turns of a conversation brought together, in
order, to be numbered: the place of a turn's ids is the sum of the lengths before it.

Stored form: a row a turn (conv_id, pos, token_start, ids, mask), so a conversation of any length is
spread over rows and never held whole. Reading back streams the rows of a conversation in order,
decodes ids, removes the escapes and digests what it finds.

Defined cases: a null text is empty; a null turn comes first, equal turns are ordered by role and
ids; a null conv_id is a conversation of its own; equal rows are separate turns; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import fresh_path, load

#: Control strings, in the order of their reserved ids.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[NULL]"]
_TAIL = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_CONTROL = re.compile(rf"(?<=[<\[])(\\*)(?={_TAIL})")
_ESCAPED = re.compile(rf"(?<=[<\[])\\(\\*)(?={_TAIL})")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Assembler:
    """Encodes turns to ids and masks, and back."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.first = self.tokenizer.get_vocab_size()
        self.id = {c: self.first + k for k, c in enumerate(CONTROLS)}

    def assemble(self, turns: list[tuple[str | None, str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """ids and mask of each (role, text)."""
        contents = []
        for role, text in turns:
            contents += [escape(role) if role not in ("user", "assistant", "system", None) else "", escape(text)]
        encoded = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(contents, add_special_tokens=False)]
        out, at = [], self.id
        for k, (role, _) in enumerate(turns):
            name, text = encoded[2 * k], encoded[2 * k + 1]
            if role == "user":
                before, after = [at["[INST]"]], [at["[/INST]"]]
            elif role == "assistant":
                before, after = [at["[ANS]"]], [at["</s>"]]
            elif role == "system":
                before, after = [at["<<SYS>>"]], [at["<</SYS>>"]]
            else:
                before, after = [at["[ROLE]"], *([at["[NULL]"]] if role is None else name), at["[/ROLE]"]], [at["</s>"]]
            ids = np.concatenate([before, text, after]).astype(np.int32)
            step = np.zeros(len(ids) + 1, np.int8)
            if role == "assistant":
                start = len(before)
                step[start] += 1
                step[start + len(text)] -= 1
            out.append((ids, np.cumsum(step[:-1], dtype=np.int8)))
        return out

    def text(self, ids: np.ndarray) -> str:
        """The formatted text of ids, control strings included."""
        cuts = np.flatnonzero(ids >= self.first)
        parts, at = [], 0
        for c in [*cuts.tolist(), len(ids)]:
            if c > at:
                parts.append(self.tokenizer.decode(ids[at:c].tolist(), skip_special_tokens=False))
            if c < len(ids):
                parts.append(CONTROLS[ids[c] - self.first])
            at = c + 1
        return "".join(parts)

    def parse(self, ids: np.ndarray) -> tuple[str | None, str]:
        """role and text of a turn's ids, by the reserved ids alone."""
        ids = ids[1:] if len(ids) and ids[0] == self.id["<s>"] else ids
        plain = lambda x: unescape(self.text(x))
        kind = CONTROLS[ids[0] - self.first]
        if kind in ("[INST]", "[ANS]", "<<SYS>>"):
            return {"[INST]": "user", "[ANS]": "assistant", "<<SYS>>": "system"}[kind], plain(ids[1:-1])
        close = int(np.flatnonzero(ids == self.id["[/ROLE]"])[0])
        name = ids[1:close]
        return None if len(name) and name[0] == self.id["[NULL]"] else plain(name), plain(ids[close + 1 : -1])


_ASSEMBLERS: dict[str, Assembler] = {}


def assembler(path: str) -> Assembler:
    if path not in _ASSEMBLERS:
        _ASSEMBLERS[path] = Assembler(path)
    return _ASSEMBLERS[path]


def _streamed(df: DataFrame, *order: str) -> DataFrame:
    """Rows of a conversation together and in order; a task streams them, whatever their number."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_chats(turns: DataFrame, tokenizer: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos, token_start, ids, mask: a row a turn."""
    ship(turns.sparkSession)
    named = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                made = assembler(tokenizer).assemble(list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([i for i, _ in made], pa.list_(pa.int32())), pa.array([m for _, m in made], pa.list_(pa.int8()))],
                    names=["conv_id", "turn", "role", "text", "ids", "mask"],
                )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, pos, start, opening = object(), 0, 0, assembler(tokenizer).id["<s>"]
        for b in batches:
            ids, masks, poses, starts = b.column(1).to_pylist(), b.column(2).to_pylist(), [], []
            for k, c in enumerate(b.column(0).to_pylist()):
                if c != conv:
                    conv, pos, start = c, 0, 0
                    ids[k], masks[k] = [opening, *ids[k]], [0, *masks[k]]
                poses.append(pos)
                starts.append(start)
                pos, start = pos + 1, start + len(ids[k])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(poses, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8()))], names=["conv_id", "pos", "token_start", "ids", "mask"])

    kind = lambda c: named.schema[c].dataType.simpleString()
    # ids, not texts, go through the exchange; equal turns have equal ids
    encoded = named.mapInArrow(encode, f"conv_id {kind('conv_id')}, turn {kind('turn')}, role string, text string, ids array<int>, mask array<byte>").drop("text")
    return _streamed(encoded, "turn", "role", "ids").select("conv_id", "ids", "mask").mapInArrow(number, f"conv_id {kind('conv_id')}, pos long, token_start long, ids array<int>, mask array<byte>")


def read_chats(stored: DataFrame, tokenizer: str) -> DataFrame:
    """A row a conversation: number of turns, digests of its turns and of its masked text, and lengths."""
    ship(stored.sparkSession)
    out = pa.schema([("conv_id", pa.null()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, kind = None, None

        def row(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            schema = out.set(0, pa.field("conv_id", kind))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            kind, done = b.schema.field(0).type, []
            a = assembler(tokenizer)
            for conv, pos, ids, mask in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), b.column(4), strict=True):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy().astype(bool)
                if state is None or pos == 0:
                    if state is not None:
                        done.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = a.parse(ids)
                loss = unescape(a.text(ids[mask]))
                state[1] += 1
                state[2].update(f"{'' if role is None else role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(a.text(ids))
            if done:
                yield batch(done)
        if state is not None:
            yield batch([row(state)])

    return _streamed(stored, "pos").mapInArrow(run, f"conv_id {stored.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    path = fresh_path(spark, "op10-chats")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    format_chats(turns.unionByName(probe), tokenizer).write.parquet(path)
    return read_chats(spark.read.parquet(path), tokenizer)


_SQL_PROBE = f"SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'"
#: A text's escapes are one more character for each control string in it, backslashes or none after its first character.
_SQL_ESCAPES = "len(regexp_extract_all({text}, '[<\\[]\\\\*(?:" + _TAIL.replace("'", "''") + ")'))"
_SQL = f"""
WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL {_SQL_PROBE}),
sized AS (
  SELECT conv_id, turn, role, text, length(text) + {_SQL_ESCAPES.format(text="text")} AS chars,
    length(role) + {_SQL_ESCAPES.format(text="role")} AS role_chars
  FROM turns),
marked AS (
  SELECT *, chars + CASE role WHEN 'user' THEN {len("[INST]" + "[/INST]")} WHEN 'assistant' THEN {len("[ANS]" + "</s>")} WHEN 'system' THEN {len("<<SYS>>" + "<</SYS>>")}
    ELSE {len("[ROLE]" + "[/ROLE]" + "</s>")} + coalesce(role_chars, {len("[NULL]")}) END AS formatted
  FROM sized)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(formatted) + {len("<s>")})::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

QUERIES = {"op10_chat_format": op10_chat_format}
ORACLES: dict[str, str] = {"op10_chat_format": _SQL}
