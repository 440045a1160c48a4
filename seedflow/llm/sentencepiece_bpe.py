"""SentencePiece encoding and decoding by suffix-array matching.

Units: a text with its spaces escaped falls into units (a space mark and the characters up to the next
one, or up to a line end), which no piece crosses; a batch's text is concatenated, each distinct unit
once. The batch is indexed by a suffix array (sorted as far as the longest piece), every piece of the
vocabulary is binary-searched for its range of occurrences, and the ranges give the edges
(start, end, piece) of all units at once, sorted by position of their end in the unit. Relaxing goes
through the edges in that order: the model is BPE, whose encoding of a prefix is unique, so an edge is
taken when the piece before it, the last of the encoding up to its start, and its own piece are stable
side by side, and no merge across their border would come first. The result equals the library's.

Stability is decided from the order of merges alone: the pieces that touch the border from the left
and from the right, by the time at which BPE forms them; a merge across wins if its rank comes before
the next change on the left, and not after the next one on the right.

A unit of more than ``LONG`` characters is matched in windows of ``WINDOW`` characters and relaxed on its
own, so a text without spaces costs time and memory in proportion to its length.

Characters that the vocabulary lacks become their bytes' pieces. Decoding joins pieces, turns space
marks to spaces, gathers byte pieces and drops the first space.

Defined cases: null and empty texts have no ids and decode to the empty text; a text's own space marks
(U+2581) are spaces, as in the library; equal rows give equal results; an empty table gives an empty
result; other columns are not read. A model that is not BPE with byte fallback, the identity as
normaliser, escaped spaces and a space before the text, or that has pieces defined by users, raises
``ValueError``. A task holds one batch of at most ``BATCH`` texts and about ``BATCH_CHARS`` characters.
"""

from __future__ import annotations

import heapq
import math
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from .common import load

MARK = "▁"
#: Texts and characters of one batch, and characters of distinct units that one suffix array indexes.
BATCH, BATCH_CHARS, INDEXED = 384, 2_000_000, 500_000
#: Units of more characters are relaxed on their own, in windows.
LONG, WINDOW = 1000, 200_000
#: Pairs of pieces whose stability a worker remembers for long units.
PAIRS = 1_000_000


def _pieces(path: str) -> tuple[list[str], np.ndarray, list[int]]:
    """Text, score and type (1 normal, 6 byte) of every id of a model file."""
    from sentencepiece import sentencepiece_model_pb2 as model

    m = model.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    form, training = m.normalizer_spec, m.trainer_spec
    if (
        training.model_type != training.BPE or not training.byte_fallback or training.treat_whitespace_as_suffix or form.precompiled_charsmap
        or form.remove_extra_whitespaces or not form.add_dummy_prefix or not form.escape_whitespaces or any(p.type not in (1, 2, 3, 6) for p in m.pieces)
    ):
        raise ValueError(f"not a BPE model with byte fallback and the identity as normaliser: {path}")
    return [p.piece for p in m.pieces], np.array([p.score for p in m.pieces]), [p.type for p in m.pieces]


class Codec:
    def __init__(self, path: str):
        self.texts, scores, kinds = _pieces(path)
        self.byte_id = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, kinds, strict=True)) if k == 6}
        self.id = {t: i for i, (t, k) in enumerate(zip(self.texts, kinds, strict=True)) if k == 1}
        # rank: the place of a merge in the order of merges; equal scores merge at the same time, leftmost first
        self.rank = {t: -float(scores[i]) for t, i in self.id.items()}
        self.bytes = {i: bytes([b]) for b, i in self.byte_id.items()}
        self._spines()

    # -- the model's own merges

    def merge(self, chars: list[str]) -> list[tuple[str, float, tuple | None]]:
        """BPE by a heap of pairs: (text, time at which it was formed, its two parts) of what is left."""
        sym: list = [(c, -1.0, None) for c in chars]
        nxt, prv, now, heap = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1)), -1.0, []

        def offer(i: int) -> None:
            if i >= 0 and nxt[i] < len(sym) and (r := self.rank.get(sym[i][0] + sym[nxt[i]][0])) is not None:
                heapq.heappush(heap, (r, i, sym[i][0], sym[nxt[i]][0]))

        for i in range(len(sym)):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if sym[i] else len(sym)
            if sym[i] is None or j >= len(sym) or sym[i][0] != a or sym[j][0] != b:
                continue
            now = max(now, r)
            sym[i], sym[j] = (a + b, now, (sym[i], sym[j])), None
            nxt[i] = nxt[j]
            if nxt[i] < len(sym):
                prv[nxt[i]] = i
            offer(prv[i])
            offer(i)
        return [s for s in sym if s is not None]

    def _spines(self) -> None:
        """For every piece that BPE can form: the pieces at its left and right border and when they are formed."""
        words = [t for t in self.id if set(t) != {MARK} or t == MARK]
        left, right, self.matched = {}, {}, []
        for t in words:
            got = self.merge(list(t))
            if len(got) != 1:
                continue
            for side, store in ((0, left), (1, right)):
                chain, node = [], got[0]
                while node:
                    chain.append((self.id[node[0]] if node[0] in self.id else -1, node[1]))
                    node = node[2][side] if node[2] else None
                store[self.id[t]] = chain[::-1]
            self.matched.append(t)
        depth = max(len(c) for c in [*left.values(), *right.values()])
        n = len(self.texts)
        self.left, self.left_time = np.full((n, depth + 1), -1, np.int64), np.full((n, depth + 1), np.inf)
        self.right, self.right_time = np.full((n, depth + 1), -1, np.int64), np.full((n, depth + 1), np.inf)
        for store, ids, times in ((left, self.left, self.left_time), (right, self.right, self.right_time)):
            for i, chain in store.items():
                ids[i, : len(chain)] = [c for c, _ in chain]
                times[i, : len(chain)] = [t for _, t in chain]
        cross = {(self.id[t[:k]], self.id[t[k:]]): r for t, r in self.rank.items() for k in range(1, len(t)) if t[:k] in self.id and t[k:] in self.id}
        keys = np.array([a * n + b for a, b in cross], np.int64)
        order = np.argsort(keys)
        self.cross_keys, self.cross_rank = keys[order], np.array(list(cross.values()))[order]
        self.cross = dict(zip(self.cross_keys.tolist(), self.cross_rank.tolist(), strict=True))
        self._pairs: dict[int, bool] = {}
        self._left: dict[int, tuple] = {}
        self._right: dict[int, tuple] = {}
        # codes of characters: 0 ends a unit, 1 is unknown; four codes are one word of a key
        chars = sorted({c for t in self.matched for c in t})
        if len(chars) > 60_000:
            raise ValueError("too many characters in the pieces")
        self.code = np.ones(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)
        self.longest = -(-max(map(len, self.matched)) // 4) * 4
        low, high = (np.full((len(self.matched), self.longest), fill, np.uint64) for fill in (0, 0xFFFF))
        for k, t in enumerate(self.matched):
            low[k, : len(t)] = high[k, : len(t)] = self.code[[ord(c) for c in t]]
        self.bounds = [self._words(np.concatenate([v.ravel(), np.zeros(3, np.uint64)]))[: v.size : 4].reshape(len(v), -1) for v in (low, high)]
        self.pattern_id = np.array([self.id[t] for t in self.matched])
        self.pattern_len = np.array([len(t) for t in self.matched])

    def stable_pair(self, a: int, b: int) -> bool:
        """``stable`` of one pair, remembered."""
        n = len(self.texts)
        if (known := self._pairs.get(a * n + b)) is not None:
            return known
        if len(self._pairs) > PAIRS:
            self._pairs.clear()
        for spines, ids, times, k in ((self._right, self.right, self.right_time, a), (self._left, self.left, self.left_time, b)):
            if k not in spines:
                spines[k] = ids[k].tolist(), times[k].tolist()
        (left_ids, left_times), (right_ids, right_times) = self._right[a], self._left[b]
        i = j = 0
        while True:
            rank, next_a, next_b = self.cross.get(left_ids[i] * n + right_ids[j]), left_times[i + 1], right_times[j + 1]
            if rank is not None and rank < next_a and rank <= next_b:
                ok = False
                break
            if next_a == next_b == math.inf:
                ok = True
                break
            if next_a <= next_b:
                i += 1
            else:
                j += 1
        self._pairs[a * n + b] = ok
        return ok

    @staticmethod
    def _words(codes: np.ndarray) -> np.ndarray:
        """At each place, the code there and the three after it, as one number."""
        c = codes.astype(np.uint64)
        n = len(c) - 3
        return c[:n] << np.uint64(48) | c[1 : n + 1] << np.uint64(32) | c[2 : n + 2] << np.uint64(16) | c[3:]

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece a before piece b stays as it is: no merge across their border comes first."""
        n = len(self.texts)
        ok, i, j = np.ones(len(a), bool), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = self.right[x, i[live]] * n + self.left[y, j[live]]
            at = np.minimum(np.searchsorted(self.cross_keys, key), len(self.cross_keys) - 1)
            found = self.cross_keys[at] == key
            next_a, next_b = self.right_time[x, i[live] + 1], self.left_time[y, j[live] + 1]
            rank = self.cross_rank[at]
            bad = found & (rank < next_a) & (rank <= next_b)
            done = np.isinf(next_a) & np.isinf(next_b)
            ok[live[bad]] = False
            step_a = next_a <= next_b
            i[live] += step_a & ~done
            j[live] += ~step_a & ~done
            live = live[~bad & ~done]
        return ok

    # -- matching

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end and id of all occurrences of pieces in the codes ``text``, and of unknown characters (id -1), in no order."""
        n = len(text)
        word = self._words(np.concatenate([text, np.zeros(self.longest + 3, text.dtype)]))
        # suffix array, equal suffixes in no order: ranks of 4 characters, then of twice as many, up to the longest piece
        order = np.argsort(word[:n])
        k, width = word[order], 4
        while width < self.longest:
            rank = np.zeros(n + width, np.int64)
            rank[order] = np.concatenate([[1], 1 + np.cumsum(k[1:] != k[:-1])]) if n else k
            key = rank[:n] * (n + 2) + rank[width:]
            order = np.argsort(key)
            k, width = key[order], 2 * width
        # ranges of all pieces, searched together: by their first four characters, and longer ones within what has these
        found, first = [], word[order]
        for upper, bound in enumerate(self.bounds):
            lo, hi = (np.searchsorted(first, bound[:, 0], side=side) for side in ("left", "right"))
            brief = self.pattern_len <= 4
            lo[brief] = hi[brief] = (hi if upper else lo)[brief]
            while len(live := np.flatnonzero(lo < hi)):
                mid = (lo[live] + hi[live]) // 2
                suffix = order[mid]
                less, equal = np.zeros(len(live), bool), np.ones(len(live), bool)
                for w in range(1, bound.shape[1]):
                    s, p = word[suffix + 4 * w], bound[live, w]
                    less |= equal & (s < p)
                    equal &= s == p
                right = less | (equal if upper else False)
                lo[live[right]] = mid[right] + 1
                hi[live[~right]] = mid[~right]
            found.append(lo)
        lo, count = found[0], found[1] - found[0]
        some = np.flatnonzero(count)
        alone = np.flatnonzero(text == 1)
        n_each = count[some]
        at = np.arange(n_each.sum()) + np.repeat(lo[some] - (np.cumsum(n_each) - n_each), n_each)
        start = np.concatenate([order[at], alone]).astype(np.int32)
        ids = np.concatenate([np.repeat(self.pattern_id[some], n_each), np.full(len(alone), -1)]).astype(np.int32)
        size = np.concatenate([np.repeat(self.pattern_len[some], n_each), np.ones(len(alone), np.int64)]).astype(np.int32)
        return start, start + size, ids

    def match(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths of the encodings of units; each is encoded on its own."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer(("\0".join(units) + "\0").encode("utf-32-le"), np.uint32)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        text = self.code[points]
        text[begin + sizes] = 0
        start, end, ids = self._edges(text)
        level = (end - np.repeat(begin.astype(np.int32), sizes + 1)[start]).astype(np.uint16)
        by = np.argsort(level, kind="stable")
        start, end, ids, level = start[by], end[by], ids[by], level[by]
        cuts = np.searchsorted(level, np.arange(1, (int(level[-1]) if len(level) else 0) + 2))
        # relax: last piece of the encoding up to a place (-1: a unit's start, -2: none yet), and where that piece starts
        last, back = np.full(len(text) + 1, -2, np.int32), np.zeros(len(text) + 1, np.int32)
        last[begin] = -1
        for k in range(len(cuts) - 1):
            s, e, t = start[cuts[k] : cuts[k + 1]], end[cuts[k] : cuts[k + 1]], ids[cuts[k] : cuts[k + 1]]
            before = last[s]
            reached = np.flatnonzero(before > -2)
            s, e, t, before = s[reached], e[reached], t[reached], before[reached]
            take = (before == -1) | (t == -1)  # a unit's start or an unknown character: nothing to merge with
            check = np.flatnonzero(~take)
            if len(check):
                pair, where = np.unique(before[check].astype(np.int64) * len(self.texts) + t[check], return_inverse=True)
                take[check] = self.stable(pair // len(self.texts), pair % len(self.texts))[where]
            last[e[take]], back[e[take]] = t[take], s[take]
        # walk back from the ends of all units together
        live, at = np.flatnonzero(sizes > 0), (begin + sizes)[sizes > 0]
        path_unit, path_at, path_id = [], [], []
        while len(live):
            if (last[at] == -2).any():
                raise AssertionError("a unit without an encoding")
            path_unit.append(live)
            path_at.append(back[at])
            path_id.append(last[at])
            at = back[at]
            more = at > begin[live]
            live, at = live[more], at[more]
        unit, at, out = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (path_unit, path_at, path_id))
        by = np.argsort(at, kind="stable")
        unit, at, out = unit[by], at[by], out[by]
        if (out == -1).any():
            raw = [[self.byte_id[b] for b in chr(points[p]).encode()] if i == -1 else [i] for p, i in zip(at.tolist(), out.tolist(), strict=True)]
            width = np.array([len(r) for r in raw])
            unit, out = np.repeat(unit, width), np.array([i for r in raw for i in r], np.int64)
        return out.astype(np.int32), np.bincount(unit, minlength=len(units))

    def match_long(self, unit: str) -> np.ndarray:
        """The ids of one unit of any length: edges window by window, relaxed one by one in the order of their ends."""
        points = np.frombuffer(unit.encode("utf-32-le"), np.uint32)
        n = len(points)
        last, back = array("i", [-2]) * (n + 1), array("i", [0]) * (n + 1)
        last[0] = -1  # nothing to merge with; so is an unknown character, which is edge -1
        rest = (np.zeros(0, np.int64),) * 3
        for at in range(0, n, WINDOW):
            start, end, ids = (v.astype(np.int64) for v in self._edges(self.code[points[at : at + WINDOW + self.longest]]))
            own = start < WINDOW
            start, end, ids = (np.concatenate([r, v]) for r, v in zip(rest, (start[own] + at, end[own] + at, ids[own]), strict=True))
            done = (end <= at + WINDOW) | (at + WINDOW >= n)
            rest = start[~done], end[~done], ids[~done]
            start, end, ids = start[done], end[done], ids[done]
            by = np.argsort(end, kind="stable")
            for k in range(0, len(by), 1 << 18):
                part = by[k : k + (1 << 18)]
                for s, e, t in zip(start[part].tolist(), end[part].tolist(), ids[part].tolist(), strict=True):
                    before = last[s]
                    if before == -2 or last[e] != -2:
                        continue
                    if before >= 0 and t >= 0 and not self.stable_pair(before, t):
                        continue
                    last[e], back[e] = t, s
        out, e = [], n
        while e > 0:
            s, t = back[e], last[e]
            if t == -2:
                raise AssertionError("a unit without an encoding")
            out.extend([t] if t >= 0 else [self.byte_id[b] for b in reversed(chr(points[s]).encode())])
            e = s
        return np.array(out[::-1], np.int32)

    # -- texts

    @staticmethod
    def units(text: str) -> list[str]:
        """Units of a text; a space mark is left out before the first character, a line end stands for itself."""
        if not text:
            return []
        parts = (" " + text.replace(MARK, " ")).replace("\n", " \n").split(" ")[1:]
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for p in parts:  # several spaces: they stay with the unit that follows
            if p == "":
                spaces += 1
            elif p[0] == "\n":
                if spaces:
                    out.append(" " * (spaces - 1) + " ")
                out.append(p)
                spaces = 0
            else:
                out.append(" " * spaces + p)
                spaces = 0
        if spaces:
            out.append(" " * spaces)
        return out

    def _run(self, n: int) -> list[int]:
        """A run of n space marks."""
        return [self.id[t] for t, *_ in self.merge([MARK] * n)]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct units, and where each begins (and the last one ends)."""
        # spaces before a word are set apart from its last one; what is left is matched
        todo = [u if u[0] == "\n" else MARK + u for u in units]
        spaced = [k for k, u in enumerate(units) if u[0] == " "]
        for k in spaced:
            core = units[k].lstrip(" ")
            todo[k] = core if core[:1] == "\n" else MARK + core if core else ""
        chars = np.fromiter(map(len, todo), np.int64, len(todo))
        short = np.flatnonzero((chars > 0) & (chars <= LONG))
        # where each unit's ids lie, and how many they are
        begin, n_ids, parts, held = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), [np.zeros(0, np.int32)], 0

        def put(k: list | np.ndarray, ids: np.ndarray, n: list | np.ndarray) -> None:
            nonlocal held
            n_ids[k], begin[k] = n, held + np.cumsum(n) - n
            parts.append(ids)
            held += len(ids)

        sums = np.cumsum(chars[short] + 1)
        at = 0
        while at < len(short):
            stop = int(np.searchsorted(sums, (sums[at - 1] if at else 0) + INDEXED)) + 1
            put(short[at:stop], *self.match([todo[k] for k in short[at:stop].tolist()]))
            at = stop
        for k in np.flatnonzero(chars > LONG).tolist():
            ids = self.match_long(todo[k])
            put([k], ids, [len(ids)])
        flat = np.concatenate(parts)
        for k in spaced:
            # the last mark merges with the word if it can, else with the marks before it
            own, spaces = flat[begin[k] : begin[k] + n_ids[k]], len(units[k]) - len(units[k].lstrip(" "))
            one = len(own) and own[0] == self.id[MARK]
            own = np.concatenate([np.array(self._run(spaces + 1 if one else spaces), np.int32), own[1:] if one else own])
            put([k], own, [len(own)])
        flat = np.concatenate(parts)
        before = np.concatenate([[0], np.cumsum(n_ids)])
        return flat[np.repeat(begin - before[:-1], n_ids) + np.arange(before[-1])], before

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text begins (and the last one ends)."""
        split = [self.units(t) for t in texts]
        every = list(chain.from_iterable(split))
        units = list(dict.fromkeys(every))
        place = dict(zip(units, range(len(units)), strict=True))
        index = np.fromiter(map(place.__getitem__, every), np.int64, len(every))
        flat, begin = self.encode_units(units)
        sizes = begin[index + 1] - begin[index]
        before = np.concatenate([[0], np.cumsum(sizes)])
        out = flat[np.repeat(begin[index] - before[:-1], sizes) + np.arange(before[-1])]
        return out, before[np.concatenate([[0], np.cumsum([len(s) for s in split], dtype=np.int64)])]

    def decode(self, ids: np.ndarray) -> str:
        table = self.decode_table()
        raw = b"".join([table[i] for i in ids.tolist()])
        return raw.decode("utf-8", "replace")[1:] if raw[:1] == b" " else raw.decode("utf-8", "replace")

    def decode_table(self) -> list[bytes]:
        if not hasattr(self, "_table"):
            self._table = [self.bytes.get(i) or t.replace(MARK, " ").encode() for i, t in enumerate(self.texts)]
        return self._table


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a model file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_crc32 (little-endian unsigned 32-bit), round_trip (decoding gives the text, its own space marks as spaces), ids."""
    ship(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            chars = np.cumsum(pc.fill_null(pc.utf8_length(whole.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < whole.num_rows:
                stop = max(int(np.searchsorted(chars, (chars[at - 1] if at else 0) + BATCH_CHARS, side="right")), at + 1)
                yield whole.slice(at, min(stop - at, BATCH))
                at += min(stop - at, BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts, c = [t or "" for t in b.column(1).to_pylist()], codec(model)
            ids, begin = c.encode(texts)
            cuts = list(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True))
            same = [c.decode(ids[x:y]) == t.replace(MARK, " ") for (x, y), t in zip(cuts, texts, strict=True)]
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[x:y].tobytes()) for x, y in cuts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(begin)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids))],
                names=["id", "n_tokens", "ids_crc32", "round_trip", "ids"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_crc32 long, round_trip boolean, ids array<int>")


def decode_ids(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text."""
    ship(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec(model).decode(np.array(x.as_py() or [], np.int32)) for x in b.column(1)], pa.string())], names=["id", "text"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {tokens.schema[id_col].dataType.simpleString()}, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLES: dict[str, str] = {}
