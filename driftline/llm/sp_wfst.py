"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Machines are compiled from a model file, with weights in the tropical semiring (a path weighs the sum of its arcs, of
several paths the lightest counts, and an infinite weight forbids one):

* the normaliser: an arc before the first character emits the dummy prefix, a space becomes the model's space mark, and
  every other character itself (models with a character map are refused);
* the pieces: a trie over characters whose final states emit piece ids. It is composed with the normaliser when the model
  is compiled: wherever a piece goes on with a space mark, the composed machine has an arc for a space as well, so it
  reads texts as they are;
* byte fallback: a character that is no piece goes over an arc that emits its UTF-8 bytes' pieces (or the unknown piece);
* for models of type BPE, an acceptor over adjacent pieces: a pair weighs nothing if merging the two pieces' characters
  by score gives those two pieces back, and is forbidden otherwise. A sequence is what BPE merging gives exactly if all
  adjacent pairs are let through.

Weights. In a unigram model a piece weighs its negative score and fallback 10 more than the worst piece, so weights order
the paths and the lightest is the library's segmentation. Scores of a BPE model are ranks of merges and no weights: the
library's segmentation is not the lightest path by any sum of them. There the acceptor's infinite weights forbid every
path but one, whatever finite weights the arcs have, and the shortest path is that one.

An input is composed with them as it is read: a state is a position with the piece that ends there. For unigram models the
tropical shortest path is found by relaxing positions from left to right. Under the pair acceptor only one piece can end
at a position by a path of finite weight, so whichever path gets to the end is the shortest: it is searched depth first,
longest piece first, and no position is entered twice.

Since no piece holds a space mark after another character, a text's chunks (spaces and what follows up to the next) are
independent, as is whatever stands beside a character without a piece. Chunks come from a bounded memory.

Odd rows: a null text is an empty one, which has no ids; texts of any length are cut into chunks, so a path never spans
more than a chunk; repeated rows stay; an empty table gives an empty result. A space mark in a text decodes as a space,
as in the library, so such a text's round trip is reported as false.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.token_index import _pick, _slices

MARK = "▁"
#: Chunks and pairs that a worker remembers: a young and an old half, of which the old one goes when the young is full.
CHUNKS_REMEMBERED = 300_000
PAIRS_REMEMBERED = 500_000
_CUT = "\x1e"
_CHUNKS = re.compile(f"[ {MARK}]+[^ {MARK}\n]*|[^ {MARK}\n]+|\n")
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class Transducer:
    """The compiled machines of a model, with encode and decode over them."""

    def __init__(self, model: bytes, chunks: int = CHUNKS_REMEMBERED):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("models with a character map or white-space clean-up are not supported")
        if any(p.type == _USER for p in proto.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.prefix = " " if spec.add_dummy_prefix else ""  # read like a space of the text's own
        self.bpe = proto.trainer_spec.model_type == _BPE
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN), 0)
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.names = [p.piece for p in proto.pieces]
        self.weights = [p.score for p in proto.pieces]
        self.unknown_weight = 10.0 - min((p.score for p in proto.pieces if p.type == _NORMAL), default=0.0)
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        if any(MARK in p[1:] and p.strip(MARK) for p in self.ids) or "\n" in "".join(self.ids):
            raise ValueError("pieces across white space are not supported")
        # Normaliser and pieces composed: a state's arcs by character; state 0 is the start; emits[state] is a piece id or -1.
        self.arcs: list[dict[str, int]] = [{}]
        self.emits: list[int] = [-1]
        for piece, i in self.ids.items():
            state = 0
            for c in piece:
                nxt = self.arcs[state].get(c)
                if nxt is None:
                    nxt = len(self.arcs)
                    self.arcs[state].update((x, nxt) for x in self.read_as(c))
                    self.arcs.append({})
                    self.emits.append(-1)
                state = nxt
            self.emits[state] = i
        # Merge order, and for each piece that merging gives its last two parts (None for a character).
        order = sorted(self.ids.values(), key=lambda i: -self.weights[i])
        self.ranks = dict(zip(order, range(len(order)), strict=True))
        self.halves = {i: h for p, i in self.ids.items() if (h := self._halves(p)) is not False}
        self.wide = len(self.names) > 1 << 16
        self.code, self.dtype = ("I", "<u4") if self.wide else ("H", "<u2")
        self.limit = chunks
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.pairs_before: dict[int, bool] = {}
        out = [self._surface(i, p.type) for i, p in enumerate(proto.pieces)]
        self.out_sizes = np.array([len(x) for x in out], dtype=np.int64)
        self.out_starts = np.cumsum(self.out_sizes) - self.out_sizes
        self.out_bytes = np.frombuffer(b"".join(out), dtype=np.uint8)

    @staticmethod
    def read_as(c: str) -> str:
        """The characters for which the normaliser gives this one."""
        return f" {MARK}" if c == MARK else "" if c == " " else c

    def _surface(self, i: int, kind: int) -> bytes:
        if kind == _BYTE:
            return bytes([int(self.names[i][1:-1], 16)])
        if kind == _CONTROL:
            return b""
        return " ⁇ ".encode() if kind == _UNKNOWN else self.names[i].replace(MARK, " ").encode()

    def _halves(self, piece: str) -> tuple[int, int] | None | bool:
        """The last two parts that merging a piece's characters joins; None for a character, False if it isn't given."""
        if len(piece) == 1:
            return None
        symbols = list(piece)
        while len(symbols) > 2:
            found = [(-self.weights[got], i) for i in range(len(symbols) - 1) if (got := self.ids.get(symbols[i] + symbols[i + 1])) is not None]
            if not found:
                return False
            i = min(found)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return (self.ids[symbols[0]], self.ids[symbols[1]]) if symbols[0] in self.ids and symbols[1] in self.ids else False

    # --- the pair acceptor ------------------------------------------------------------------------------------------

    def merged(self, symbols: list[str]) -> list[str]:
        """Symbols after merging, best score first and leftmost among equals, while a neighbouring pair is a piece."""
        symbols = list(symbols)
        while True:
            best, where = None, -1
            for i in range(len(symbols) - 1):
                got = self.ids.get(symbols[i] + symbols[i + 1])
                if got is not None and (best is None or self.weights[got] > best):
                    best, where = self.weights[got], i
            if where < 0:
                return symbols
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]

    def passes(self, left: int, right: int) -> bool:
        """Whether the acceptor has an arc from one piece to the next; left -1 is the start."""
        key = (left + 1) * len(self.names) + right
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= PAIRS_REMEMBERED // 2:
                self.pairs_before = dict(self.pairs)
                self.pairs.clear()  # path() holds on to this one
            ok = self.pairs_before.get(key)
            ok = self.pairs[key] = self._passes(left, right) if ok is None else ok
        return ok

    def _passes(self, left: int, right: int) -> bool:
        """Takes the merges at the seam back, latest first, and looks for a merge across it that would have come before.

        A piece that merging its own characters doesn't give never passes. Runs of space marks, whose scores tie, are
        merged outright.
        """
        if right not in self.halves or (left >= 0 and left not in self.halves):
            return False
        if left < 0:
            return True
        a, b = self.names[left], self.names[right]
        if not b.strip(MARK) or not a.strip(MARK):
            return self.merged(list(a + b)) == [a, b]
        ranks, halves, ids = self.ranks, self.halves, self.ids
        limit = float("inf")
        while True:
            across = ids.get(self.names[left] + self.names[right])
            if across is not None and ranks[across] < limit:
                return False
            to_left, to_right = halves[left], halves[right]
            if to_left is None and to_right is None:
                return True
            if to_right is None or (to_left is not None and ranks[left] > ranks[right]):
                limit, left = ranks[left], to_left[1]
            else:
                limit, right = ranks[right] + 0.5, to_right[0]

    # --- composition and shortest path ------------------------------------------------------------------------------

    def path(self, chunk: str) -> list[int]:
        """Ids on the shortest path of a chunk through pieces, byte fallback and, for BPE, the pair acceptor."""
        got = self._only_path(chunk) if self.bpe else self._lightest_path(chunk)
        if not self.bytes:  # the library joins neighbouring unknown characters
            got = [x for i, x in enumerate(got) if x != self.unknown or not i or got[i - 1] != x]
        return got

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def _only_path(self, chunk: str) -> list[int]:
        n, at, prev = len(chunk), 0, -1
        arcs, emits, pairs, size = self.arcs, self.emits, self.pairs, len(self.names)
        entered = bytearray(n + 1)
        trail: list[tuple[int, int, list[tuple[int, int]], int]] = []  # position, piece before, ways left, way taken
        while at < n:
            state, ways = 0, []
            for end in range(at, n):
                state = arcs[state].get(chunk[end])
                if state is None:
                    break
                if emits[state] >= 0 and not entered[end + 1]:
                    ways.append((end + 1, emits[state]))
            if (MARK if chunk[at] == " " else chunk[at]) not in self.ids and not entered[at + 1]:
                ways.append((at + 1, -1))
            while True:
                while not ways:
                    if not trail:
                        raise ValueError(f"no path through {chunk!r}")
                    at, prev, ways, _ = trail.pop()
                end, piece = ways.pop()
                if entered[end]:
                    continue
                if piece >= 0:
                    ok = pairs.get((prev + 1) * size + piece)
                    if not (self.passes(prev, piece) if ok is None else ok):
                        continue
                entered[end] = 1
                trail.append((at, prev, ways, piece))
                at, prev = end, piece
                break
        return [x for start, _, _, piece in trail for x in ([piece] if piece >= 0 else self._fallback(chunk[start]))]

    def _lightest_path(self, chunk: str) -> list[int]:
        n, inf = len(chunk), float("inf")
        cost = [0.0] + [inf] * n
        back: list[tuple[int, list[int]]] = [(0, [])] * (n + 1)
        arcs, emits = self.arcs, self.emits
        for i in range(n):
            state = 0
            for j in range(i, n):
                state = arcs[state].get(chunk[j])
                if state is None:
                    break
                piece = emits[state]
                if piece >= 0 and cost[i] - self.weights[piece] < cost[j + 1]:
                    cost[j + 1], back[j + 1] = cost[i] - self.weights[piece], (i, [piece])
            if (MARK if chunk[i] == " " else chunk[i]) not in self.ids and cost[i] + self.unknown_weight < cost[i + 1]:
                cost[i + 1], back[i + 1] = cost[i] + self.unknown_weight, (i, self._fallback(chunk[i]))
        out: list[list[int]] = []
        at = n
        while at:
            at, ids = back[at]
            out.append(ids)
        return [x for ids in reversed(out) for x in ids]

    def _chunk(self, chunk: str) -> bytes:
        got = self.known.get(chunk)
        if got is None:
            if len(self.known) >= self.limit // 2:
                self.known_before, self.known = self.known, {}
            got = self.known_before.get(chunk)
            got = self.known[chunk] = array(self.code, self.path(chunk)).tobytes() if got is None else got
        return got

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        if not text:
            return np.zeros(0, dtype=self.dtype)
        return np.frombuffer(b"".join(map(self._chunk, _CHUNKS.findall(self.prefix + text))), dtype=self.dtype)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has. Nulls count as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, f"  |^ |[{MARK}{_CUT}]|^$").to_numpy(zero_copy_only=False) if self.prefix else np.ones(len(texts), dtype=bool)
        lens = np.zeros(len(texts), dtype=np.int64)
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        ids = [np.zeros(0, dtype=self.dtype)]
        if len(plain):
            some = pc.replace_substring(texts.take(pa.array(plain)), " ", f"{_CUT} ")
            some = pc.replace_substring(some, "\n", f"{_CUT}\n{_CUT}")
            split = pc.split_pattern(pc.binary_join_element_wise(self.prefix, some, ""), _CUT)
            encoded = split.flatten().dictionary_encode()
            found = [self._chunk(c) for c in encoded.dictionary.to_pylist()]
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // np.dtype(self.dtype).itemsize
            index = encoded.indices.to_numpy(zero_copy_only=False)
            counts = sizes[index]
            ids.append(_pick(np.frombuffer(b"".join(found), dtype=self.dtype), (np.cumsum(sizes) - sizes)[index], counts))
            total = np.concatenate([[0], np.cumsum(counts)])
            lens[plain] = np.diff(total[split.offsets.to_numpy() - split.offsets[0].as_py()])
        for i in rest.tolist():
            got = self.encode(texts[i].as_py())
            ids.append(got)
            lens[i] = len(got)
        order = np.concatenate([plain, rest])
        starts = np.zeros(len(texts), dtype=np.int64)
        starts[order] = np.cumsum(lens[order]) - lens[order]
        return _pick(np.concatenate(ids), starts, lens), lens

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, by the machines the other way round."""
        raw = _pick(self.out_bytes, self.out_starts[ids], self.out_sizes[ids]).tobytes().decode("utf-8", "replace")
        return raw[1:] if self.prefix and raw.startswith(" ") else raw


_compiled: dict[int, Transducer] = {}


def _transducer(model: bytes) -> Transducer:
    key = zlib.crc32(model)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(model)
    return _compiled[key]


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """All columns of `docs`, then sp_ids (array of int), sp_text (the decoded ids) and sp_round_trip (equal to the text).

    Columns of `docs` with one of those names go. One pass without a shuffle.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = f.read()
    if len(model) > 64 << 20:
        raise ValueError("the model file is too large to broadcast")
    sent = spark.sparkContext.broadcast(model)
    kept = docs.select([c for c in docs.columns if c.lower() not in ("sp_ids", "sp_text", "sp_round_trip")])
    names = list(kept.columns)
    at = names.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(sent.value)
        for batch in batches:
            ordered = batch.select([at, at]).rename_columns(["key", "text"])
            start = 0
            for some in _slices(ordered):
                ids, lens = machine.encode_batch(some.column(1))
                stops = np.cumsum(lens)
                texts = [machine.decode(ids[b - n : b]) for b, n in zip(stops.tolist(), lens.tolist(), strict=True)]
                same = [t == (x or "") for t, x in zip(texts, some.column(1).to_pylist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                own = batch.slice(start, some.num_rows)
                start += some.num_rows
                yield pa.RecordBatch.from_arrays([*own.columns, lists, pa.array(texts, type=pa.string()), pa.array(same)], names=[*names, "sp_ids", "sp_text", "sp_round_trip"])

    return kept.mapInArrow(run, f"{schema}, sp_ids array<int>, sp_text string, sp_round_trip boolean")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the comma-joined ids), decoded_sha256 and round_trip of encode_decode's rows."""
    joined = F.array_join(F.col("sp_ids").cast("array<string>"), ",")
    return encoded.select(F.col(id_col).alias("doc_id"), F.size("sp_ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("sp_text", 256).alias("decoded_sha256"), F.col("sp_round_trip").alias("round_trip"))

