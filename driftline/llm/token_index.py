"""Token-id output: binary shards of raw ids with a minimal perfect hash index for keyed access.

A store is a folder. Each shard holds the documents of one key range in ascending key order:

* ``NNNNN.bin``: the ids of all its documents, one after the other, as little-endian unsigned integers of 2 or 4 bytes;
* ``NNNNN.idx``: a minimal perfect hash over the shard's keys. A key's slot stores a fingerprint, the ordinal of its
  first document and how many documents have the key; a second array has each document's end offset;
* ``NNNNN.keys``: the keys themselves, for readers that go over all of them.

``manifest.json`` lists the shards. A lookup finds the shards by key range (one, unless a key has so many documents that
they fill more), then needs one bucket read, one slot read and one payload read in each, however many documents there are.

Handling of odd rows: a null text is encoded as an empty text; a null key sorts first and is a key of its own; documents
that repeat a key stay, in order of a hash of their text (by which they can be dealt to several shards) and of the text,
and a lookup returns all of them; an empty table gives a store without shards. Columns other than the key and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.shared import Store

MAGIC = b"DLTIX1\0\0"
#: Distinct words whose ids a task remembers; beyond it the memory starts anew.
WORDS_REMEMBERED = 900_000
#: Bytes of the texts that a task encodes at a time.
BYTES_AT_A_TIME = 4 << 20
#: Keys a bucket of the perfect hash has on average.
KEYS_A_BUCKET = 4
NULL_HASH = np.uint64(0x9E3779B97F4A7C15)


# --- encoding -------------------------------------------------------------------------------------------------------


class WordEncoder:
    """Ids of whole texts as bytes, from a tokenizers specification.

    The usual word tokenizer lower-cases, splits at white space, separates letters from marks, and runs BPE within a
    word. For such a one a text's ids are those of its words in order, so words come from a memory and only new ones go
    to the library, many at a time and already normalised. A text that holds anything whose treatment could depend on
    more than a word (special tokens, text that isn't in NFC, several marks in a row, apostrophes, final sigma) goes to
    the library by its white-space separated parts or as a whole. Any other kind of tokenizer gets whole texts.
    """

    def __init__(self, tokenizer_json: str, limit: int = WORDS_REMEMBERED):
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        self.library = Tokenizer.from_str(tokenizer_json)
        self.limit = limit
        vocab = spec["model"]["vocab"]
        self.wide = max([*(vocab.values() if isinstance(vocab, dict) else [len(vocab)]), *(t["id"] for t in spec["added_tokens"])]) >= 1 << 16
        self.code = "I" if self.wide else "H"
        self.dtype = f"<u{4 if self.wide else 2}"
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.known: dict[str, bytes] = {}
        self.plain = self._is_word_bpe(spec)
        if self.plain:
            self.words = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None}))
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            for piece, i in vocab.items():
                self.ends[i] = piece.endswith(spec["model"]["end_of_word_suffix"])
            self.letters = _byte_letters()

    @staticmethod
    def _is_word_bpe(spec: dict) -> bool:
        text = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        return spec["model"]["type"] == "BPE" and bool(spec["model"].get("end_of_word_suffix")) and all(x in text for x in ('"NFC"', '"Lowercase"', '"Removed"', "[\\\\p{L}]+", "[^\\\\s\\\\p{L}\\\\p{N}]+", '"use_regex": false'))

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _by_library(self, text: str) -> bytes:
        return self._pack(self.library.encode(text, add_special_tokens=False).ids)

    def _learn(self, new: set[str]) -> None:
        if len(self.known) + len(new) > self.limit:
            self.known.clear()  # the caller asks again for all its words
        plain = [w for w in new if w.isalpha() and w.lower() == w]
        for i in range(0, len(plain), 500):
            some = plain[i : i + 500]
            ids = np.array(self.words.encode(" ".join(w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in some), add_special_tokens=False).ids, dtype=self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some) or stops[-1] != len(ids):
                self.known.update((w, self._by_library(w)) for w in some)
                continue
            raw, at = ids.tobytes(), 0
            for w, stop in zip(some, (stops * ids.itemsize).tolist(), strict=True):
                self.known[w] = raw[at:stop]
                at = stop
        self.known.update((w, self._by_library(w)) for w in new.difference(plain))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has. Nulls count as empty."""
        texts = pc.fill_null(texts, "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        whole = np.ones(len(texts), dtype=bool)
        if self.plain:
            whole = pc.match_substring_regex(texts, _HARD).to_numpy(zero_copy_only=False)
            for special in self.specials:
                whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        marks = pc.match_substring_regex(texts, _MARKS).to_numpy(zero_copy_only=False)
        ids, lens = [np.zeros(0, dtype=self.dtype)], np.zeros(len(texts), dtype=np.int64)
        order = []
        for group, how in ((np.flatnonzero(~whole & ~marks), "apart"), (np.flatnonzero(~whole & marks), "parts"), (np.flatnonzero(whole), "whole")):
            if not len(group):
                continue
            some = texts.take(pa.array(group))
            if how == "whole":
                got = [np.array(self.library.encode(t, add_special_tokens=False).ids, dtype=self.dtype) for t in some.to_pylist()]
                ids += got
                lens[group] = [len(x) for x in got]
            else:
                if how == "apart":  # each mark stands alone: it is a word of its own
                    some = pc.utf8_lower(some)
                    for mark in ",.":
                        some = pc.replace_substring(some, mark, f" {mark} ")
                flat, lens[group] = self._of_words(pc.utf8_split_whitespace(some))
                ids.append(flat)
            order.append(group)
        flat, order = np.concatenate(ids), np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
        if len(order) == len(texts) and (order[1:] > order[:-1]).all():
            return flat, lens
        starts = np.zeros(len(texts), dtype=np.int64)  # back to the order of the texts
        starts[order] = np.cumsum(lens[order]) - lens[order]
        return _pick(flat, starts, lens), lens

    def _of_words(self, split: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        encoded = split.flatten().dictionary_encode()
        words = encoded.dictionary.to_pylist()
        new = set(words).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.limit:
                self.known.clear()
                new = set(words)
            self._learn(new)
        found = list(map(self.known.__getitem__, words))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // np.dtype(self.dtype).itemsize
        index = encoded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[index] if len(found) else np.zeros(0, dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = _pick(np.frombuffer(b"".join(found), dtype=self.dtype), starts[index] if len(found) else counts, counts)
        total = np.concatenate([[0], np.cumsum(counts)])
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        return flat, np.diff(total[offsets])


def _pick(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The pieces values[start : start + len], one after the other."""
    at = np.cumsum(lens) - lens
    return values[np.repeat(starts - at, lens) + np.arange(int(lens.sum()))]


#: White space to some but not to the tokenizer, a letter with a long lower case, one whose lower case depends on its
#: place; and all but Latin, punctuation and Han, where normalisation might join or replace letters.
_HARD = r"[\x1c-\x1f\x{130}]|[^\x00-\x{2ff}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20bf}\x{3001}-\x{3020}\x{4e00}-\x{9fff}]"
#: Marks beside one another, or such as the tokenizer's pattern treats with their neighbours.
_MARKS = r"[^\s\pL\pN][^\s\pL\pN]|'"


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the others for those from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


_encoders: dict[int, WordEncoder] = {}


def _encoder(spec: str) -> WordEncoder:
    """One for each worker process: a later task of the process finds the words known."""
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(spec)
    return _encoders[key]


# --- minimal perfect hash -------------------------------------------------------------------------------------------


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer over unsigned integers, different for each salt."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hash_keys(keys: pa.Array) -> np.ndarray:
    """64-bit hashes of an array of integers or strings; nulls have a hash of their own."""
    none = keys.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(keys.type):
        raw = _mix(pc.fill_null(keys, 0).cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64), 7)
    else:
        import xxhash

        raw = np.fromiter((xxhash.xxh64_intdigest(k.as_py() or "", 7) for k in keys), dtype=np.uint64, count=len(keys))
    raw[none] = NULL_HASH
    return raw


def _as_keys(keys: pa.Array | list) -> pa.Array:
    """Integers as 64-bit ones, all else as strings."""
    keys = keys if isinstance(keys, pa.Array) else pa.array(keys)
    if pa.types.is_null(keys.type):
        return keys.cast(pa.int64())
    return keys.cast(pa.int64() if pa.types.is_integer(keys.type) else pa.string())


def build_mph(hashes: np.ndarray) -> np.ndarray:
    """Displacements of a hash-and-displace minimal perfect hash; distinct hashes get distinct slots of [0, n).

    Buckets go in order of falling size. One of several keys gets the first displacement, hashed together with each key,
    that sends them to free slots; a single key takes a free slot, stored as its negative minus one.
    """
    n = len(hashes)
    buckets = max(1, -(-n // KEYS_A_BUCKET))
    shift = np.zeros(buckets, dtype=np.int64)
    if n == 0:
        return shift
    of = (_mix(hashes, 1) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(buckets + 1))
    sizes = np.diff(starts)
    h2 = _mix(hashes, 2)
    taken = np.zeros(n, dtype=bool)
    steps = np.arange(1 << 10, dtype=np.uint64)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        own = order[starts[b] : starts[b + 1]]
        first, width = 0, 16
        while True:
            if first > 1 << 26:
                raise ValueError("two keys have the same 64-bit hash")
            with np.errstate(over="ignore"):
                slots = (_mix(h2[own][None, :] + _mix(np.uint64(first) + steps[:width], 3)[:, None], 5) % np.uint64(n)).astype(np.int64)
            fits = ~taken[slots].any(axis=1)
            if len(own) > 1:
                ordered = np.sort(slots, axis=1)
                fits &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if fits.any():
                at = int(np.argmax(fits))
                shift[b] = first + at
                taken[slots[at]] = True
                break
            first, width = first + width, min(1 << 10, width * 2)
    free = iter(np.flatnonzero(~taken).tolist())
    for b in np.flatnonzero(sizes == 1):
        shift[b] = -next(free) - 1
    return shift


def mph_slots(hashes: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    d = shift[(_mix(hashes, 1) % np.uint64(len(shift))).astype(np.int64)]
    with np.errstate(over="ignore"):
        tried = (_mix(_mix(hashes, 2) + _mix(np.maximum(d, 0).astype(np.uint64), 3), 5) % np.uint64(max(n, 1))).astype(np.int64)
    return np.where(d < 0, -d - 1, tried)


def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes, 4) >> np.uint64(32)).astype(np.uint32)


def _runs(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where equal neighbours begin, and how many there are each time."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    same = pc.fill_null(pc.equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False)
    none = keys.is_null().to_numpy(zero_copy_only=False)
    same = same | (none[1:] & none[:-1])
    first = np.concatenate([[0], np.flatnonzero(~same) + 1])
    return first, np.diff(np.append(first, len(keys)))


def pack_index(keys: pa.Array | list, ends: np.ndarray, wide: bool) -> bytes:
    """The .idx bytes for documents in order, with `ends` their end offsets in ids."""
    keys = _as_keys(keys)
    firsts, runs = _runs(keys)
    hashes = hash_keys(keys.take(pa.array(firsts)))
    shift = build_mph(hashes)
    slots = mph_slots(hashes, shift, len(firsts))
    prints, first, run = (np.zeros(len(firsts), dtype=t) for t in (np.uint32, np.uint64, np.uint32))
    prints[slots], first[slots], run[slots] = _fingerprints(hashes), firsts, runs
    head = MAGIC + struct.pack("<QQQQ", len(keys), len(firsts), len(shift), 4 if wide else 2)
    return head + b"".join(np.ascontiguousarray(x).tobytes() for x in (shift, first, np.asarray(ends, dtype=np.uint64), prints, run))


class ShardIndex:
    """A .idx file in memory; about 20 bytes a key."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an index of token shards")
        self.docs, self.keys, buckets, self.width = struct.unpack("<QQQQ", data[8:40])
        at = 40

        def take(dtype, n):
            nonlocal at
            out = np.frombuffer(data, dtype=dtype, count=n, offset=at)
            at += out.nbytes
            return out

        self.shift, self.first, self.ends = take(np.int64, buckets), take(np.uint64, self.keys), take(np.uint64, self.docs)
        self.prints, self.run = take(np.uint32, self.keys), take(np.uint32, self.keys)

    def find(self, keys: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
        """Ordinal of each key's first document (-1: a fingerprint says it is absent), and its number of documents."""
        if not self.keys or not len(keys):
            return np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        hashes = hash_keys(_as_keys(keys))
        slots = mph_slots(hashes, self.shift, self.keys)
        there = self.prints[slots] == _fingerprints(hashes)
        return np.where(there, self.first[slots].astype(np.int64), -1), np.where(there, self.run[slots], 0).astype(np.int64)

    def span(self, ordinal: int) -> tuple[int, int]:
        return (int(self.ends[ordinal - 1]) if ordinal else 0), int(self.ends[ordinal])


# --- writing --------------------------------------------------------------------------------------------------------

def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about BYTES_AT_A_TIME of text each."""
    if batch.num_rows:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.unique(np.append(np.searchsorted(sizes, np.arange(BYTES_AT_A_TIME, sizes[-1] + BYTES_AT_A_TIME, BYTES_AT_A_TIME)) + 1, batch.num_rows))
        start = 0
        for cut in cuts[cuts <= batch.num_rows].tolist():
            yield batch.slice(start, cut - start)
            start = cut


_SHARD = "shard int, n_docs long, n_ids long, first_key string, last_key string, width int"


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encodes every text and writes the store at `out`; returns the manifest, one entry a shard in key order.

    One shuffle deals the texts by key range (and within a key by a hash of the text); adaptive execution sets the number
    of shards from the bytes. A task encodes its range in one pass and keeps a batch of texts, its word memory, and for
    each document its key and 8 bytes; building the index takes some 100 bytes a document more.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError("the tokenizer file is too large to broadcast")
    sent = spark.sparkContext.broadcast(spec)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = _encoder(sent.value)
        size = 4 if encoder.wide else 2
        store, keys, ends, total = Store(out), [], [], 0
        temp = f = None
        for batch in batches:
            if f is None and batch.num_rows:
                temp, f = store.writer(f"{shard:05d}.bin")
            for some in _slices(batch):
                ids, lens = encoder.encode_batch(some.column(1))
                stops = np.cumsum(lens)
                ids = ids if end_id is None else np.insert(ids, stops, end_id)
                f.write(ids.tobytes())
                keys.append(some.column(0))
                ends.append(total + stops + (0 if end_id is None else np.arange(1, len(stops) + 1)))
                total += len(ids)
        if f is None:
            return
        f.close()
        store.commit(temp, f"{shard:05d}.bin")
        keys = _as_keys(pa.concat_arrays(keys))
        store.put(f"{shard:05d}.idx", pack_index(keys, np.concatenate(ends), encoder.wide))
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, pa.schema([("key", keys.type)])) as w:
            w.write_batch(pa.RecordBatch.from_arrays([keys], names=["key"]))
        store.put(f"{shard:05d}.keys", sink.getvalue())
        row = {"shard": [shard], "n_docs": [len(keys)], "n_ids": [total], "first_key": [json.dumps(keys[0].as_py())], "last_key": [json.dumps(keys[-1].as_py())], "width": [size]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.string()), ("last_key", pa.string()), ("width", pa.int32())]))

    rows = (
        docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("salt"))
        .repartitionByRange(F.col("key").asc_nulls_first(), "salt")
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "salt", F.col("text").asc_nulls_first())
        .mapInArrow(write, _SHARD)
        .collect()  # one row a shard
    )
    shards, start = [], 0
    for r in sorted(rows, key=lambda r: r.shard):
        shards.append({"shard": r.shard, "start": start, "n_docs": r.n_docs, "n_ids": r.n_ids, "first_key": json.loads(r.first_key), "last_key": json.loads(r.last_key), "width": r.width})
        start += r.n_ids
    Store(out).put("manifest.json", json.dumps(shards).encode())
    return shards


# --- reading --------------------------------------------------------------------------------------------------------


class TokenStore:
    """Keyed access to a written store; loads a shard's index when first asked for one of its keys."""

    def __init__(self, uri: str):
        self.store = Store(uri)
        self.shards = json.loads(self.store.read("manifest.json"))
        self.indexes: dict[int, ShardIndex] = {}
        rank = lambda k: (k is not None, 0 if k is None else k)
        self.first, self.last = ([rank(s[k]) for s in self.shards] for k in ("first_key", "last_key"))

    def get(self, key) -> list[np.ndarray]:
        """The id arrays of all documents with this key, in order; empty if there is none."""
        own = (key is not None, 0 if key is None else key)
        return [x for s in self.shards[bisect_left(self.last, own) : bisect_right(self.first, own)] for x in self._of_shard(s, key)]

    def _of_shard(self, s: dict, key) -> list[np.ndarray]:
        index = self.indexes.setdefault(s["shard"], ShardIndex(self.store.read(f"{s['shard']:05d}.idx"))) if s["shard"] not in self.indexes else self.indexes[s["shard"]]
        first, run = index.find([key])
        out = []
        with self.store.open(f"{s['shard']:05d}.bin") as f:
            for o in range(int(first[0]), int(first[0] + run[0])) if first[0] >= 0 else ():
                a, b = index.span(o)
                f.seek(a * index.width)
                out.append(np.frombuffer(f.read((b - a) * index.width), dtype=f"<u{index.width}"))
        return out


def read_tokens(spark: SparkSession, out: str, shards: list[dict], key_type: str = "long") -> DataFrame:
    """One row a document of the store: doc_id, start, n_tokens, ids_crc32, shard, in key order within a shard.

    Each task takes a shard and finds every one of its keys through the perfect hash, then reads its payload.
    """
    schema = f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long, shard int"
    if not shards:
        return spark.createDataFrame([], schema)
    arrow = pa.schema([("doc_id", pa.string() if key_type == "string" else pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(out)
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index = ShardIndex(store.read(f"{shard:05d}.idx"))
                keys = pa.ipc.open_stream(store.read(f"{shard:05d}.keys")).read_next_batch().column(0)
                distinct = keys.take(pa.array(_runs(keys)[0]))
                firsts, runs = index.find(distinct)
                cols: list[list] = [[], [], [], []]
                with store.open(f"{shard:05d}.bin") as f:
                    for key, first, run in zip(distinct.to_pylist(), firsts.tolist(), runs.tolist(), strict=True):
                        for o in range(first, first + run):
                            a, b = index.span(o)
                            f.seek(a * index.width)
                            ids = np.frombuffer(f.read((b - a) * index.width), dtype=f"<u{index.width}")
                            for c, v in zip(cols, (key, start + a, b - a, zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip([*cols, [shard] * len(cols[0])], arrow, strict=True)], schema=arrow)

    listed = spark.createDataFrame([(s["shard"], s["start"]) for s in shards], "shard int, start long")
    return listed.repartition(len(shards)).mapInArrow(read, schema)
