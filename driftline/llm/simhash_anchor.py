"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has 64 bits: bit i is 1 if more than half of the hashes of its four-word shingles (repeats
count) have it. Fingerprints that differ in at most THRESHOLD bits are linked, and a component is whatever links reach.

Covering. The 64 bits are cut into BLOCKS blocks of 21, 21 and 22 bits. Two fingerprints that differ in at most 4 bits
differ in at most 4 // 3 = 1 bit of some block. In each block the anchors are the words of a covering code: the perfect
[15, 11] Hamming code on the first 15 bits (every point is within 1 of exactly one code word) times all words on the
other bits. So the covering radius is 1 and every block value has one home anchor. A fingerprint is sent to its home and
to every anchor within radius 1 + block threshold 1 that is the home of some point within the block threshold: about 14
of 2^17 anchors. If two fingerprints are within 1 in a block, then the one's home anchor is among the other's anchors,
and they meet there. Fingerprints are compared per anchor, home against all that were sent there.

Within an anchor only a spanning forest leaves the task, never all pairs: a search takes a fingerprint off the list,
compares it with all that no component has claimed, and goes on from those found. A dense group so costs about as many
steps as it has members. Copies never get this far: the work is on distinct fingerprints. Anchors with more than CHUNK
rows are cut into chunks, and every two chunks of the anchor meet in a task of their own, so no task holds more than
twice CHUNK rows and nothing is left out. Components come from rounds of hooking and pointer jumping, all distributed;
each round is written to the shared folder. Joins on a root, a parent or a fingerprint, of which one can have very many
rows, take the side that has one row of each as a broadcast if its measured bytes are few, and are otherwise joins of two
plain tables, whose skewed keys adaptive execution splits.

Odd rows: a null or empty text has fingerprint zero; a null doc_id keeps its row, and its component is named by the
smallest doc_id that isn't null (null if there is none); repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import fresh, maybe_broadcast, measured_broadcast, remove, shared_path, written

THRESHOLD = 4
#: (first bit, bits) of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
BLOCK_THRESHOLD = THRESHOLD // len(BLOCKS)
HAMMING = 15
#: Rows of an anchor that one task compares with one another, or with as many of another chunk.
CHUNK = 8192
#: More block values than can send rows to one anchor: those within 2 bits of it (1 + 22 + 231).
FEEDERS = 256
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# --- fingerprints ---------------------------------------------------------------------------------------------------


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_UPPER).split()  # bytes split at ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends)]
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])]  # noqa: B905
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        some = np.array(hashes[i : i + (1 << 14)], dtype="<u8")
        bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_hash and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((simhash(t.as_py(), shingle, seed) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


# --- anchors --------------------------------------------------------------------------------------------------------


def _syndrome_table() -> np.ndarray:
    """For each value of 15 bits, its Hamming code word: the xor of set positions (1 to 15) names the bit to flip."""
    v = np.arange(1 << HAMMING, dtype=np.uint32)
    s = np.zeros_like(v)
    for i in range(HAMMING):
        s ^= np.where(v >> i & 1, np.uint32(i + 1), np.uint32(0))
    return np.where(s > 0, v ^ (np.uint32(1) << (np.maximum(s, 1) - 1)), v).astype(np.uint32)


_CODE = _syndrome_table()


def homes(value: np.ndarray) -> np.ndarray:
    """The home anchor of each block value: nearest code word on the low 15 bits, the other bits as they are."""
    low = value & np.uint32((1 << HAMMING) - 1)
    return (value ^ low) | _CODE[low]


def anchors(value: np.ndarray, bits: int) -> np.ndarray:
    """(n, 1 + bits): the home anchor of each block value first, then those of all values one bit away."""
    near = value[:, None] ^ np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)[None, :]
    return homes(near)


def _dealt(distinct: DataFrame) -> DataFrame:
    """A row for each fingerprint and anchor: key (block and anchor), fp, home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(start, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                keys, fp, home = [], [], []
                for block, (first, bits) in enumerate(BLOCKS):
                    value = (fps.view(np.uint64) >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.uint32)
                    to = anchors(value, bits)
                    own = to[:, 0].copy()
                    to.sort(axis=1)
                    fresh = np.ones(to.shape, dtype=bool)
                    fresh[:, 1:] = to[:, 1:] != to[:, :-1]
                    row, _ = np.nonzero(fresh)
                    picked = to[fresh]
                    keys.append(picked.astype(np.int32) * len(BLOCKS) + block)
                    fp.append(fps[row])
                    home.append(picked == own[row])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys), type=pa.int32()), pa.array(np.concatenate(fp)), pa.array(np.concatenate(home))], names=["key", "fp", "home"])

    return distinct.mapInArrow(run, "key int, fp long, home boolean")


# --- comparing ------------------------------------------------------------------------------------------------------


def forest(fp: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest over the links between homes and all rows of an anchor.

    Rows claimed by a component are never compared again, so there are at most n - 1 edges.
    """
    word = fp.view(np.uint64)
    seeds = np.flatnonzero(home)
    if len(fp) < 2 or not len(seeds):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if len(seeds) * len(fp) <= 1 << 20 and (np.bitwise_count(word[seeds][:, None] ^ word[None, :]) <= threshold).sum() == len(seeds):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    waiting = np.arange(len(fp))
    claimed = np.zeros(len(fp), dtype=bool)
    a, b = [], []
    for seed in seeds.tolist():
        if claimed[seed]:
            continue
        claimed[seed] = True
        waiting = waiting[waiting != seed]
        stack = [seed]
        while stack and len(waiting):
            at = stack.pop()
            near = np.bitwise_count(word[waiting] ^ word[at]) <= threshold
            if not home[at]:
                near &= home[waiting]
            if near.any():
                found = waiting[near]
                waiting = waiting[~near]
                claimed[found] = True
                stack += found.tolist()
                a.append(np.full(len(found), at))
                b.append(found)
    if not a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return fp[np.concatenate(a)], fp[np.concatenate(b)]


def _hot(distinct: DataFrame) -> DataFrame:
    """key and parts of the anchors that may get more than CHUNK rows.

    At most FEEDERS block values send rows to an anchor, so values with at most CHUNK // FEEDERS fingerprints bring it
    no more than CHUNK rows together. Only values with more, of which there are few, are counted anchor by anchor.
    """
    light = CHUNK // FEEDERS
    value = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1)).alias("value")) for i, (first, bits) in enumerate(BLOCKS)]
    heavy = distinct.select(F.explode(F.array(*value)).alias("v")).groupBy("v.block", "v.value").agg(F.count("*").alias("n")).where(F.col("n") > light)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, value, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            keys, counts = [], []
            for b, (_, bits) in enumerate(BLOCKS):
                own = block == b
                to = np.sort(anchors(value[own].astype(np.uint32), bits), axis=1)
                fresh = np.ones(to.shape, dtype=bool)
                fresh[:, 1:] = to[:, 1:] != to[:, :-1]
                row, _ = np.nonzero(fresh)
                keys.append(to[fresh].astype(np.int32) * len(BLOCKS) + b)
                counts.append(n[own][row].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys), type=pa.int32()), pa.array(np.concatenate(counts))], names=["key", "n"])

    loads = heavy.mapInArrow(spread, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return loads.where(F.col("n") > CHUNK // 2).select("key", F.ceil((F.col("n") + CHUNK) / CHUNK).cast("int").alias("parts"))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a > b, as unsigned order doesn't matter) that connect exactly what links connect, over distinct fp."""
    spark = distinct.sparkSession
    dealt = _dealt(distinct)
    hot = written(_hot(distinct), "hot")
    parts = maybe_broadcast(hot, hot.count(), 16)
    joined = dealt.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.expr("cast(pmod(xxhash64(fp), parts) as int)")
    met = joined.withColumn("part", part).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    met = met.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "fp", "home")
    per = spark.conf.get("spark.sql.shuffle.partitions")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; at most one group is held."""
        held: list[tuple[np.ndarray, ...]] = []
        out_a, out_b, waiting = [], [], 0

        def close() -> None:
            nonlocal waiting
            if held:
                fp, home = (np.concatenate([h[i] for h in held]) for i in (1, 2))
                x, y = forest(fp, home)
                out_a.append(x)
                out_b.append(y)
                waiting += len(x)

        for batch in batches:
            key, lo, hi, fp, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            group = np.stack([key, lo, hi], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1, [len(group)]])
            for s, e in zip(cuts[:-1], cuts[1:]):  # noqa: B905
                if e <= s:
                    continue
                if held and (held[0][0] != group[s]).any():
                    close()
                    held = []
                held.append((group[s], fp[s:e].astype(np.int64), home[s:e].astype(bool)))
            if waiting >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])
                out_a, out_b, waiting = [], [], 0
        close()
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    found = met.repartition(int(per), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(compare, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


# --- components -----------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of an edge; the root is one node of its component.

    Each round hooks every root to its smallest smaller neighbour, flattens the trees by pointer jumping, and keeps the
    edges between different roots. At least every root with a smaller neighbour goes, so rounds are logarithmic.
    """
    spark = edges.sparkSession
    used = [shared_path(spark, "edges")]
    edges = written(edges, "edges", used[0])
    parents: DataFrame | None = None
    while not edges.isEmpty():
        hook = edges.groupBy("a").agg(F.min("b").alias("parent")).withColumnRenamed("a", "node")
        used.append(shared_path(spark, "hook"))
        hook = written(hook, "hook", used[-1])
        while True:
            up = measured_broadcast(hook.select(F.col("node").alias("parent"), F.col("parent").alias("grand")))
            jumped = hook.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved"))
            used.append(shared_path(spark, "hook"))
            jumped = written(jumped, "hook", used[-1])
            hook = jumped.select("node", "parent")
            if jumped.where("moved").isEmpty():
                break
        root = lambda side: measured_broadcast(hook.select(F.col("node").alias(side), F.col("parent").alias(f"{side}_root")))
        moved = edges.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y")).where("x != y")
        used.append(shared_path(spark, "edges"))
        edges = written(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges", used[-1])
        if parents is None:
            parents = hook.select("node", F.col("parent").alias("root"))
        else:
            step = measured_broadcast(hook.select(F.col("node").alias("root"), F.col("parent").alias("next")))
            grown = parents.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            parents = grown.unionByName(hook.join(parents.select("node"), "node", "left_anti").select("node", F.col("parent").alias("root")))
        used.append(shared_path(spark, "parents"))
        parents = written(parents, "parents", used[-1])
    for path in used[:-1]:
        remove(spark, path)
    if parents is None:
        return spark.createDataFrame([], "node long, root long")
    return parents.unionByName(parents.select(F.col("root").alias("node"), "root").distinct())  # a root never hooks


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fp), and for every fingerprint its root and component_id."""
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct.select("fp")))
    named = written(distinct.join(measured_broadcast(roots), distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"), F.col("node").isNotNull().alias("linked")), "named")
    # Only linked fingerprints have others in their component; the least of each is a table, so that a join with many
    # fingerprints of one root can be split.
    least = written(named.where("linked").groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    linked = named.where("linked").join(measured_broadcast(least), "root").select("fp", "root", "component_id")
    alone = named.where("NOT linked").select("fp", "root", F.col("first_id").alias("component_id"))
    return prints, written(linked.unionByName(alone), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row."""
    prints, classes = _classes(docs, id_col, text_col)
    return prints.join(measured_broadcast(classes), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each component: that of the smallest id, nulls last, then of the smallest text hash."""
    prints, classes = _classes(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    key = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit("0").cast(kind)).alias("id"), "text_hash"]
    first = prints.join(measured_broadcast(classes), "fp").groupBy("root").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
    names = fresh(docs, "first_none", "first_id", "first_hash")
    marked = docs.withColumns({names[0]: F.col(id_col).isNull(), names[1]: F.coalesce(F.col(id_col), F.lit("0").cast(kind)), names[2]: F.xxhash64(text_col)})
    kept = marked.join(first.toDF(*names), names, "left_semi")
    return kept.dropDuplicates(names).select(*docs.columns)
