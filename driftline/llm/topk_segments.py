"""Exact top-k inner-product search with multi-resolution segment statistics.

A vector is cut into segments; a segment has the mean m and the deviation s of its components. For a query q and a
candidate x, a segment of n components adds at most n * (m_q * m_x + s_q * s_x) to the inner product (Cauchy-Schwarz on
the centred parts). As |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, this upper bound on the score is the lower bound on the
distance. Bounds go from coarse to fine (RESOLUTIONS segments); whoever stays below the k-th best exact score known so
far drops out at the first resolution that shows it, and survivors get exact integer scores.

Plan. Candidates stay where they are: they are dealt out once and never copied. Queries, with what is the k-th best score
of each so far, are written in blocks to the shared folder, and a task that holds a block of candidates reads them one by
one. The search goes over growing parts of the candidates, chosen by a hash: first about FIRST rows, then each time
GROWTH times as many as before. So a part finds thresholds set by a GROWTH-th of all rows seen, and a query gets about
GROWTH * k rows back from it, however many rows and tasks there are: what is shuffled grows with the queries and the
logarithm of the candidates, not with the product of both. What is compared does grow with the product as far as bounds
don't end a comparison early; at vectors without any structure they hardly do.

Odd rows: vectors that are null or hold null or non-finite components, and rows with a null id, take no part. Vectors of
several lengths are searched side by side: a query is compared with the candidates of its own length. Repeated ids are
rows of their own: a query leaves out its own row, not another one of its id, and each row of a repeated query has its own
k. Scores that could pass 2^53 are found in whole numbers; one beyond 64 bits counts as the nearest that fits. An empty
table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.shared import Store, remove, shared_path, written

#: Segments at each resolution, coarse to fine.
RESOLUTIONS = (2, 8, 16)
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
#: Rows of the first part of the candidates (fewer if they would take more than FIRST_BYTES), and growth of the parts.
FIRST = 2048
FIRST_BYTES = 4 << 20
GROWTH = 4
SCALE = 64
#: Bounds are floating-point sums; a score this much above its bound would still be seen.
SLACK = 1e-6
#: Below this share of surviving pairs they are scored one by one, else as a whole block.
FEW = 0.05

_FOUND = "q_row long, query_id long, vec_id long, score long"


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """(n, 2 * segments): sqrt(size) * mean and sqrt(size) * deviation of each segment.

    The product of two such rows is the upper bound on the inner product.
    """
    out = []
    for part in np.array_split(np.arange(x.shape[1]), segments):
        if len(part):
            own = x[:, part]
            root = np.sqrt(len(part))
            out += [own.mean(axis=1) * root, own.std(axis=1) * root]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 0))


class Block:
    """Vectors of one length with their row numbers and ids; of queries also the k-th best score so far and its id."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, least: np.ndarray | None = None, least_id: np.ndarray | None = None):
        self.rows, self.ids, self.v = rows, ids, v
        self.least = np.full(len(rows), -np.inf) if least is None else least
        self.least_id = np.full(len(rows), np.iinfo(np.int64).max) if least_id is None else least_id
        self.peak = float(np.abs(v.astype(np.float64)).max(initial=0))
        self.floats = v.astype(np.float64)
        self.stats = [segment_stats(self.floats, s) for s in RESOLUTIONS]


def _exact(q: Block, c: Block) -> np.ndarray:
    """All inner products in whole numbers, at most 64 bits shown."""
    if q.peak * c.peak * max(1, q.v.shape[1]) < 2.0**62:
        return q.v @ c.v.T
    return np.clip(q.v.astype(object) @ c.v.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def search_block(q: Block, c: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query (place in q), candidate id and score of each query's k best in c that can still be among its k best.

    Highest score first, then smallest id.
    """
    none = (np.zeros(0, dtype=np.int64),) * 3
    if not len(q.rows) or not len(c.rows):
        return none
    order = np.argsort(c.ids, kind="stable")
    ids, rows = c.ids[order], c.rows[order]
    own = np.argsort(rows)
    spot = np.minimum(np.searchsorted(rows[own], q.rows), len(rows) - 1)
    itself = np.flatnonzero(rows[own][spot] == q.rows)
    if q.peak * c.peak * max(1, q.v.shape[1]) < 2.0**53:
        alive = None
        for sq, sc in zip(q.stats, c.stats, strict=True):
            bound = sq @ sc[order].T
            ok = bound + SLACK * (1 + np.abs(bound)) >= q.least[:, None]
            alive = ok if alive is None else alive & ok
        alive[itself, own[spot[itself]]] = False
        if alive.mean() < FEW:
            i, j = np.nonzero(alive)
            score = np.einsum("ij,ij->i", q.floats[i], c.floats[order[j]]).astype(np.int64)
        else:
            every = (q.floats @ c.floats[order].T).astype(np.int64)
            i, j = np.nonzero(alive & (every >= q.least[:, None]))
            score = every[i, j]
    else:
        every = _exact(q, c)[:, order]
        alive = np.ones(every.shape, dtype=bool)
        alive[itself, own[spot[itself]]] = False
        i, j = np.nonzero(alive & (every >= q.least[:, None]))
        score = every[i, j]
    fits = (score > q.least[i]) | ((score == q.least[i]) & (ids[j] < q.least_id[i]))
    i, j, score = i[fits], j[fits], score[fits]
    best = np.lexsort((j, -score, i)) if score.size and score.min() > -(2**63) else np.lexsort((j, -score.astype(np.float64), i))
    i, j, score = i[best], j[best], score[best]
    first = np.searchsorted(i, i, side="left")
    top = np.arange(len(i)) - first < k
    return i[top], ids[j[top]], score[top]


def _blocks(rows: pa.RecordBatch, least: bool) -> list[Block]:
    """The vectors of a batch (row, vec_id, v and, for queries, least, least_id), by length."""
    cols = [rows.column(i) for i in range(rows.num_columns)]
    sizes = np.diff(cols[2].offsets.to_numpy())
    flat = cols[2].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        v = flat[starts[at][:, None] + np.arange(size)[None, :]]
        plain = [cols[i].to_numpy(zero_copy_only=False)[at].astype(np.int64) for i in (0, 1)]
        known = []
        if least:
            score = cols[3].to_pylist()
            known = [np.array([-np.inf if score[i] is None else float(score[i]) for i in at]), np.array([np.iinfo(np.int64).max if x is None else x for x in cols[4].take(pa.array(at)).to_pylist()], dtype=np.int64)]
        out.append(Block(*plain, v, *known))
    return out


def _found(q: Block, got: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    i, ids, score = got
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (q.rows[i], q.ids[i], ids, score)], names=["q_row", "query_id", "vec_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(table: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, first: int = FIRST) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id query_every divides."""
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("longest")).first()
    n, longest = size["n"], size["longest"] or 1
    parts = max(1, min(-(-n // candidate_block), 4 * spark.sparkContext.defaultParallelism), -(-n // (32 * candidate_block)))
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("v"))
    rows = written(rows.repartition(parts, "row"), "vectors")
    queries = rows.where(F.col("vec_id") % query_every == 0)
    share = F.pmod(F.xxhash64("row", F.lit(11)), F.lit(1 << 30))
    to = int((1 << 30) * min(1.0, min(first, FIRST_BYTES // (8 * max(1, longest))) / max(1, n)))

    # The first part, which is small, goes to where the queries are.
    start = rows.where(share < to).toArrow().combine_chunks()
    start = start.to_batches()[0] if start.num_rows else None

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _blocks(start, False) if start is not None else []
        for batch in batches:
            for at in range(0, batch.num_rows, query_block):
                for q in _blocks(batch.slice(at, query_block), False):
                    for c in known:
                        if c.v.shape[1] == q.v.shape[1]:
                            yield _found(q, search_block(q, c, k))

    best = written(_best(queries.mapInArrow(begin, _FOUND), k), "best")
    while to < 1 << 30:
        low, to = to, min(1 << 30, max(to, 1) * GROWTH)
        # A query's k-th best so far, if it has k.
        least = best.where(F.col("rank") == k).select(F.col("q_row").alias("row"), F.col("score").alias("least"), F.col("vec_id").alias("least_id"))
        folder = shared_path(spark, "queries")
        names = _write_queries(queries.join(least, "row", "left"), folder, query_block)

        def compare(batches: Iterator[pa.RecordBatch], folder: str = folder, names: list[str] = names) -> Iterator[pa.RecordBatch]:
            store = Store(folder)

            def against(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                mine = _blocks(block, False)
                for name in names:
                    for q in _blocks(pa.ipc.open_stream(store.read(name)).read_next_batch(), True):
                        for c in mine:
                            if c.v.shape[1] == q.v.shape[1]:
                                yield _found(q, search_block(q, c, k))

            held: list[pa.RecordBatch] = []
            for batch in batches:
                for at in range(0, batch.num_rows, candidate_block):
                    held.append(batch.slice(at, candidate_block))
                    if sum(b.num_rows for b in held) >= candidate_block:
                        yield from against(held)
                        held = []
            if held:
                yield from against(held)

        more = rows.where((share >= low) & (share < to)).mapInArrow(compare, _FOUND) if names else spark.createDataFrame([], _FOUND)
        best = written(_best(best.drop("rank").unionByName(more), k), "best")
        remove(spark, folder)
    return best.select("query_id", "rank", "vec_id", "score")


def _write_queries(queries: DataFrame, folder: str, block: int) -> list[str]:
    """Writes row, vec_id, v, least, least_id in blocks as files of the folder and returns their names."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, store = TaskContext.get().partitionId(), [], Store(folder)
        held: list[pa.RecordBatch] = []

        def put() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            names.append(f"{part:06d}-{len(names):06d}")
            store.put(names[-1], sink.getvalue())

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                held.append(batch.slice(at, block))
                if sum(b.num_rows for b in held) >= block:
                    put()
                    held = []
        if held:
            put()
        yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.string())], names=["name"])

    return sorted(r["name"] for r in queries.select("row", "vec_id", "v", "least", "least_id").mapInArrow(write, "name string").collect())
