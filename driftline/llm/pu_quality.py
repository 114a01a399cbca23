"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts that a label calls good; the unlabelled are texts of the whole corpus, whatever they are. No
negative label is used to fit. With class prior p (the share of good texts in the corpus), positive risk R_p(+1) and
R_p(-1) and unlabelled risk R_u(-1), the risk to minimise is p R_p(+1) + max(0, R_u(-1) - p R_p(-1)): the non-negative
form keeps a flexible model from driving the estimate of the negatives' risk below zero. The prior comes from the data: a
first classifier tells positives from unlabelled, and the prior is the smallest ratio, over score thresholds with enough
positives above, of the unlabelled share above to the positive share above, each with its sampling error.

A text's features are shares of its bytes by kind, lengths, and repetition of words and lines; the model is additive over
bins of each feature, logistic, and so the score is the estimated probability of a good text. Bin edges are quantiles of
all texts, from exact counts on a fixed grid of values (the upper half of a 32-bit float).

The fit. Of the labelled rows the fit takes about SAMPLE positives at most, chosen by a hash. The risk of the unlabelled and
its gradient are sums over all rows of the corpus, one distributed pass each. The risk is convex in the additive model, so
Newton steps reach its minimum in a few passes: the gradient is that of all rows, and only the curvature, which says how
far to go but not where the minimum is, comes from a sample of about SAMPLE rows, as does the point to start from. A step
that would lead beyond zero risk of the negatives, or raise the risk, is halved. The prior's shares are counted over the
half of all rows that its classifier has not seen.

The driver gets the samples (about 2 MB each), and from each pass a fixed number of sums, whatever the corpus and its
partitions: at most 2^16 counts a feature, or a gradient. Equal rows count as one row with a weight, so a row that is
repeated any number of times is sent once.

Odd rows: a null text is an empty one and gets a score; labels of ids without a text, null labels and nulls in any other
column don't matter; an id with several labels counts as positive if all of them are; without any positive label all
texts get the score 0.5; repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import fresh, measured_broadcast, written

#: About as many labelled positives, and rows to take the curvature from, as the fit takes at most.
SAMPLE = 20_000
BINS = 24
#: The most evaluations of the risk over all rows.
PASSES = 12
#: The descent ends when a step promises to lower the risk by less than this.
TOLERANCE = 1e-7
#: Weights are held back, and neighbouring bins pull together, by so much over the number of positives that the fit takes.
RIDGE, SMOOTH = 1.0, 10.0
FOLDS = 5

_KINDS: list[tuple[str, bytes]] = [
    ("upper", bytes(range(65, 91))),
    ("lower", bytes(range(97, 123))),
    ("digit", b"0123456789"),
    ("space", b" \t\r"),
    ("line", b"\n"),
    ("stop", b".,;:"),
    ("bang", b"!?"),
    ("quote", b"'\"()-"),
    ("bar", b"|_<>{}[]\\/="),
    ("sign", b"#$%&*@^~`+"),
    ("wide", bytes(range(128, 256))),
    ("control", bytes([*range(9), 11, 12, *range(14, 32), 127])),
]
NAMES = [*(k for k, _ in _KINDS), "log_chars", "log_words", "word_length", "repeated_words", "repeated_lines", "repeated_pairs", "line_length", "top_word", "long_words", "kinds_of_bytes"]


def features(text: str | None) -> np.ndarray:
    """One feature row; all of them are shares or bounded logarithms."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) if raw else np.zeros(256, dtype=np.int64)
    n = max(1, len(raw))
    shares = [counts[np.frombuffer(k, dtype=np.uint8)].sum() / n for _, k in _KINDS]
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    nw, nl = max(1, len(words)), max(1, len(lines))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = set(zip(words, words[1:]))  # noqa: B905
    return np.array(
        [
            *shares,
            np.log1p(len(raw)),
            np.log1p(len(words)),
            len(raw) / nw,
            1 - len(seen) / nw if words else 0.0,
            1 - len(set(lines)) / nl if lines else 0.0,
            1 - len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 0.0,
            np.log1p(len(raw) / nl),
            max(seen.values(), default=0) / nw,
            sum(c for w, c in seen.items() if len(w) > 16) / nw,
            (counts > 0).sum() / 256,
        ],
        dtype=np.float32,
    )


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and features (array of float) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(1)]
            flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.float32)
            offsets = np.arange(0, len(flat) + 1, len(NAMES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, features array<float>")


_sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
_softplus = lambda z: np.logaddexp(0, z)


def binned(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(rows, features): for each feature row the places of its bins among all weights."""
    own = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)], axis=1) if len(x) else np.zeros((0, len(edges)), dtype=np.int64)
    return own + np.arange(len(edges))[None, :] * BINS


@dataclass
class Model:
    """Additive over bins: edges (features, BINS - 1), weights of all bins and the bias last, the class prior."""

    edges: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(logits(self.weights, binned(self.edges, x)))


def logits(weights: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return weights[bins].sum(axis=1) + weights[-1]


def _sums(bins: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Weighted sum of the rows' indicator vectors, with the bias last."""
    out = np.bincount(bins.ravel(), weights=np.repeat(weight, bins.shape[1]), minlength=size) if len(bins) else np.zeros(size)
    out[-1] = weight.sum()
    return out


def _curvature(bins: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Weighted sum of the outer products of the rows' indicator vectors."""
    k = bins.shape[1]
    out = np.zeros((size, size))
    local = bins - np.arange(k)[None, :] * BINS
    for i in range(k):
        for j in range(i, k):
            both = np.bincount(local[:, i] * BINS + local[:, j], weights=weight, minlength=BINS * BINS).reshape(BINS, BINS)
            out[i * BINS : (i + 1) * BINS, j * BINS : (j + 1) * BINS] = both
            out[j * BINS : (j + 1) * BINS, i * BINS : (i + 1) * BINS] = both.T
    out[-1] = out[:, -1] = _sums(bins, weight, size)
    return out


def _penalty(features: int, positives: int) -> np.ndarray:
    """The quadratic form of RIDGE and SMOOTH."""
    path = 2 * np.eye(BINS) - np.eye(BINS, k=1) - np.eye(BINS, k=-1)
    path[0, 0] = path[-1, -1] = 1
    out = np.zeros((features * BINS + 1,) * 2)
    out[:-1, :-1] = RIDGE * np.eye(features * BINS) + SMOOTH * np.kron(np.eye(features), path)
    return out / max(1, positives)


@dataclass
class Rows:
    """Binned rows with weights that sum to one."""

    bins: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(edges: np.ndarray, x: np.ndarray, counts: np.ndarray) -> Rows:
        return Rows(binned(edges, x), counts / max(1, counts.sum()))

    def part(self, mask: np.ndarray) -> Rows:
        return Rows(self.bins[mask], self.weight[mask] / max(self.weight[mask].sum(), 1e-300))

    def negative(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss of the rows as negatives, and its gradient."""
        z = logits(w, self.bins)
        return float(self.weight @ _softplus(z)), _sums(self.bins, self.weight * _sigmoid(z), len(w))


def risk(w: np.ndarray, positive: Rows, prior: float, unlabelled: tuple[float, np.ndarray]) -> tuple[float, float, np.ndarray]:
    """Non-negative risk, the risk of the negatives within it, and the gradient where that isn't below zero.

    `unlabelled` is the mean loss of the unlabelled as negatives and its gradient.
    """
    z = logits(w, positive.bins)
    negatives = unlabelled[0] - prior * float(positive.weight @ _softplus(z))
    total = prior * float(positive.weight @ _softplus(-z)) + max(0.0, negatives)
    return total, negatives, unlabelled[1] - prior * _sums(positive.bins, positive.weight, len(w))


def _descend(start: np.ndarray, evaluate: Callable, curvature: Callable, penalty: np.ndarray, passes: int) -> np.ndarray:
    """Newton steps from `start`; evaluate(w) gives risk, risk of the negatives and gradient."""
    w = start
    value, _, grad = evaluate(w)
    value, grad = value + w @ penalty @ w / 2, grad + penalty @ w
    passes -= 1
    while passes > 0:
        step = -np.linalg.solve(curvature(w) + penalty + 1e-9 * np.eye(len(w)), grad)
        if -grad @ step < TOLERANCE:
            break
        size = 1.0
        while passes > 0:
            new = w + size * step
            passes -= 1
            got, negatives, new_grad = evaluate(new)
            got, new_grad = got + new @ penalty @ new / 2, new_grad + penalty @ new
            if got <= value and negatives >= 0:
                w, value, grad = new, got, new_grad
                break
            size /= 2
        else:
            break
        if size < 1e-3:
            break
    return w


def prior_of(p: np.ndarray, u: np.ndarray, n_p: float, n_u: float, delta: float = 0.1) -> float:
    """The share of positives in the unlabelled, from the shares of both above thresholds of a score.

    Above any threshold the unlabelled hold at least that share of what the positives hold; where only positives are
    above it, exactly that. The estimate is the ratio of unlabelled to positive shares above the threshold where its
    upper confidence bound is least, less its sampling error: a prior that is too high makes the risk of the negatives
    vanish before they are told apart, one that is a little low only makes good texts a little less sure.
    """
    err = np.sqrt(np.log(4 / delta) / (2 * n_p)) + np.sqrt(np.log(4 / delta) / (2 * n_u))
    ok = p > 0.05
    bound = np.where(ok, (u + err) / np.maximum(p, 1e-9), np.inf)
    best = int(np.argmin(bound))
    return float(np.clip((u[best] - err) / p[best], 0.02, 0.98))


def fit(edges: np.ndarray, positive: Rows, sample: Rows, halves: tuple[np.ndarray, np.ndarray], n_positive: int, above: Callable, unlabelled: Callable, passes: int = PASSES) -> Model:
    """The model of least non-negative risk.

    `sample` are unlabelled rows for curvature and start; `halves` marks the first half of positives and sample. above(w,
    cuts) counts the rows of the second half of the unlabelled: all, and those with a logit of at least each cut;
    unlabelled(w) is the mean loss of all unlabelled rows as negatives, and its gradient.
    """
    size = edges.shape[0] * BINS + 1
    penalty = _penalty(edges.shape[0], len(positive.bins))
    zero = np.zeros(size)
    # Positives against unlabelled on the first halves; the prior from scores on the second ones.
    first, others = positive.part(halves[0]), positive.part(~halves[0])
    apart = sample.part(halves[1])

    def tell(w: np.ndarray) -> tuple[float, float, np.ndarray]:
        z = logits(w, first.bins)
        loss, grad = apart.negative(w)
        return float(first.weight @ _softplus(-z)) + loss, 0.0, grad - _sums(first.bins, first.weight * _sigmoid(-z), size)

    def bend(*sets: Rows) -> Callable:
        return lambda w: sum(_curvature(r.bins, r.weight * (s := _sigmoid(logits(w, r.bins))) * (1 - s), size) for r in sets)

    prior = 0.5
    if len(others.bins) and len(apart.bins):
        telling = _descend(zero, tell, bend(first, apart), penalty, 30)
        z = logits(telling, others.bins)
        order = np.argsort(z)
        ranked = np.cumsum(others.weight[order])
        cuts = np.unique(z[order][np.minimum(np.searchsorted(ranked, np.linspace(0, 0.99, 100)), len(z) - 1)])
        total, counts = above(telling, cuts)
        if total:
            p = np.array([others.weight[z >= c].sum() for c in cuts])
            prior = prior_of(p, counts / total, n_positive / 2, total)
    near = _descend(zero, lambda w: risk(w, positive, prior, sample.negative(w)), bend(sample), penalty, 30)
    weights = _descend(near, lambda w: risk(w, positive, prior, unlabelled(w)), bend(sample), penalty, passes)
    return Model(edges, weights, prior)


# --- over all rows --------------------------------------------------------------------------------------------------


def _matrix(features: pa.Array) -> np.ndarray:
    return features.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def quantile_edges(table: DataFrame) -> np.ndarray:
    """Bin edges from exact counts of all rows on the grid of the upper 16 bits of each (never negative) value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(NAMES) << 16, dtype=np.int64)
        for batch in batches:
            x = np.ascontiguousarray(_matrix(batch.column(0)), dtype=np.float32)
            counts += np.bincount(((x.view(np.uint32) >> 16) + (np.arange(len(NAMES), dtype=np.uint32) << 16)[None, :]).ravel(), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["at", "n"])

    rows = table.select("features").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").toPandas()
    at, n = rows["at"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.float64)
    edges = np.zeros((len(NAMES), BINS - 1))
    for f in range(len(NAMES)):
        own = at >> 16 == f
        if own.any():
            values = ((at[own] & 0xFFFF).astype(np.uint32) << 16).view(np.float32)
            ranked = np.cumsum(n[own]) / n[own].sum()
            edges[f] = values[np.minimum(np.searchsorted(ranked, np.linspace(0, 1, BINS + 1)[1:-1]), len(values) - 1)]
    return edges


def _summed(table: DataFrame, size: int, add: Callable) -> np.ndarray:
    """Sums over all rows: add(features) gives what a batch adds; a task sends `size` numbers on, the driver gets as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 14):
                total += add(_matrix(batch.column(0).slice(start, 1 << 14)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "x"])

    out = np.zeros(size)
    for at, x in table.select("features").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x")).collect():
        out[at] = x
    return out


def _half(salt: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "features", F.lit(salt)), F.lit(2)) == 0


def _sample(rows: DataFrame, n: int, sample: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, counts and halves of about `sample` of n rows, chosen by a hash; equal rows come once, with their count."""
    part = F.pmod(F.xxhash64("doc_id", "features", F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, n)))
    got = rows.where(part).groupBy("doc_id", "features").agg(F.count("*").alias("n")).select("features", "n", _half(3).alias("half"), F.xxhash64("doc_id", "features").alias("at")).collect()
    got.sort(key=lambda r: (r["at"], r["features"]))
    return np.array([r["features"] for r in got], dtype=np.float32).reshape(-1, len(NAMES)), np.array([r["n"] for r in got], dtype=float), np.array([r["half"] for r in got], dtype=bool)


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(table: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """The model from a written feature table and labels outside the held-out fold; None without positives.

    Unlabelled rows are those of all sources and folds alike, without any label.
    """
    good = labels.where(~_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label_col).alias("label")).where("label = 1").select("doc_id")
    good = measured_broadcast(written(good, "good"))
    known = written(table.join(good, "doc_id"), "known")
    x, counts, half = _sample(known, known.count(), sample, 1)
    if not len(x):
        return None
    n = table.count()
    u, u_counts, u_half = _sample(table, n, sample, 2)
    edges = quantile_edges(table)
    size = len(NAMES) * BINS + 1

    def above(w: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray]:
        def add(rows: np.ndarray) -> np.ndarray:
            z = np.sort(logits(w, binned(edges, rows)))
            return np.concatenate([[len(z)], len(z) - np.searchsorted(z, cuts, side="left")]).astype(float)

        got = _summed(table.where(~_half(3)), 1 + len(cuts), add)
        return got[0], got[1:]

    def unlabelled(w: np.ndarray) -> tuple[float, np.ndarray]:
        def add(rows: np.ndarray) -> np.ndarray:
            bins = binned(edges, rows)
            z = logits(w, bins)
            return np.concatenate([[_softplus(z).sum()], _sums(bins, _sigmoid(z), size)])

        got = _summed(table, 1 + size, add) / n
        return float(got[0]), got[1:]

    return fit(edges, Rows.of(edges, x, counts), Rows.of(edges, u, u_counts), (half, u_half), int(counts.sum()), above, unlabelled)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`."""
    table = written(feature_table(docs, id_col, text_col), "features")
    model = train(table, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5) if model is None else model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, type=pa.float64())], names=["doc_id", "score"])

    out = table.select("doc_id", "features").mapInArrow(run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the classifier doesn't reject; of an id with several texts all stay if one does."""
    (name,) = fresh(docs, "kept_id")
    kept = scores(docs, labels, id_col, text_col).where("predicted = 1").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")
