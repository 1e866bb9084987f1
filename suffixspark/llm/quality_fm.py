"""Quality scores by a factorisation machine.

Features of a text: shares of hashed words (2**14 buckets), statistics of its structure, and its length. The score is
the logistic function of w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, where the pairs cost linear time by
1/2 * sum over factors of ((sum v x)^2 - sum v^2 x^2).
Fitting runs on the driver over a bounded sample of labelled rows (``TRAIN_DOCS``, the lowest by a hash of doc_id);
everything else is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import buffers, chunks, whole_text
from .fingerprint import word_spans

BUCKETS, FACTORS, TRAIN_DOCS, THRESHOLD, SEED = 1 << 14, 8, 8_000, 0.7, 6
EPOCHS, BATCH, RATE, DECAY = 14, 128, 0.02, 2e-4
STATISTICS = ("upper", "digit", "symbol", "stop_end", "space", "odd_bytes", "word_length", "distinct", "top_word", "repeated_lines", "line_length", "short_words", "symbol_words", "upper_words", "length", "words")
_N = len(STATISTICS)


def _kind(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_UPPER, _DIGIT = _kind((65, 90)), _kind((48, 57))
_SYMBOL = _kind((33, 47), (58, 64), (91, 96), (123, 126))
_END = _kind((46, 46), (44, 44), (33, 33), (63, 63))
_SYMBOL_ONLY = _SYMBOL & ~_END


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated documents: statistics (n, 16), and document, bucket and share of each hashed word."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    some = np.maximum(size, 1)
    a, e = word_spans(data, offsets)
    doc = np.searchsorted(offsets, a, "right") - 1
    words = np.bincount(doc, minlength=n).astype(np.float64)
    some_words = np.maximum(words, 1)
    p = rolling.prefix(data)
    h = rolling.span_hash(p, a, e)
    bucket = (h >> np.uint64(50)).astype(np.int64)
    pair, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    of, bucket = pair // BUCKETS, pair % BUCKETS
    share = count / some_words[of]
    top = np.zeros(n)
    np.maximum.at(top, of, share)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL_ONLY[data])])
    uppers = np.concatenate([[0], np.cumsum(_UPPER[data])])
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    line_doc = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, line_doc))
    starts, line_doc = starts[order], line_doc[order]
    ends = np.append(starts[1:] - 1, offsets[-1])
    last = np.append(line_doc[1:] != line_doc[:-1], True)
    ends[last] = offsets[1:]
    lines = np.bincount(line_doc, minlength=n).astype(np.float64)
    lh = rolling.span_hash(p, starts, ends)
    order = np.lexsort((lh, line_doc))
    again = (lh[order][1:] == lh[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    repeated = np.bincount(line_doc[order][1:][again], minlength=n)
    by_word = lambda mask: np.bincount(doc, mask, n) / some_words
    out = np.stack(
        [
            _sums(_UPPER[data], offsets) / some, _sums(_DIGIT[data], offsets) / some, _sums(_SYMBOL[data], offsets) / some,
            by_word(_END[data[e - 1]]) if len(a) else words, 1 - np.bincount(doc, e - a, n) / some, _sums(data >= 128, offsets) / some,
            by_word(e - a), np.bincount(of, minlength=n) / some_words, top, repeated / lines,
            np.log1p(size / lines), by_word(e - a <= 2), by_word(symbols[e] - symbols[a] >= 1), by_word(uppers[e] - uppers[a] >= 2),
            np.log1p(size), np.log1p(words),
        ],
        axis=1,
    )
    return out, of, bucket, share


@dataclass
class Machine:
    """Weights of BUCKETS word buckets, then the statistics; mean and deviation standardise the statistics."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def inputs(self, stats: np.ndarray, of: np.ndarray, bucket: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, feature and value of every input that isn't 0; shares count by their root."""
        z = np.clip((stats - self.mean) / self.deviation, -4, 4) / 2
        n = len(stats)
        return np.concatenate([of, np.repeat(np.arange(n), _N)]), np.concatenate([bucket, np.tile(np.arange(BUCKETS, BUCKETS + _N), n)]), np.concatenate([np.sqrt(share), z.ravel()])

    def score(self, stats: np.ndarray, of: np.ndarray, bucket: np.ndarray, share: np.ndarray) -> np.ndarray:
        d, f, x = self.inputs(stats, of, bucket, share)
        return logistic(forward(self.bias, self.w, self.v, d, f, x, len(stats))[0])


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def forward(bias: float, w: np.ndarray, v: np.ndarray, d: np.ndarray, f: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores, and the sum of v x by factor and document."""
    z = bias + np.bincount(d, w[f] * x, n)
    s = np.empty((v.shape[1], n))
    for k in range(v.shape[1]):
        vx = v[f, k] * x
        s[k] = np.bincount(d, vx, n)
        z = z + 0.5 * (s[k] ** 2 - np.bincount(d, vx * vx, n))
    return z, s


def fit(stats: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Machine:
    """Fit on documents' statistics, (buckets, shares) and labels by Adam on the logistic loss, in batches."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    size = BUCKETS + _N
    model = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), stats.mean(axis=0) if len(y) else np.zeros(_N), stats.std(axis=0) + 1e-3 if len(y) else np.ones(_N))
    if not len(y):
        return model
    rate_of = float(np.clip(y.mean(), 0.01, 0.99))
    model.bias = float(np.log(rate_of / (1 - rate_of)))
    params = np.concatenate([model.w[:, None], model.v], axis=1)
    m, q, step = np.zeros_like(params), np.zeros_like(params), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            at = order[i : i + BATCH]
            of = np.repeat(np.arange(len(at)), [len(rows[k][0]) for k in at])
            d, f, x = model.inputs(stats[at], of, np.concatenate([rows[k][0] for k in at]).astype(np.int64), np.concatenate([rows[k][1] for k in at]).astype(np.float64))
            z, s = forward(model.bias, params[:, 0], params[:, 1:], d, f, x, len(at))
            g = (logistic(z) - y[at]) / len(at)
            model.bias -= RATE * float(g.sum())
            gx = g[d] * x
            grad = DECAY * params
            grad[:, 0] += np.bincount(f, gx, size)
            for k in range(FACTORS):
                grad[:, k + 1] += np.bincount(f, gx * (s[k][d] - params[f, k + 1] * x), size)
            step += 1
            m += 0.1 * (grad - m)
            q += 0.01 * (grad * grad - q)
            params -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-6)
    model.w, model.v = np.ascontiguousarray(params[:, 0]), np.ascontiguousarray(params[:, 1:])
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = buffers(batch.column("body"))
        for i, j in chunks(offsets):
            stats, of, bucket, share = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            cut = np.searchsorted(of, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("place").slice(i, j - i), batch.column("y").slice(i, j - i), pa.array([r.tobytes() for r in stats], pa.binary()), pa.array([bucket[a:b].astype(np.uint16).tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([share[a:b].astype(np.float32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
                ["place", "y", "stats", "buckets", "shares"],
            )


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Machine:
    """Fit on the documents of ``labels`` (doc_id, quality) that aren't held out; at most ``train_docs`` of them.

    Rows with a null label or doc_id are ignored; several labels of one document are averaged.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    chosen = chosen.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(train_docs)
    # train_docs rows of three numbers at most: bounded, whatever the corpus; of several texts of a doc_id the least counts.
    sample = docs.select("doc_id", whole_text().cast("binary").alias("body")).join(F.broadcast(chosen), "doc_id").groupBy("place", "doc_id", "y").agg(F.min("body").alias("body")).drop("doc_id")
    rows = sorted(sample.mapInArrow(_feature_rows, "place long, y double, stats binary, buckets binary, shares binary").collect(), key=lambda r: (r["place"], bytes(r["stats"]), bytes(r["shares"])))
    stats = np.array([np.frombuffer(r["stats"], np.float64) for r in rows]).reshape(len(rows), _N)
    return fit(stats, [(np.frombuffer(r["buckets"], np.uint16), np.frombuffer(r["shares"], np.float32)) for r in rows], np.array([r["y"] for r in rows], np.float64))


def held_out(doc_id: str):
    """crc32 of doc_id as text modulo 4 is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text, others) with held_out, score and predicted; columns of those names are replaced.

    Null and empty texts are scored by their statistics (all 0); repeated rows score alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and FACTORS
    own = docs.drop("held_out", "score", "predicted")
    names = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(pc.fill_null(batch.column("text"), ""))
            scores = [shared.value.score(*features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in chunks(offsets)]
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(s, pa.float64())], [*names, "score"])

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*own.schema.fields]).add("score", DoubleType())
    out = own.mapInArrow(run, schema)
    return out.withColumn("held_out", held_out("doc_id")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
