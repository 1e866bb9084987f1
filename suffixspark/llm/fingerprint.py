"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (pieces between newlines). Each paragraph hashes to a wide vector and
a fingerprint is the sum of its paragraphs' vectors, lane by lane modulo a power of two: the order of
paragraphs doesn't matter, inserting a paragraph adds its vector, and deleting subtracts it.
Lanes: 4 of 64 bits from BLAKE2b of the paragraph (equality), then 128 of 24 bits in which each 5-word shingle of the
paragraph (each word, in a paragraph of fewer) adds 1 or -1 to the lane of its hash. The squared norm of the
difference of two such sums estimates how many shingles differ, hence a likeness.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import rolling
from .common import CHUNK, whole_text

EXACT_LANES, NEAR_LANES, NEAR_BITS, SHINGLE = 4, 128, 24, 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word (no byte of 9-13 or 32 in it) of the concatenated documents."""
    n = len(data)
    ink = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start, end = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1] | cut[1:n]
    end[:-1] &= ~ink[1:] | cut[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lane sums of each text: uint64 (n, 4) and int64 (n, 128), both modulo their powers of two."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    exact = np.zeros((n, EXACT_LANES), np.uint64)
    parts = [t.split(b"\n") for t in texts]
    digests = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=8 * EXACT_LANES).digest() for own in parts for p in own), "<u8").reshape(-1, EXACT_LANES)
    first = np.concatenate([[0], np.cumsum([len(own) for own in parts])[:-1]]).astype(np.int64)
    if n:
        exact = np.add.reduceat(digests, first, axis=0, dtype=np.uint64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    near = np.zeros((n, NEAR_LANES), np.int64)
    a, e = word_spans(data, offsets)
    if len(a):
        lines = np.cumsum(data == 10)
        doc = np.searchsorted(offsets, a, "right") - 1
        paragraph = lines[a] + doc
        new = np.flatnonzero(np.concatenate([[True], paragraph[1:] != paragraph[:-1]]))
        count = np.diff(np.append(new, len(a)))
        last = np.repeat(new + count, count)
        i = np.arange(len(a))
        short = np.repeat(count < SHINGLE, count)
        use = short | (i + SHINGLE <= last)
        i = i[use]
        to = np.where(short[use], i, np.minimum(i + SHINGLE - 1, len(a) - 1))
        h = rolling.span_hash(rolling.prefix(data), a[i], e[to])
        lane = (h >> np.uint64(57)).astype(np.int64)
        sign = 1.0 - 2.0 * (h & np.uint64(1)).astype(np.float64)
        near = np.bincount(doc[i] * NEAR_LANES + lane, sign, n * NEAR_LANES).astype(np.int64).reshape(n, NEAR_LANES) % (1 << NEAR_BITS)
    return exact, near


def combine(x: tuple, y: tuple, sign: int = 1) -> tuple:
    """Insert (sign 1) or delete (sign -1) the paragraphs of y: lane sums modulo their powers."""
    with np.errstate(over="ignore"):
        exact = x[0] + y[0] if sign > 0 else x[0] - y[0]
    return exact, (x[1] + sign * y[1]) % (1 << NEAR_BITS)


def encode(exact: np.ndarray, near: np.ndarray) -> list[str]:
    """Fingerprint strings: base64 of the lanes, little-endian."""
    low = near.astype("<u4").view(np.uint8).reshape(len(near), NEAR_LANES, 4)[:, :, : NEAR_BITS // 8].reshape(len(near), -1)
    raw = np.concatenate([exact.astype("<u8").view(np.uint8).reshape(len(near), -1), low], axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in raw]


def _signed(near: np.ndarray) -> np.ndarray:
    return ((near + (1 << (NEAR_BITS - 1))) % (1 << NEAR_BITS) - (1 << (NEAR_BITS - 1))).astype(np.float64)


def likeness(x: tuple, y: tuple) -> np.ndarray:
    """1 - |x - y|^2 / (|x|^2 + |y|^2) over the near lanes, within 0 to 1; 1 where the fingerprints are equal."""
    p, q = _signed(x[1]), _signed(y[1])
    d = _signed((x[1] - y[1]) % (1 << NEAR_BITS))
    total = (p * p + q * q).sum(axis=1)
    value = np.clip(1 - (d * d).sum(axis=1) / np.maximum(total, 1), 0, 1)
    value[total == 0] = 0
    value[(x[0] == y[0]).all(axis=1) & (x[1] == y[1]).all(axis=1)] = 1
    return value


def with_successor(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, body (string), lane (long), ghost (boolean): documents dealt into ranges of doc_id, sorted in them.

    Within a lane, a row's successor is the next row; the last has a ghost of the next lane's first document (of the
    first lane's, after the last) behind it. Ties of doc_id go by text; a null doc_id comes first.
    One shuffle of the text; bounds and firsts are a number per partition.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    rows = docs.select("doc_id", whole_text().alias("body"), key.alias("key"))
    bounds = sorted(set(rows.where("doc_id is not null").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    cuts = np.array(bounds, np.float64)

    @pandas_udf("long")
    def lane_of(x):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, x.to_numpy(np.int64).astype(np.float64), "right"))

    firsts = {r["lane"]: r["first"] for r in rows.select("key").groupBy(lane_of("key").alias("lane")).agg(F.min("key").alias("first")).collect()}
    order = sorted(firsts)
    before = {firsts[p]: order[i - 1] for i, p in enumerate(order)}
    heads = np.array(sorted(before), np.int64)
    to = np.array([before[h] for h in heads.tolist()], np.int64)

    @pandas_udf("array<long>")
    def codes(x):
        import pandas as pd

        k = x.to_numpy(np.int64)
        lane = np.searchsorted(cuts, k.astype(np.float64), "right")
        at = np.minimum(np.searchsorted(heads, k), len(heads) - 1)
        ghost = heads[at] == k
        return pd.Series([[2 * a, 2 * b + 1] if g else [2 * a] for a, b, g in zip(lane.tolist(), to[at].tolist(), ghost.tolist(), strict=True)])

    # For each lane a number that hashes to a partition of its own; else lanes would meet by chance.
    homes = {r["home"]: r["id"] for r in spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("home")).agg(F.min("id").alias("id")).collect()}
    home = F.array(*[F.lit(homes.get(lane, lane)).cast("long") for lane in range(n)])
    dealt = rows.select("doc_id", "key", "body", F.explode(codes("key")).alias("code")).withColumn("lane", F.shiftright("code", 1))
    return dealt.withColumn("home", F.get(home, F.col("lane").cast("int"))).repartition(n, "home").sortWithinPartitions("lane", "code", "key", "body").select("doc_id", "body", "lane", (F.col("code") % 2 == 1).alias("ghost"))


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        """Every row but the last, which is only a successor here."""
        own = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i + 1][2] == rows[i][2]]
        edited = []
        for i in own:
            text, after = rows[i][1], rows[i + 1][1]
            half = len(text) // 2
            edited.append((text[: len(text) - half] + after[:half]).encode())
        exact, near = vectors([r[1].encode() for r in rows])
        both = vectors(edited)
        at, nxt = np.array(own, np.int64), np.array(own, np.int64) + 1
        mine = (exact[at], near[at])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in own], pa.int64()),
                pa.array([len(rows[i][1]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
                pa.array(encode(*mine), pa.string()),
                pa.array(encode(*both), pa.string()),
                pa.array(likeness(mine, both), pa.float64()),
                pa.array(likeness(mine, (exact[nxt], near[nxt])), pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            held.append(row)
            size += len(row[1])
            if size >= CHUNK and len(held) > 1:
                yield solve(held)
                held = held[-1:]
                size = len(held[0][1])
    if len(held) > 1:
        yield solve(held)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text (second half replaced from the next document).

    Rows as ``op4`` asks: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null text is empty (one empty paragraph, whose fingerprint equals that of ""); a table of one
    document has itself as next; repeated rows follow each other by text; other columns are ignored; an empty table
    gives no rows.
    """
    return with_successor(docs).mapInArrow(_fingerprint_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
