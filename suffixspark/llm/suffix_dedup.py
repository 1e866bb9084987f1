"""Exact removal of long repeated byte strings by difference-cover suffix sorting.

1. *Anchors* deal the text into buckets. A window of ``length`` bytes is anchored at its leftmost smallest k-byte hash
   (k = 0.32 of it), so equal windows have equal anchors at equal offsets. Consecutive windows with one anchor make
   a span. Only spans whose anchor hash occurs more than once can hold a repeated window: the rest of the
   text, which is unique, drops out here, and nothing that repeats can.
2. *Names*. Spans equal as a whole (same anchor hash, same 128-bit hash) are one name with a count; its text is fetched
   once, whatever the count.
3. *Difference cover*. All names of an anchor hash are in one bucket, a name that counts more than once with its text
   twice. Each bucket's text is suffix-sorted by ``difference_cover``: sampled triples, recursion on names, merge,
   and comparison of adjacent prefixes. That finds the repeated windows of a name, and all spans of the name have them.
   An anchor with over ``hot_group`` different spans would be an unbounded bucket: its spans are cut into
   single windows, which are named, counted, bucketed and sorted in the same way; each needs to meet its equals only.

Joins by anchor or name look each key's row count up first: keys with over 1/HEAVY of the rows, fewer than HEAVY
of them, are dealt out by salt, so no passage, however common, lands in one task.

All shuffled rows but the bucketed names are a few integers wide; the text itself is dealt out once by document
(both joins reuse that exchange).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import CHUNK, as_int64, buffers, chunks, materialise, whole_text, with_keys
from .difference_cover import repeated_windows

LENGTH = 200
#: A span's name: hash of its anchor, two hashes of all of it.
NAME = ("h", "g", "g2")
_KINDS = "h long, g long, g2 long"
HOT_GROUP = 2048
#: Bits of an anchor's key that hold its place in the chunk.
_PLACE = 21


def _spans(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of a chunk of documents: document, start in it, number of windows, and name of each span."""
    k = max(1, length * 8 // 25)
    width = length - k + 1
    p = rolling.prefix(data)
    grams = rolling.gram_hash(p, k)
    place = np.uint64((1 << _PLACE) - 1)
    least, size = (grams & ~place) | np.arange(len(grams), dtype=np.uint64), 1
    while size * 2 <= width and len(least) > size:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if (more := width - size) and len(least) > more:
        least = np.minimum(least[:-more], least[more:])
    first = offsets[:-1]
    per = np.maximum(offsets[1:] - first - length + 1, 0)
    total = int(per.sum())
    doc = np.repeat(np.arange(len(per)), per)
    start = np.repeat(first - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(total)
    anchor = (least[start] & place).astype(np.int64) if total else start
    change = np.ones(total, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    a = np.flatnonzero(change)
    n = np.diff(np.append(a, total))
    from_, to = start[a], start[a] + n + length - 1
    return doc[a], from_ - first[doc[a]], n, grams[anchor[a]], rolling.span_hash(p, from_, to), rolling.span_hash(rolling.prefix(data, 1), from_, to, 1)


def _span_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = (1 << _PLACE) - 1
        for batch in batches:
            offsets, data = buffers(batch.column("body"))
            for i, j in chunks(offsets, min(CHUNK, limit)):
                a, b = int(offsets[i]), int(offsets[j])
                step = limit - length
                # A document beyond the limit is cut; the cuts overlap by length - 1 bytes, so each window is in one.
                for c in range(a, max(a + 1, b - length + 1), step) if b - a > limit else [a]:
                    end = min(b, c + limit - 1) if b - a > limit else b
                    own = np.array([c, end], np.int64) - c if b - a > limit else offsets[i : j + 1] - a
                    doc, start, n, *name = _spans(data[c:end], own, length)
                    doc, start = doc + i, start + (c - a)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(doc)), batch.column("body_hash").take(pa.array(doc)), as_int64(start), pa.array(n, pa.int32()), *map(as_int64, name)],
                        ["doc_id", "body_hash", "start", "n", *NAME],
                    )

    return run


def _bucket_rows(length: int, flush: int = 1 << 17):
    """Rows sorted by name; whole groups of an anchor are sorted together until a batch of ``flush`` bytes is full.

    A row for each name with repeated windows: its runs of them, as pairs of offset and number, one after the other."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[-1] for r in rows]
        # A name that counts more than once has its text there twice.
        hits = repeated_windows(texts + [r[-1] for r in rows if r[3] > 1], length)
        names, runs = [], []
        for row, hit in zip(rows, hits, strict=False):
            if hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                edge[1::2] -= edge[::2]
                names.append(row[:4])
                runs.append(edge.tolist())
        cols = list(zip(*names, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols), pa.array(runs, pa.list_(pa.int32()))], [*NAME, "c", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*NAME, "c", "body")), strict=True):
                if held and held[-1][:3] == row[:3]:
                    continue  # fetched from each of several equal rows
                if size >= flush and held[-1][0] != row[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1]) * (2 if row[3] > 1 else 1)
        if held:
            yield solve(held)

    return run


def _cut_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests = [], [], [], []
            for body, runs in zip(batch.column("body").to_pylist(), batch.column("runs"), strict=True):
                n = len(body)
                sizes.append(n)
                if not runs.is_valid or not len(runs):
                    removed.append(0), spans.append(0), digests.append(hashlib.sha256(body).hexdigest())
                    continue
                a = runs.values.field("start").to_numpy(zero_copy_only=False)
                e = a + runs.values.field("n").to_numpy(zero_copy_only=False) + length - 1
                order = np.argsort(a, kind="stable")
                a, e = a[order], np.maximum.accumulate(e[order])
                new = np.ones(len(a), bool)
                new[1:] = a[1:] > e[:-1]
                lo, hi = a[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]
                digest, at = hashlib.sha256(), 0
                for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                    digest.update(body[at:x])
                    at = y
                digest.update(body[at:])
                removed.append(int((hi - lo).sum())), spans.append(len(lo)), digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def repeated_runs(docs: DataFrame, length: int = LENGTH, hot_group: int = HOT_GROUP) -> DataFrame:
    """Runs of repeated windows: doc_id, body_hash, start (byte), n (windows; n + length - 1 bytes are covered).

    ``docs`` has doc_id and text of any documents. Null texts are empty; texts shorter than ``length`` have no
    windows. Repeated rows of one doc_id and text are copies of each other. Runs may overlap.
    """
    return _runs(_bodies(docs), length, hot_group)


def _bodies(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(whole_text()).alias("body_hash"), whole_text().cast("binary").alias("body"))


def _sorted_runs(names: DataFrame, length: int) -> DataFrame:
    """(name, c, runs) of names (name, c, body) with repeated windows, by difference cover in the buckets of h."""
    dealt = names.select(*NAME, "c", "body").repartition("h").sortWithinPartitions(*NAME)
    return dealt.mapInArrow(_bucket_rows(length), f"{_KINDS}, c long, runs array<int>")


def _hot_runs(names: DataFrame, length: int) -> DataFrame:
    """The same for names of hot anchors: each window of them is a name of its own."""
    window = lambda o: F.substring(F.col("body"), o + 1, F.lit(length))
    each = F.transform(F.sequence(F.lit(0), F.length("body") - length), lambda o: F.struct(o.alias("o"), F.xxhash64(window(o)).alias("w1"), F.xxhash64(F.lit(1), window(o)).alias("w2")))
    windows = names.select(*NAME, "c", F.explode(each).alias("w")).select(*NAME, "c", "w.*")
    often = windows.groupBy("w1", "w2").agg(F.sum("c").alias("k"), F.min(F.struct(*NAME, "o")).alias("at")).where("k > 1")
    often = materialise(often)
    wanted = often.groupBy(*(F.col(f"at.{x}") for x in NAME)).agg(F.collect_list(F.struct(F.col("at.o").alias("o"), "w1", "w2", "k")).alias("ws"))
    own = names.select(*NAME, "body").join(wanted, [*NAME])
    texts = own.select(F.explode(F.transform("ws", lambda x: F.struct(x.w1.alias("h"), x.w2.alias("g"), F.lit(0).cast("long").alias("g2"), x.k.alias("c"), window(x.o).alias("body")))).alias("x")).select("x.*")
    found = materialise(_sorted_runs(texts, length).select(F.col("h").alias("w1"), F.col("g").alias("w2"), F.col("c").alias("k")))
    hits = with_keys(windows, found, ("w1", "w2"), "k", (*NAME, "o"))
    return hits.groupBy(*NAME).agg(F.max("c").alias("c"), F.flatten(F.collect_set(F.array("o", F.lit(1)))).alias("runs"))


def _runs(bodies: DataFrame, length: int, hot_group: int) -> DataFrame:
    spans = bodies.mapInArrow(_span_rows(length), f"doc_id long, body_hash long, start long, n int, {_KINDS}")
    twice = materialise(spans.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"))
    spans = materialise(with_keys(spans, twice, ("h",), "k").select("doc_id", "body_hash", "start", "n", *NAME))
    named = materialise(spans.groupBy(*NAME).agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "body_hash", "start", "n")).alias("at")))
    groups = materialise(named.groupBy("h").agg(F.count("*").alias("m")))
    wanted = with_keys(named.select(*NAME, "c", "at"), groups, ("h",), "m", ("g",)).select(F.col("at.doc_id").alias("d"), F.col("at.body_hash").alias("b"), F.struct(*NAME, "c", "at.start", "at.n", (F.col("m") > hot_group).alias("hot")).alias("span"))
    wanted = wanted.groupBy("d", "b").agg(F.collect_list("span").alias("spans"))
    cut = bodies.join(wanted, bodies.doc_id.eqNullSafe(wanted.d) & bodies.body_hash.eqNullSafe(wanted.b))
    fields = lambda s: [s[x].alias(x) for x in (*NAME, "c", "hot")]
    cut = materialise(cut.select(F.explode(F.transform("spans", lambda s: F.struct(*fields(s), F.substring(F.col("body"), s.start.cast("int") + 1, s.n + (length - 1)).alias("body")))).alias("s")).select("s.*"))
    found = _sorted_runs(cut.where("not hot"), length)
    if not groups.where(F.col("m") > hot_group).isEmpty():
        found = found.unionByName(_hot_runs(cut.where("hot"), length))
    found = materialise(found)
    pairs = F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda i: F.struct((F.col("start") + F.get("runs", i)).alias("start"), F.get("runs", i + 1).alias("n")))
    return with_keys(spans.drop("n"), found, NAME, "c").select("doc_id", "body_hash", F.explode(pairs).alias("run")).select("doc_id", "body_hash", "run.*")


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot_group: int = HOT_GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs`` (doc_id, text).

    Removed is each byte covered by a ``length``-byte string that starts anywhere else too, in any document or the
    same one, judged on the input. Null and empty texts give 0, 0, 0 and the digest of nothing; an
    empty table gives no rows; other columns of ``docs`` are ignored; repeated rows each get a row, and count as
    copies of each other.
    """
    bodies = _bodies(docs)
    # Equal rows of one doc_id answer for each other, so each of their runs is kept once.
    runs = _runs(bodies, length, hot_group).groupBy(F.col("doc_id").alias("d"), F.col("body_hash").alias("b")).agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    both = bodies.join(runs, bodies.doc_id.eqNullSafe(runs.d) & bodies.body_hash.eqNullSafe(runs.b), "left").select("doc_id", "body", "runs")
    return both.mapInArrow(_cut_rows(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
