"""Near duplicates by b-bit MinHash, exact in the end.

Each document's set of word shingles gives HASHES minima. Groups of ROWS minima make band keys; documents with a
common key are candidates. The low BITS of each minimum are packed into a signature; equal bits, corrected for
chance collisions, estimate the similarity of candidates, and those over ESTIMATE are compared on their full sets.

Equal sets are one class from the start, and only classes go on. A band's classes are first compared with its leader, the
class that meets most others over all its bands (the original, in a group of edited copies), so a group of m near
copies costs m comparisons, not m * m / 2. Links so far give components. What is left are pairs of a band in
different components. Blocks of signatures are estimated against each other; classes that look alike, directly or
through others, make clusters, a row for each class; and each cluster's blocks of full sets are compared, which
gives a row only for a link that joins two components. So no pair within reach of the bands goes
unseen unless it is already in one component, where a link adds nothing, and no list of pairs is ever made.
A pair at similarity 0.75 shares no band with odds 5e-6, and is estimated below ESTIMATE with odds under 1e-9.
Class ids are 64-bit hashes of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import as_int64, buffers, chunks, materialise, whole_text
from .fingerprint import word_spans

SHINGLE, HASHES, ROWS, BITS, ESTIMATE = 5, 128, 4, 4, 0.5
BANDS = HASHES // ROWS
LINK_PART, LINK_WHOLE = 75, 100
GROUP, BLOCK = 1024, 1024

_U = np.uint64
_MIX = rolling.splitmix64(64, 55) | _U(1)
_A = (rolling.splitmix64(HASHES, 101) >> _U(32)).astype(np.uint32) | np.uint32(1)
_B = (rolling.splitmix64(HASHES, 202) >> _U(32)).astype(np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of concatenated documents, repeats included, and their offsets by document.

    A-Z count as a-z. A document of fewer than SHINGLE words has one shingle, all of it; one without words has none.
    """
    n = len(offsets) - 1
    data = _LOWER[data]
    a, e = word_spans(data, offsets)
    words = rolling.span_hash(rolling.prefix(data), a, e)
    bound = np.searchsorted(a, offsets)
    count = np.diff(bound)
    with np.errstate(over="ignore"):
        long = max(0, len(words) - SHINGLE + 1)
        total = np.zeros(len(words), _U)
        for k in range(SHINGLE):
            total[:long] += words[k : k + long] * _MIX[k]
        last = np.repeat(bound[1:], count)
        use = np.arange(len(words)) + SHINGLE <= last
        for d in np.flatnonzero((count > 0) & (count < SHINGLE)):
            i, c = bound[d], count[d]
            total[i] = (words[i : i + c] * _MIX[:c]).sum(dtype=_U) + _MIX[SHINGLE + c]
            use[i] = True
    out = rolling.mix(total[use])
    per = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    return out, np.concatenate([[0], np.cumsum(per)])


def minima(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(documents, HASHES) minima; every document must have a shingle."""
    x = (hashes >> _U(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, HASHES), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], bounds[:-1])
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        wide = m.astype(_U).reshape(len(m), BANDS, ROWS)
        return rolling.mix((wide * _MIX[16 : 16 + ROWS]).sum(axis=2, dtype=_U) + np.arange(BANDS, dtype=_U) * _MIX[32])


def signatures(m: np.ndarray) -> np.ndarray:
    """(documents, BITS * HASHES / 64) words: bit planes of the low bits of minima."""
    planes = [np.packbits((m >> np.uint32(b)) & np.uint32(1), axis=1).view(_U) for b in range(BITS)]
    return np.concatenate(planes, axis=1)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of signatures (last axis), corrected for minima that are equal in their low bits by chance."""
    per = HASHES // 64
    differ = x[..., :per] ^ y[..., :per]
    for b in range(1, BITS):
        differ |= x[..., b * per : (b + 1) * per] ^ y[..., b * per : (b + 1) * per]
    equal = 1 - np.bitwise_count(differ).sum(axis=-1) / HASHES
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def _lists(x: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(x).reshape(-1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, x.shape[1]), pa.int32()), pa.array(flat))


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = buffers(batch.column("body"))
        for i, j in chunks(offsets):
            h, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            some = np.flatnonzero(np.diff(bounds))
            size, c1, c2 = np.zeros(j - i, np.int64), np.zeros(j - i, _U), np.zeros(j - i, _U)
            with np.errstate(over="ignore"):
                for d in some:
                    own = np.sort(h[bounds[d] : bounds[d + 1]])
                    if len(own) > 1:
                        own = own[np.concatenate([[True], own[1:] != own[:-1]])]
                    size[d] = len(own)
                    c1[d], c2[d] = own.sum(dtype=_U), (own * (own | _U(1))).sum(dtype=_U)
            bands, sig = np.zeros((j - i, BANDS), _U), np.zeros((j - i, BITS * HASHES // 64), _U)
            if len(some):
                m = minima(h, np.append(bounds[some], bounds[-1]))
                bands[some], sig[some] = band_keys(m), signatures(m)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), batch.column("body_hash").slice(i, j - i), as_int64(size), as_int64(rolling.mix(c1 ^ rolling.mix(c2 + size.astype(_U)))), _lists(bands), _lists(sig)],
                ["doc_id", "body_hash", "n_shingles", "c", "bands", "sig"],
            )


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = buffers(batch.column("body"))
        for i, j in chunks(offsets):
            h, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sets = [np.unique(h[a:b]).tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("c").slice(i, j - i), batch.column("wants").slice(i, j - i), pa.array(sets, pa.binary())], ["c", "wants", "hashes"])


def _compare_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (leader, salt, role): the leader's own set, then those to compare with it."""
    key, own = None, np.zeros(0, _U)
    for batch in batches:
        left, right = [], []
        for leader, salt, role, c, raw in zip(*(batch.column(k).to_pylist() for k in ("leader", "salt", "role", "c", "hashes")), strict=True):
            x = np.frombuffer(raw, _U)
            if role == 0:
                key, own = (leader, salt), x
            elif key == (leader, salt):
                small, large = (x, own) if len(x) <= len(own) else (own, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                if LINK_WHOLE * common >= LINK_PART * (len(x) + len(own) - common):
                    left.append(c), right.append(leader)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _merge(label: np.ndarray, at: np.ndarray) -> None:
    """Give all that share a label with one of ``at`` one label."""
    found = np.unique(label[at])
    if len(found) > 1:
        label[np.isin(label, found)] = found[0]


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], rest: tuple[str, ...]) -> Iterator[tuple[tuple, list[list]]]:
    """Key and columns of each run of rows with equal keys."""
    now, held = None, [[] for _ in rest]
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
        cols = [batch.column(k).to_pylist() for k in rest]
        i = 0
        while i < len(keys):
            j = i
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            if keys[i] != now and held[0]:
                yield now, held
                held = [[] for _ in rest]
            now = keys[i]
            for h, c in zip(held, cols, strict=True):
                h += c[i:j]
            i = j
    if held[0]:
        yield now, held


def _alike(i: int, right: np.ndarray, same: bool, c: np.ndarray, comp: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Of the rows ``right``, those of other components whose signatures look like that of row i; each pair once."""
    others = right[c[right] > c[i]] if same else right
    others = others[comp[others] != comp[i]]
    return others[estimate(sig[others], sig[i]) >= ESTIMATE] if len(others) else others


def _cluster_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (band, block pair): (a, b) edges that connect what looks alike, at most a row each."""
    for (_, one, two), (block, c, comp, sig) in _groups(batches, ("band", "one", "two"), ("block", "c", "comp", "sig")):
        block, c, comp = np.array(block), np.array(c), np.array(comp)
        if (comp == comp[0]).all():
            continue
        sig, label = np.array(sig, np.int64).view(_U), np.arange(len(c))
        right = np.flatnonzero(block == two)
        for i in np.flatnonzero(block == one):
            others = _alike(i, right, one == two, c, comp, sig)
            if len(others):
                _merge(label, np.append(others, i))
        joined = np.flatnonzero(np.bincount(label, minlength=len(c))[label] > 1)
        if len(joined):
            yield pa.RecordBatch.from_arrays([pa.array(c[joined]), pa.array(c[label[joined]])], ["a", "b"])


def _exact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cluster, block pair): the links between the two blocks that join components."""
    for (_, one, two), (block, c, comp, sig, raw) in _groups(batches, ("cluster", "one", "two"), ("block", "c", "comp", "sig", "hashes")):
        block, c, sig = np.array(block), np.array(c), np.array(sig, np.int64).view(_U)
        comp = np.unique(np.array(comp), return_inverse=True)[1]
        sets = [np.frombuffer(r, _U) for r in raw]
        size = np.array([len(x) for x in sets])
        right, left, to = np.flatnonzero(block == two), [], []
        for i in np.flatnonzero(block == one):
            others = _alike(i, right, one == two, c, comp, sig)
            for a in range(0, len(others), 256):
                part = others[a : a + 256]
                every = np.concatenate([sets[k] for k in part])
                at = np.minimum(np.searchsorted(sets[i], every), size[i] - 1)
                common = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(size[part])[:-1]]))
                for k in part[LINK_WHOLE * common >= LINK_PART * (size[part] + size[i] - common)]:
                    if comp[k] != comp[i]:
                        left.append(c[i]), to.append(c[k])
                        _merge(comp, np.array([i, k]))
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(to, pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for each vertex of the edges (a, b): the smallest vertex id of its component.

    First each vertex keeps its smallest neighbour only, and its other smaller neighbours are tied to that one instead:
    many edges to few hubs become one each. Then each round takes the smallest label among neighbours and the
    label's own label, so chains shorten by half. Edges and labels are written, so lineage stays short.
    """
    down = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    least = materialise(down.groupBy("a").agg(F.min("b").alias("low")))
    tied = down.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    own = least.select("a", F.col("low").alias("b")).unionByName(tied)
    both = materialise(own.union(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.v).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = materialise(step.join(jump, "label", "left").select("v", "was", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = new.select("v", "label")
        if new.where("was <> label").isEmpty():
            return labels


def _close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of the pairs (c, leader), those whose signatures look alike; in the JVM."""
    sig = sketches.select("c", "sig")
    two = pairs.join(sig, "c").join(sig.select(F.col("c").alias("leader"), F.col("sig").alias("sig2")), "leader")
    per = HASHES // 64
    equal = F.lit(HASHES)
    for k in range(per):
        differ = F.col("sig")[k].bitwiseXOR(F.col("sig2")[k])
        for b in range(1, BITS):
            differ = differ.bitwiseOR(F.col("sig")[b * per + k].bitwiseXOR(F.col("sig2")[b * per + k]))
        equal = equal - F.bit_count(differ)
    least = HASHES * (ESTIMATE * (1 - 2.0**-BITS) + 2.0**-BITS)
    return two.where(equal >= least).select("c", "leader")


def _sets(wants: DataFrame, classes: DataFrame, bodies: DataFrame) -> DataFrame:
    """wants (c, wants: an array of structs) with the sorted shingle hashes of each class, from one of its documents."""
    kind = wants.schema["wants"].dataType.simpleString()
    wants = wants.join(classes.select("c", F.col("at.doc_id").alias("d"), F.col("at.body_hash").alias("h")), "c")
    own = bodies.join(wants, bodies.doc_id.eqNullSafe(wants.d) & (bodies.body_hash == wants.h)).select("c", "wants", "body")
    return own.mapInArrow(_set_rows, f"c long, wants {kind}, hashes binary")


def _by_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Deal rows (key, c, m: rows of the key) into blocks, and each block to its pairs with all blocks of the key, sorted."""
    n = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("c"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("other", "m")
    return rows.repartition(key, "one", "two").sortWithinPartitions(key, "one", "two", "c")


def _linked(pairs: DataFrame, classes: DataFrame, bodies: DataFrame) -> DataFrame:
    """Of the pairs (c, leader), those linked on their full sets, as (a, b). Large groups of a leader are salted."""
    pairs = materialise(pairs.distinct())
    salts = materialise(pairs.groupBy("leader").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts")))
    members = pairs.join(salts, "leader").select("c", F.struct("leader", F.pmod(F.hash("c"), F.col("salts")).alias("salt"), F.lit(1).alias("role")).alias("want"))
    leaders = salts.select(F.col("leader").alias("c"), F.explode(F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.struct(F.col("leader").alias("leader"), s.alias("salt"), F.lit(0).alias("role")))).alias("want"))
    sets = _sets(members.unionByName(leaders).groupBy("c").agg(F.collect_list("want").alias("wants")), classes, bodies)
    rows = sets.select("c", "hashes", F.explode("wants").alias("w")).select("c", "hashes", "w.*")
    dealt = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role")
    return materialise(dealt.select("leader", "salt", "role", "c", "hashes").mapInArrow(_compare_rows, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, body_hash, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Linked are documents with 100 * common >= 75 * all of their distinct shingles. component_id is the smallest doc_id
    that links reach; kept marks it. Null, empty and wordless texts have no shingles and are linked with nothing.
    Repeated rows are exact copies; a null doc_id is larger than all others, and its own component when
    alone. Other columns are ignored; an empty table gives no rows.
    """
    bodies = docs.select("doc_id", F.xxhash64(whole_text()).alias("body_hash"), whole_text().cast("binary").alias("body"))
    sketches = materialise(bodies.mapInArrow(_sketch_rows, "doc_id long, body_hash long, n_shingles long, c long, bands array<long>, sig array<long>"))
    rows = sketches.where("n_shingles > 0")
    classes = materialise(rows.groupBy("c").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("o"), "doc_id", "body_hash")).alias("at"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    bands = classes.select("c", F.explode("bands").alias("band"))
    # Written, as are leads and open_ and the salts: a join splits a hot band only where both sides are exchanges of their own.
    often = materialise(bands.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"))
    met = materialise(bands.join(often, "band"))
    weight = met.groupBy("c").agg(F.sum("m").alias("w"))
    leads = materialise(met.join(weight, "c").groupBy("band").agg(F.max(F.struct("w", "c")).alias("lead")).select("band", F.col("lead.c").alias("leader")))
    star = met.join(leads, "band").where("c <> leader").select("c", "leader")
    edges = _linked(_close(star.distinct(), classes), classes, bodies)
    labels = components(edges)
    placed = met.where("m > 2").join(labels.withColumnRenamed("v", "c"), "c", "left").select("c", "band", "m", F.coalesce("label", "c").alias("comp"))
    # Both members of a band of two have met.
    open_ = placed.groupBy("band").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).where("p <> q").select("band")
    open_ = materialise(open_)
    left = placed.join(open_, "band", "left_semi").join(classes.select("c", "sig"), "c")
    alike = materialise(_by_blocks(left, "band").select("band", "one", "two", "block", "c", "comp", "sig").mapInArrow(_cluster_rows, "a long, b long").where("a <> b").distinct())
    if not alike.isEmpty():
        clusters = components(alike).select(F.col("v").alias("c"), F.col("label").alias("cluster"))
        clusters = clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("m")), "cluster")
        clusters = clusters.join(labels.withColumnRenamed("v", "c"), "c", "left").join(classes.select("c", "sig"), "c")
        own = _sets(clusters.select("c", F.array(F.struct("cluster", "m", F.coalesce("label", "c").alias("comp"), "sig")).alias("wants")), classes, bodies)
        dealt = _by_blocks(own.select("c", "hashes", F.explode("wants").alias("w")).select("c", "hashes", "w.*"), "cluster")
        more = materialise(dealt.select("cluster", "one", "two", "block", "c", "comp", "sig", "hashes").mapInArrow(_exact_rows, "a long, b long"))
        if not more.isEmpty():
            edges = edges.unionByName(more)
            labels = components(edges)
    label = classes.select("c", F.col("at.doc_id").alias("first")).join(labels.withColumnRenamed("v", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    smallest = label.groupBy("label").agg(F.min("first").alias("component_id"))
    of = label.join(smallest, "label").select("c", "component_id")
    out = sketches.select("doc_id", "body_hash", "n_shingles", "c").join(of, "c", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "body_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
