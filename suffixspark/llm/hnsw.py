"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard.

Vectors are dealt into shards by their norm's band (a factor of 2 wide) and, in a band, by hash of vec_id. In a shard
equal vectors are one node (with their smallest ids). An extra component makes all norms equal, so that the largest inner
product is the smallest distance; as norms in a shard are alike, that component never drowns the others, whatever
outliers the table has. Nodes are ordered by their random level, highest first, so each layer is a prefix of
them; a layer is stored as one flat array of neighbour numbers, ``DEGREE`` a node (twice that in layer 0), -1 for
none. Nodes join a layer in batches: a beam search of the graph so far, with the batch's own members added, proposes
neighbours, and of those a node keeps the ones nearer to it than to a neighbour it already has. Searches
run for a block of queries at once. Each shard's nearest are scored again in double precision on the original
vectors, and merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rolling
from .common import materialise

SHARD_ROWS, DEGREE, BUILD_BEAM, SEARCH_BEAM, BATCH, QUERY_BLOCK, GROUP_BLOCKS, K = 16_384, 24, 80, 320, 512, 512, 256, 20
#: From here on, products of components may overflow in double precision.
_LARGE = 1e150


def _beam(x: np.ndarray, links: np.ndarray, n: int, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of a layer's first n nodes for each row of q: (nodes, similarities), best first, -1 beyond the found."""
    b = len(q)
    rows = np.arange(b)
    ids = np.full((b, width), -1, np.int64)
    sims = np.full((b, width), -np.inf, np.float32)
    done = np.ones((b, width), bool)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    ids[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("ij,ij->i", x[entry], q), False
    seen[rows, entry] = True
    active = rows
    while len(active):
        # Each active query opens its best unopened node; without one within the beam it ends.
        at = np.where(done[active], -np.inf, sims[active]).argmax(axis=1)
        going = ~done[active, at]
        active, at = active[going], at[going]
        if not len(active):
            break
        done[active, at] = True
        near = links[ids[active, at]].astype(np.int64)
        near[(near < 0) | (near >= n)] = n
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        near[~fresh] = n
        some = fresh.any(axis=1)
        rows_now, near, fresh = active[some], near[some], fresh[some]
        if not len(rows_now):
            continue
        s = np.einsum("bmd,bd->bm", x[np.minimum(near, n - 1)], q[rows_now])
        s[~fresh] = -np.inf
        all_s = np.concatenate([sims[rows_now], s], axis=1)
        all_i = np.concatenate([ids[rows_now], near], axis=1)
        all_d = np.concatenate([done[rows_now], ~fresh], axis=1)
        best = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
        take = lambda a: np.take_along_axis(a, best, axis=1)
        sims[rows_now], ids[rows_now], done[rows_now] = take(all_s), take(all_i), take(all_d)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
    ids[~np.isfinite(sims)] = -1
    return ids, sims


def _choose(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of candidates (best first, -1 for none) up to ``degree``: those nearer to the node than to one chosen before,
    then the best of the others."""
    b, c = ids.shape
    v = x[np.maximum(ids, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((b, c), bool)
    blocked = np.full((b, c), -np.inf, np.float32)
    count = np.zeros(b, np.int64)
    for j in range(c):
        ok = (ids[:, j] >= 0) & (sims[:, j] > blocked[:, j]) & (count < degree)
        chosen[:, j] = ok
        count += ok
        blocked = np.where(ok[:, None], np.maximum(blocked, between[:, j]), blocked)
    rank = np.where(ids < 0, 3 * c, np.where(chosen, 0, c)) + np.arange(c)
    order = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(ids, order, axis=1)
    if out.shape[1] < degree:
        out = np.concatenate([out, np.full((b, degree - out.shape[1]), -1, out.dtype)], axis=1)
    return out.astype(np.int32)


def _top(ids: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
    return np.where(np.isfinite(sims), ids, -1), sims


def _layer(x: np.ndarray, n: int, degree: int, above: list[np.ndarray]) -> np.ndarray:
    """The neighbour array of the layer of the first n nodes; ``above`` has the layers above, the highest first."""
    links = np.full((n, degree), -1, np.int32)
    a = 0
    while a < n:
        e = min(n, a + BATCH)
        own = x[a:e] @ x[a:e].T
        np.fill_diagonal(own, -np.inf)
        ids, sims = np.broadcast_to(np.arange(a, e), own.shape), own
        if a:
            entry = _descend(x, above, x[a:e], a)
            found, s = _beam(x, links, a, x[a:e], entry, BUILD_BEAM)
            ids, sims = np.concatenate([found, ids], axis=1), np.concatenate([s, sims], axis=1)
        ids, sims = _top(ids, sims, BUILD_BEAM)
        links[a:e] = _choose(x, ids, sims, degree)
        # Links back: each target chooses again among its own neighbours and the newcomers, the nearest first.
        source = np.repeat(np.arange(a, e), degree)
        target = links[a:e].ravel().astype(np.int64)
        source, target = source[target >= 0], target[target >= 0]
        near = np.einsum("ij,ij->i", x[source], x[target])
        order = np.lexsort((-near, target))
        source, target, near = source[order], target[order], near[order]
        to, first, count = np.unique(target, return_index=True, return_counts=True)
        room = min(int(count.max()), 2 * degree) if len(to) else 0
        place = np.arange(len(target)) - np.repeat(first, count)
        keep = place < room
        new = np.full((len(to), room), -1, np.int64)
        new[np.repeat(np.arange(len(to)), count)[keep], place[keep]] = source[keep]
        for i in range(0, len(to), 1024):
            t = to[i : i + 1024]
            every = np.concatenate([links[t].astype(np.int64), new[i : i + 1024]], axis=1)
            every.sort(axis=1)
            every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
            s = np.einsum("bmd,bd->bm", x[np.maximum(every, 0)], x[t])
            s[every < 0] = -np.inf
            links[t] = _choose(x, *_top(every, s, degree + room), degree)
        a = e
    return links


def _descend(x: np.ndarray, above: list[np.ndarray], q: np.ndarray, limit: int) -> np.ndarray:
    """The nearest node found through the layers above, among the first ``limit`` nodes."""
    entry = np.zeros(len(q), np.int64)
    for links in above:
        n = min(len(links), limit)
        entry = _beam(x, links, n, q, np.minimum(entry, n - 1), 4)[0][:, 0]
    return entry


def build(x: np.ndarray, seed: int = 10) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the rows of x as nodes, and the layers' neighbour arrays, the highest first, for vectors of equal norm."""
    n = len(x)
    u = (rolling.splitmix64(n, seed) >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54
    level = np.floor(-np.log(u) / np.log(DEGREE)).astype(np.int64)
    order = np.argsort(-level, kind="stable")
    x = np.ascontiguousarray(x[order])
    layers: list[np.ndarray] = []
    for k in range(int(level.max(initial=0)), -1, -1):
        layers.append(_layer(x, int((level >= k).sum()), DEGREE if k else 2 * DEGREE, layers))
    return order, layers


def same_norm(x: np.ndarray) -> np.ndarray:
    """float32 vectors with one more component that makes all norms equal; scaled to norm 1."""
    x = x / max(np.abs(x).max(initial=0), np.finfo(np.float64).tiny)
    norm = np.sqrt((x**2).sum(axis=1))
    top = max(norm.max(initial=0), np.finfo(np.float64).tiny)
    return np.concatenate([x / top, np.sqrt(np.maximum(0, 1 - (norm / top) ** 2))[:, None]], axis=1).astype(np.float32)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of x with q in double precision; those beyond its range are infinite."""
    if max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) < _LARGE:
        return (x * q).sum(axis=1)
    with np.errstate(over="ignore"):
        return (x.astype(np.longdouble) * q).sum(axis=1).astype(np.float64)


def _index_rows(k: int):
    """Rows sorted by shard: a row per shard with its vectors, members of equal vectors and flat neighbour arrays."""

    def solve(shard: int, ids: list[int], vectors: list[np.ndarray]) -> pa.RecordBatch:
        x = np.stack(vectors)
        ids_ = np.array(ids, np.int64)
        order = np.argsort(ids_, kind="stable")
        ids_, x = ids_[order], np.ascontiguousarray(x[order]) + 0.0  # -0 becomes 0
        _, first, node = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        turn = np.argsort(first)  # nodes by their smallest id
        back = np.empty_like(turn)
        back[turn] = np.arange(len(turn))
        node, x = back[node.ravel()], x[first[turn]]
        by, layers = build(same_norm(x))
        place = np.empty_like(by)
        place[by] = np.arange(len(by))
        node, x = place[node], np.ascontiguousarray(x[by])
        # Of equal vectors only the k + 1 smallest ids can be among k nearest.
        member = np.argsort(node, kind="stable")
        count = np.bincount(node, minlength=len(x))
        turn_in = np.arange(len(member)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        member = member[turn_in <= k]
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([ids_[member].tobytes()], pa.binary()), pa.array([node[member].astype(np.int64).tobytes()], pa.binary()), pa.array([[a.tobytes() for a in layers]], pa.list_(pa.binary()))],
            ["shard", "dim", "vectors", "ids", "nodes", "layers"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vectors = None, [], []
        for batch in batches:
            values = batch.column("vector")
            for s, i, v in zip(batch.column("shard").to_pylist(), batch.column("vec_id").to_pylist(), values, strict=True):
                if s != shard and ids:
                    yield solve(shard, ids, vectors)
                    ids, vectors = [], []
                shard = s
                ids.append(i)
                vectors.append(v.values.to_numpy(zero_copy_only=False))
        if ids:
            yield solve(shard, ids, vectors)

    return run


def search(y: np.ndarray, layers: list[np.ndarray], q: np.ndarray, width: int) -> np.ndarray:
    """Nodes found for each row of q, -1 beyond the found; y are the nodes' vectors as ``same_norm`` makes them."""
    n = len(y)
    if n <= width:
        return np.broadcast_to(np.arange(n), (len(q), n))
    q = q / np.abs(q).max(axis=1, keepdims=True)
    p = np.concatenate([q / np.sqrt((q**2).sum(axis=1))[:, None], np.zeros((len(q), 1))], axis=1).astype(np.float32)
    return _beam(y, layers[-1], n, p, _descend(y, layers[:-1], p, n), width)[0]


def _search_rows(k: int, width: int):
    """Rows sorted by (shard, group, role): a shard's index, then blocks of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                if row["role"].as_py() == 0:
                    x = np.frombuffer(row["vectors"].as_buffer(), np.float64).reshape(-1, row["dim"].as_py())
                    layers = [np.frombuffer(a.as_buffer(), np.int32) for a in row["layers"]]
                    sizes = [len(a) // (DEGREE if i < len(layers) - 1 else 2 * DEGREE) for i, a in enumerate(layers)]
                    layers = [a.reshape(m, -1) for a, m in zip(layers, sizes, strict=True)]
                    ids, nodes = np.frombuffer(row["ids"].as_buffer(), np.int64), np.frombuffer(row["nodes"].as_buffer(), np.int64)
                    bound, y = np.searchsorted(nodes, np.arange(len(x) + 1)), same_norm(x)
                    continue
                query_ids = np.frombuffer(row["ids"].as_buffer(), np.int64)
                q = np.frombuffer(row["vectors"].as_buffer(), np.float64).reshape(len(query_ids), -1)
                found = search(y, layers, q, width)
                out_q, out_v, out_s = [], [], []
                for i, query in enumerate(query_ids.tolist()):
                    at = found[i][found[i] >= 0]
                    s = products(x[at], q[i])
                    # k + 1 nodes hold k candidates at least, the query's own left out.
                    best = np.lexsort((ids[bound[at]], -s))
                    cut = min(len(best), k + 1)
                    while cut < len(best) and s[best[cut]] == s[best[cut - 1]]:
                        cut += 1
                    pairs = sorted((-float(s[b]), v) for b in best[:cut].tolist() for v in ids[bound[at[b]] : bound[at[b] + 1]].tolist() if v != query)[:k]
                    out_q += [query] * len(pairs)
                    out_v += [v for _, v in pairs]
                    out_s += [-t + 0.0 for t, _ in pairs]
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (dim, block): a row per block with its query ids and vectors, concatenated."""

    def joined(key: tuple[int, int], ids: list[int], vectors: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(vectors).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["dim", "block", "ids", "vectors"])

    key, ids, vectors = None, [], []
    for batch in batches:
        for dim, block, i, v in zip(batch.column("dim").to_pylist(), batch.column("block").to_pylist(), batch.column("vec_id").to_pylist(), batch.column("vector"), strict=True):
            if (dim, block) != key and ids:
                yield joined(key, ids, vectors)
                ids, vectors = [], []
            key = (dim, block)
            ids.append(i)
            vectors.append(v.values.to_numpy(zero_copy_only=False))
    if ids:
        yield joined(key, ids, vectors)


def norm_band(v):
    """The binary logarithm of a vector's norm, to the nearest whole number; the components are scaled, so nothing overflows."""
    top = F.array_max(F.transform(v, F.abs))
    squares = F.aggregate(v, F.lit(0.0), lambda total, c: total + (c / top) * (c / top))
    return F.round(F.log2(top) + F.log2(squares) / 2).cast("int")


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, vector (array of double) of the rows that take part, one a vec_id (of several, the smallest vector)."""
    v = F.col("vector")
    rows = embeddings.select("vec_id", F.col(vector).cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0")
    fit = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return rows.where(fit).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def build_index(embeddings: DataFrame, shard_rows: int = SHARD_ROWS, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(vectors, index): the rows that take part with their dim, and a row per shard. Every such row is indexed.

    Vectors of one length are compared with each other only; shards are made for each length and band of norms. Searches
    for up to ``k`` neighbours are served.
    """
    rows = materialise(usable(embeddings).withColumn("dim", F.size("vector")).withColumn("band", norm_band(F.col("vector"))))
    per = rows.groupBy("dim", "band").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("shards"))
    # A shard's number holds its dim, its band (of 11 bits and a sign) and its hash bucket.
    number = F.col("dim").cast("long") * (1 << 36) + (F.col("band") + 2048).cast("long") * (1 << 24) + F.pmod(F.xxhash64("vec_id"), F.col("shards"))
    dealt = rows.join(per, ["dim", "band"]).select(number.alias("shard"), "vec_id", "vector").repartition("shard").sortWithinPartitions("shard")
    index = materialise(dealt.mapInArrow(_index_rows(k), "shard long, dim int, vectors binary, ids binary, nodes binary, layers array<binary>"))
    return rows, index


def nearest(embeddings: DataFrame, every: int = 20, k: int = K, width: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, the rows whose vec_id is divisible by ``every``.

    Nearness is the largest inner product in double precision, ties go to the smaller vec_id, and a query's own
    row is no candidate. Of the true k nearest about 99 % are found (measured; see the README); what is returned has its exact
    score. Vectors null, empty, zero, or with null or non-finite components take no part, nor does a null vec_id; rows of one
    vec_id count once; fewer candidates give fewer rows; an empty table gives none. A product beyond the range of a
    double is infinite. Queries go to the shards in blocks; a shard's index is sent once for each GROUP_BLOCKS blocks.
    """
    rows, index = build_index(embeddings, shard_rows, k)
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    per = queries.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("long").alias("blocks"))
    dealt = queries.join(per, "dim").select("dim", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("blocks")).alias("block"), "vec_id", "vector")
    blocks = materialise(dealt.repartition("dim", "block").sortWithinPartitions("dim", "block").mapInArrow(_block_rows, "dim int, block long, ids binary, vectors binary"))
    shards = index.select("shard", "dim")
    none = F.lit(None).cast("array<binary>")
    # A query has to meet each shard of its dim: that's the stated query set against all rows, in blocks.
    asked = blocks.join(shards, "dim").select("shard", (F.col("block") / GROUP_BLOCKS).cast("long").alias("group"), F.lit(1).alias("role"), "dim", "vectors", "ids", F.lit(None).cast("binary").alias("nodes"), none.alias("layers"))
    groups = per.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("blocks") - 1) / GROUP_BLOCKS).cast("long"))).alias("group"))
    sent = index.join(groups, "dim").select("shard", "group", F.lit(0).alias("role"), "dim", "vectors", "ids", "nodes", "layers")
    met = sent.unionByName(asked).repartition("shard", "group").sortWithinPartitions("shard", "group", "role")
    found = met.mapInArrow(_search_rows(k, width), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
