"""Operators over all documents: near copies, lines, mixing, packing, neighbours, the pipeline and its queries."""

import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from suffixspark.llm import hnsw, line_dedup, minhash, mixing, packing, queries

from .test_texts import with_extras

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def brute_components(rows):
    sets, at = [], defaultdict(list)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
        common = defaultdict(int)
        for s in sets[i]:
            for j in at[s]:
                common[j] += 1
            at[s].append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def copies(seed, groups=25):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdef") for _ in range(4)) for _ in range(400)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A  b"), (5, "a b c"), (6, "x y z w v"), (6, "x y z w v")]
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([5, 8, 20, 60, 200]))]
        for _ in range(r.choice([1, 2, 3, 40])):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 20))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    rows = copies(seed)
    got = minhash.near_duplicates(with_extras(spark, rows).repartition(3))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()) == brute_components(rows)


def test_near_copies_without_ids_or_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = minhash.near_duplicates(spark.createDataFrame([(None, "a b"), (None, "c"), (3, "a b")], "doc_id long, text string")).collect()
    assert sorted((repr(r["doc_id"]), repr(r["component_id"]), r["kept"]) for r in rows) == [("3", "3", True), ("None", "3", False), ("None", "None", True)]


def test_blocks_of_a_cluster(monkeypatch):
    """Links between and within blocks of full sets; a link in a component, or below the share, isn't returned."""
    import pyarrow as pa

    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 2**63, 100).astype(np.uint64))
    sets = [base, base[:80], base[:40], np.unique(r.integers(0, 2**63, 90).astype(np.uint64))]
    m = minhash.minima(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    sig = minhash.signatures(m).view(np.int64).tolist()
    batch = pa.RecordBatch.from_pydict({"cluster": [1] * 4, "one": [0] * 4, "two": [0] * 4, "block": [0] * 4, "c": [1, 2, 3, 4], "comp": [1, 2, 3, 4], "sig": sig, "hashes": [s.tobytes() for s in sets]})
    assert [tuple(x.values()) for b in minhash._exact_rows(iter([batch])) for x in b.to_pylist()] == [(1, 2)]
    assert abs(minhash.estimate(minhash.signatures(m)[0], minhash.signatures(m)[1]) - 0.8) < 0.2


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["v"]: x["label"] for x in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges for v in e}


def brute_lines(rows):
    clean = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)
    holders, first = defaultdict(set), lambda d: -(2**63) if d is None else d
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[clean(line)].add(first(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(clean(x)) >= 10 and len(holders[clean(x)]) > 1 and min(holders[clean(x)]) != first(d))]
        out.append((repr(d), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 4])
def test_lines(spark, batches):
    rows = [(None, "abcdefghij\nx"), (1, " ABCDEFGHIJ\t\nq\nq"), (3, None), (4, ""), (5, "éééééééééé\nÉÉÉÉÉÉÉÉÉÉ"), (6, "éééééééééé\n\néééééééééé"), (6, "éééééééééé\n\néééééééééé"), (7, "abcdefghi"), (8, "abcdefghij")]
    r = random.Random(1)
    rows += [(10 + i, "\n".join(r.choice(["shared line one", "Shared Line One ", "other shared line", "short", "", f"own line of {i}"]) for _ in range(r.randint(1, 6)))) for i in range(30)]
    got = line_dedup.dedup_lines(with_extras(spark, rows), batches=batches).collect()
    assert sorted((repr(x["doc_id"]), x["n_lines"], x["n_dropped"], x["kept"]) for x in got) == brute_lines(rows)
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    keys = lambda rows: spark.createDataFrame(rows, "h1 long, h2 long, owner long")
    for i in range(5):
        new = runs.known(keys([(i, 0, i), (100, 0, i)])).where("known is null")
        runs.add(new.select("h1", "h2", "owner"))
        assert all(len(level) < 2 for level in runs.levels)
    every = [r for run in runs.runs() for r in run.collect()]
    assert sorted((r["h1"], r["owner"]) for r in every) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (100, 0)]


def test_runs_are_read_as_they_lie(spark):
    """The batch's keys are exchanged and sorted once, the runs not at all."""
    runs = line_dedup.LineRuns(spark, fanout=9)
    keys = lambda a, b: spark.range(a, b).select(F.col("id").alias("h1"), F.xxhash64("id").alias("h2"), F.col("id").alias("owner"))
    runs.add(keys(0, 500))
    runs.add(keys(500, 900))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with line_dedup._sorted_buckets(spark):
            found = runs.known(keys(300, 1200))
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert found.where("known is not null").count() == 600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1, plan


def test_lines_of_odd_tables(spark):
    rows = [(1, "a common line here\nx", "u", 7, "d"), (2, "A common line here \ny", "v", 8, "e"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, owner string, lines long, `a.b` string")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped", "kept"]
    got = {r["doc_id"]: tuple(r)[2:] for r in out.collect()}
    assert got == {1: ("u", 7, "d", 2, 0, "a common line here\nx"), 2: ("v", 8, "e", 2, 1, "y"), None: (None, None, None, 1, 0, "")}
    long = spark.createDataFrame([(1, "one long line of words\n" * 50_000), (2, "x" * 10**6 + "\none long line of words")], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(long).collect()} == {1: (50_001, 0), 2: (2, 1)}


def test_targets():
    assert targets([("a", 100), ("b", 100), ("c", 100)]) == pytest.approx({"a": 200, "b": 250 / 3 * 2, "c": 250 / 3})
    assert targets([]) == {} and targets([(None, 0)]) == {None: 0}
    got = targets([(None, 10), ("z", 10), ("A", 10), ("é", 10)])
    assert sum(got.values()) == pytest.approx(60) and got["A"] == 20 and max(got.values()) <= 20


@given(st.lists(st.tuples(st.integers(1, 1000), st.floats(0.01, 0.99)), max_size=40), st.integers(0, 5))
@settings(max_examples=300, deadline=None)
def test_pivots_keep_the_mass(pairs, seed):
    size, p = [s for s, _ in pairs], [q for _, q in pairs]
    out, carry = mixing.pivot(size, p, np.random.Generator(np.random.PCG64(seed)))
    assert all(q in (0, 1) for i, q in enumerate(out) if i != carry)
    assert sum(s * q for s, q in zip(size, out)) == pytest.approx(sum(s * q for s, q in pairs), abs=1e-3)


def test_pivots_are_fair():
    runs = np.array([mixing.pivot([5, 1, 3, 8], [0.3, 0.5, 0.8, 0.6], np.random.Generator(np.random.PCG64(s)))[0] for s in range(4000)])
    assert np.allclose(runs.mean(axis=0), [0.3, 0.5, 0.8, 0.6], atol=0.03)


@pytest.mark.parametrize("bucket_rows", [100_000, 7])
def test_mixing(spark, sf, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.copies(docs).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.copies(docs.repartition(5)).collect()))
    taken, goal = defaultdict(int), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert len(rows) == docs.count() and all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {r["source"]: r["w"] for r in mixed.groupBy("source").agg(F.sum(mixing.n_words()).alias("w")).collect()} == dict(taken)


def test_a_share_keeps_its_white_space(spark):
    text = " a  line\n\n\tof the\r\ntext \u00a0 é\n" * 50
    mixed = mixing.mix(spark.createDataFrame([(1, text, "s"), (2, "x y\nz", "t"), (3, "x\ny " * 99, "u")], "doc_id long, text string, source string")).collect()
    whole = {1: text, 2: "x y\nz", 3: "x\ny " * 99}
    cut = [r for r in mixed if r["text"] != whole[r["doc_id"]]]
    assert cut and all(whole[r["doc_id"]].startswith(r["text"]) for r in cut)


def test_mixing_odd_rows(spark):
    rows = [(1, None, None), (None, "a b c", "s"), (2, "a", "t"), (2, "a", "t"), (4, "", "u")]
    got = mixing.copies(with_extras(spark, rows, "doc_id long, text string, source string")).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 1, 1, 3] and all(r["taken"] <= 2 * r["size"] for r in got)
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.copies(none).count() == 0 == mixing.mix(none).count()


@given(st.lists(st.integers(1, 60), max_size=12), st.integers(1, 60))
@settings(max_examples=300, deadline=None)
def test_best_fill(lengths, room):
    from itertools import combinations

    lengths.sort(reverse=True)
    got = packing.best_fill([n for n in lengths if n <= room], room)
    best = max(sum(c) for k in range(min(len(lengths), 12) + 1) for c in combinations(lengths, k) if sum(c) <= room)
    assert sum(got) == best and not (set(got) - set(lengths))


def test_packing(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "日本 <|endoftext|>\u0085")], "doc_id long, text string"))
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: np.array(exact.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4") for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(docs.withColumn("bucket", F.lit(1)), bucket_docs=50).collect():
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in [*([(d, sorted(p), len(ids[d])) for d, p in pieces.items()]), *([(None, sorted(p), None) for p in sequences.values()])]:
        at = 0
        for start, n in own[1]:
            assert start == at
            at += n
        assert at == own[2] if own[2] else at <= 1024
    assert set(pieces) == set(ids)
    assert len(sequences) * 1024 < 1.1 * sum(map(len, ids.values())) + 4 * 1024
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def encoders():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()


@pytest.mark.parametrize("c", [" ", "\n", "\t", "\xa0", "a", "1", "-", "é", "日"])
def test_tokens_of_long_runs(c, encoders):
    exact, encode = encoders
    for text in (c * 10**6, c * 10**6 + "x", f"x{c * 5000} y{c * 5000}"):
        assert encode(text) == exact.encode(text, add_special_tokens=False).ids
    if c in " a":
        assert len(encode(c * 10**7)) > 10**6


@given(st.lists(st.sampled_from([" " * 5000, "\n" * 4096, "\t\xa0" * 3000, "word", " x", "9", "--", "日本", "<|endoftext|>", "'s", " \x1f", "\x85", " "]), max_size=8))
@settings(max_examples=60, deadline=None)
def test_tokens_of_mixed_runs(encoders, pieces):
    text = "".join(pieces)
    assert "".join(packing.parts(text, 20)) == text
    exact, encode = encoders
    want = exact.encode(text, add_special_tokens=False).ids
    assert encode(text) == want
    assert [i for p in packing.parts(text, 20) for i in exact.encode(p, add_special_tokens=False).ids] == want


def test_packing_of_repeated_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "HELD_PIECES", 64)
    rows = [(None, "a b c")] * 500 + [(7, "d " * 300)] * 500 + [(8, " " * 1_500_000 + "x")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sum(r["length"] for r in got if r["doc_id"] is None) == 500 * 4 and sum(r["length"] for r in got if r["doc_id"] == 8) == next(r["doc_tokens"] for r in got if r["doc_id"] == 8)
    assert sum(r["length"] for r in got if r["doc_id"] == 7) == sum(r["doc_tokens"] for r in got if r["doc_id"] == 7 and r["start"] == 0)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at <= 1024


def targets(sizes: list[tuple[str | None, int]], weights=mixing.WEIGHTS, share=mixing.SHARE, cap=mixing.CAP) -> dict[str | None, float]:
    """Target words of each source; (source, size) pairs in any order. The sources by code point, null last, weigh
    ``weights``, repeated; a target stops at ``cap`` times the size, its excess goes to the others by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    size = np.array([s for _, s in order], np.float64)
    w = np.resize(np.array(weights, np.float64), len(order))
    out, open_ = np.zeros(len(order)), size > 0
    while open_.any():
        share_each = w * (share * size.sum() - out[~open_].sum()) / w[open_].sum()
        over = open_ & (share_each >= cap * size)
        if not over.any():
            out[open_] = share_each[open_]
            break
        out[over] = cap * size[over]
        open_ &= ~over
    return {s: float(t) for (s, _), t in zip(order, out, strict=True)}


def _targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes if True], "source string, size long")
    return {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_rounds(spark, seed):
    r = random.Random(seed)
    sizes = [(f"s{i}" if i else None, r.choice([0, 1, 10, 1000, 10**6])) for i in range(r.choice([1, 3, 40]))]
    got, want = _targets(spark, sizes), targets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_mixing_of_many_sources_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NODE_SOURCES", 50)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 300)
    monkeypatch.setattr(mixing, "_COPIES", 16)
    rows = [(i, "w " * (1 + i % 7), f"s{i % 400}") for i in range(1200)] + [(5000, "one two three", "s1")] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.copies(docs.repartition(7)).collect()))
    sums, goal = defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sums[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert all(abs(sums[s] - goal[s]) <= 1 for s in goal)
    assert {s: round(t, 6) for s, t in goal.items()} == {s: round(t, 6) for s, t in targets([(s, sum(len(t.split()) for _, t, x in rows if x == s)) for s in goal]).items()}


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(i, f"a b c {i}", "s", i, "x", 1.5, True) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _d long, row string, taken double, `a.b` boolean")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert all(r["_d"] == r["doc_id"] and r["row"] == "x" and r["taken"] == 1.5 and r["a.b"] for r in out.collect())


def brute_nearest(rows, k=20):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            found = sorted((-float((np.array(v) * np.array(u)).sum()), i) for i, u in rows if i != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def test_neighbours(spark):
    embeddings = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in embeddings.collect()])
    got = defaultdict(dict)
    for r in hnsw.nearest(embeddings).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(want)
    recall = np.mean([len({v for v, _ in want[q]} & {v for v, _ in got[q].values()}) / 20 for q in want])
    assert recall >= 0.9
    exact = {(q, v): s for q, own in want.items() for v, s in own}
    assert all(abs(exact.get((q, v), s) - s) < 1e-9 for q, own in got.items() for v, s in own.values())


def test_small_world_recall_in_shards(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 16)) * r.uniform(0.2, 3, size=(3000, 1))
    x[500:900] = x[500]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    index = hnsw.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 800)[1]
    assert index.count() >= 4
    got = defaultdict(set)
    for q in hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got[q["query_id"]].add(q["vec_id"])
    want = brute_nearest([(i, np.float32(v).astype(float)) for i, v in rows])
    assert np.mean([len({v for v, _ in want[q]} & got[q]) / 20 for q in want]) >= 0.9


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (40, [2.0, 1.0, 3.0]), (1, [0.5, 0.5]), (6, [])]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit(1))).orderBy("query_id", "rank")
    assert [tuple(r) for r in got.collect()] == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]
    assert hnsw.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def _recall(spark, x, ids, **options):
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    got = defaultdict(set)
    for q in hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **options).collect():
        got[q["query_id"]].add(q["vec_id"])
        assert q["score"] == q["score"]
    with np.errstate(over="ignore"):
        want = brute_nearest([(i, np.longdouble(v)) for i, v in zip(ids, x, strict=True)])
    assert set(got) == set(want)
    return np.mean([len({v for v, _ in want[q]} & got[q]) / 20 for q in want])


def _spread(kind):
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 16))
    if kind == "norms":
        x *= np.exp(r.uniform(0, np.log(1e6), size=(1500, 1)))
    elif kind == "clusters":
        x = r.normal(size=(15, 16))[r.integers(0, 15, 1500)] + 0.05 * x
    elif kind != "sparse":
        x[7] *= float(kind)
    return x


@pytest.mark.parametrize("kind", ["norms", "clusters", "sparse", "1e4", "1e200"])
def test_recall_of_uneven_vectors(spark, kind):
    ids = [i * 10**9 // 20 * 20 + (i % 20 > 0) for i in range(1500)] if kind == "sparse" else list(range(1500))
    assert _recall(spark, _spread(kind), ids) >= 0.95


def test_small_vectors_and_norm_bands(spark):
    rows = [(0, [3e-320, 0.0]), (1, [1e-310, 1e-310]), (2, [1e300, 1e300]), (20, [0.0, 2.0])]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got if r["query_id"] == 20} == {(20, 1, 2), (20, 2, 1), (20, 3, 0)}
    bands = spark.createDataFrame([([3.0, 4.0],), ([1e200, 0.0],), ([1e-310],)], "v array<double>").select(hnsw.norm_band(F.col("v")).alias("b")).collect()
    assert [r["b"] for r in bands] == [2, 664, -1030]


def test_index_is_sent_once_a_group_of_blocks(spark, monkeypatch):
    """Copies of equal vectors beyond the default k, ties across shards, and several groups of blocks."""
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 4)
    monkeypatch.setattr(hnsw, "GROUP_BLOCKS", 2)
    rows = [(i, [1.0, 0.0]) for i in range(400)] + [(i, [0.5, float(i)]) for i in range(401, 420)]
    got = defaultdict(list)
    for r in hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=50, shard_rows=100).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == set(range(0, 400, 20))
    assert all(v == [i for i in range(51) if i != q][:50] for q, v in got.items())
    plan = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))._jdf.queryExecution().executedPlan().toString()
    # The index meets queries in one exchange by (shard, group): no join repeats it for each block.
    assert "layers" not in "".join(x for x in plan.splitlines() if "SortMergeJoin" in x)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    got = queries.queries()[name](spark, sf)
    cursor = duckdb.connect().execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'").execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cursor.fetchall())


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, docs, sf))
        assert out.columns == docs.columns and 0 < out.count()
        if name == "near_dedup":
            kept = [d for d, _, _, stays in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()]) if stays]
            assert sorted(r["doc_id"] for r in out.collect()) == kept
        if name == "line_dedup":
            assert all(r[2] == 0 for r in brute_lines([(r["doc_id"], r["text"]) for r in out.collect()]))
        docs = out
    assert corpus_pipeline.run(spark, sf).agg(F.sum("length")).first()[0] > 0


def test_pipeline_stages_take_odd_rows(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "some words of a text that is here", "en", None, 33), (2, "some words of a text that is here", "en", None, 33), (3, "x" * 5000, None, "t", 5000)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for given_rows in (rows, []):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, spark.createDataFrame(given_rows, kind), sf)
            assert out.count() <= max(1, 3 * len(given_rows)) or name == "packing"
