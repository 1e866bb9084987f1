import random

import pytest

from suffixspark.config import Config, parse_config
from suffixspark.functions import stats, strings
from suffixspark.operators import alphabet, check, distribute, ranks
from suffixspark.sources import sinks, text
from pyspark.sql import functions as F


def numbers(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i long, v long")


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (100, 20), (2000, 10**6)])
def test_ranks(spark, n, top):
    r = random.Random(n)
    values = [r.randint(1, top) for _ in range(n)]
    got, names = ranks.dense_rank(numbers(spark, values), "v")
    distinct = sorted(set(values))
    assert names == len(distinct)
    assert sorted((x["i"], x["rank"], x["uniq"]) for x in got.collect()) == [(i, distinct.index(v) + 1, values.count(v) == 1) for i, v in enumerate(values)]
    indexed = sorted((x["idx"], x["v"]) for x in ranks.row_index(numbers(spark, values), ["v", "i"]).collect())
    assert [i for i, _ in indexed] == list(range(n)) and [v for _, v in indexed] == sorted(values)
    sums = {x["i"]: x["s"] for x in ranks.prefix_sum(numbers(spark, values), "i", "v", "s").collect()}
    assert sums == {i: sum(values[:i]) for i in range(n)}


@pytest.mark.parametrize("buckets", [1, 3])
def test_ranked_rows_with_keys_over_many_partitions(spark, buckets):
    r = random.Random(buckets)
    values = [r.choice([None, "", "a", "a", "a", "a", "b", "ba", "zz"]) for _ in range(3000)]
    df = spark.createDataFrame([(i, v, r.randint(0, 9)) for i, v in enumerate(values)], "i long, v string, x int")
    rows = df.collect()
    done = ranks.ranked(df, ["v"], ["i"], ["i"], add="x", partitions=16, buckets=buckets)
    order = sorted(rows, key=lambda t: (t["v"] is not None, t["v"] or "", t["i"]))
    names = sorted({t["v"] for t in rows}, key=lambda v: (v is not None, v or ""))
    got = {t["i"]: t for t in done.rows.collect()}
    assert (done.n, done.names, done.total) == (3000, len(names), sum(t["x"] for t in rows))
    before, first = 0, {}
    for k, t in enumerate(order):
        g = got[t["i"]]
        first.setdefault(t["v"], k)
        assert (g["idx"], g["first"], g["rank"], g["before"], g["uniq"]) == (k, first[t["v"]], names.index(t["v"]) + 1, before, values.count(t["v"]) == 1)
        before += t["x"]


def test_ranked_unique_and_struct_keys(spark):
    df = spark.createDataFrame([(i, i // 2 if i < 20 else i, float(i % 3)) for i in range(400)], "i long, v long, d double")
    done = ranks.ranked(df.withColumn("k", F.struct("v", "d")), ["k"], ["i"], partitions=13)
    assert done.names == len({(r["v"], r["d"]) for r in df.collect()})
    flags = {r["i"]: r["uniq"] for r in ranks.ranked(df, ["v"], ["i"], partitions=13).rows.collect()}
    assert flags == {i: i >= 20 for i in range(400)}
    assert ranks.ranked(df.where("i < 0"), ["v"], ["i"]).n == 0


def test_neighbours(spark):
    df = numbers(spark, [5, 6, 7])
    assert sorted((x["i"], x["a"]) for x in ranks.neighbour(df, "i", "v", 1, "a").collect()) == [(0, 6), (1, 7), (2, None)]
    assert sorted((x["i"], x["a"]) for x in ranks.neighbour(df, "i", "v", -2, "a").collect() if x["i"] == 2) == [(2, 5)]


def test_distribution(spark):
    n, parts = 103, 4
    df = spark.range(n).withColumnRenamed("id", "i")
    sizes = [r["count"] for r in distribute.even(df, "i", parts).groupBy("target").count().orderBy("target").collect()]
    assert sizes == [25, 25, 25, 28]
    assert [r["count"] for r in distribute.even(spark.range(2).toDF("i"), "i", 4).groupBy("target").count().orderBy("target").collect()] == [1, 1]
    want = [10, 0, 90, 3]
    got = {r["target"]: r["count"] for r in distribute.custom(df, "i", want).groupBy("target").count().collect()}
    assert got == {0: 10, 2: 90, 3: 3}
    rows = distribute.bucket_major(df.withColumn("b", F.col("i") % 3), "b", "i", parts)
    found = sorted((r["idx"], r["b"], r["i"], r["target"]) for r in rows.collect())
    assert [(b, i) for _, b, i, _ in found] == sorted((i % 3, i) for i in range(n))
    assert [t for *_, t in found] == [0] * 26 + [1] * 26 + [2] * 26 + [3] * 25
    assert distribute.bucket_parts([100, 10, 1], 6) == [2, 2, 2] and distribute.bucket_parts([5, 90, 7], 8) == [2, 3, 3]
    with pytest.raises(ValueError):
        distribute.bucket_parts([1, 1], 1)
    assert distribute.needs_rebalance(0.2, 0.25) and not distribute.needs_rebalance(0.3, 0.25)


def test_rebalancing(spark):
    rows = spark.range(90).select(F.col("id").alias("i"), F.when(F.col("id") < 80, 0).when(F.col("id") < 85, 1).otherwise(2).alias("part"))
    moved, yes = distribute.rebalance(rows, "i", 3, 0.25)
    assert yes and [r["count"] for r in moved.groupBy("target").count().orderBy("target").collect()] == [30, 30, 30]
    stays, no = distribute.rebalance(rows, "i", 3, 0.1)
    assert not no and stays.where("part <> target").isEmpty()
    assert not distribute.rebalance_small(rows, "i", 3)[1] and distribute.rebalance_small(rows, "i", 5)[1]
    both = [distribute.by_buckets(rows, "part", "i", 4, b).groupBy("target").count().orderBy("target").collect() for b in (True, False)]
    assert [[r["count"] for r in x] for x in both] == [[23, 23, 22, 22], [40, 40, 5, 5]]


def test_records_and_searches(spark):
    df = spark.createDataFrame([(i % 7, str(i)) for i in range(200)], "a int, b string")
    cuts = distribute.record_splitters(df, ["a", "b"], 4, 100)
    assert cuts == distribute.record_splitters(df, ["a", "b"], 4, 100) == sorted(cuts) and len(cuts) == 3
    got = df.select("a", "b", distribute.bucket_of_record(["a", "b"], cuts).alias("n")).collect()
    assert all(r["n"] == sum(c <= (r["a"], r["b"]) for c in cuts) for r in got)
    values = [1, 3, 3, 7, 9]
    found = spark.range(12).select("id", strings.first_at_least(values, F.col("id")).alias("x"), strings.bisected(values, F.col("id")).alias("y")).collect()
    assert all(r["x"] == r["y"] == sum(v < r["id"] for v in values) for r in found)
    pair = spark.createDataFrame([("abcdef", "abcxef", 2), ("ab", "ab", 1), ("ab", "abc", 2)], "a string, b string, k int")
    assert [tuple(r["c"]) for r in pair.select(strings.compare_from(F.col("a"), F.col("b"), F.col("k")).alias("c")).collect()] == [(-1, 3), (0, 2), (-1, 2)]


def test_common_prefixes_beyond_old_limits(spark):
    df = spark.createDataFrame([(0,)], "i int").select(F.expr("repeat('a', 600)").alias("a"), F.expr("repeat('a', 40000000)").alias("b"))
    row = df.select(strings.lcp_scan(F.col("a"), F.concat("a", F.lit("b"))).alias("x"), strings.lcp(F.col("b"), F.concat("b", F.lit("b"))).alias("y")).first()
    assert tuple(row) == (600, 40_000_000)


def test_chunks_and_splitters(spark):
    chunks = distribute.chunk_targets(distribute.chunk_rows(2500, 1000, spark), 3, 1)
    assert sorted((r["start"], r["size"]) for r in chunks.collect()) == [(0, 1000), (1000, 1000), (2000, 500)]
    assert sum(r["n"] for r in distribute.send_counts(chunks).collect()) == 2500
    df = numbers(spark, list(range(100)))
    cuts = distribute.uniform_splitters(df, "v", 4)
    assert cuts == [25, 50, 75]
    assert {r["bucket"]: r["size"] for r in distribute.interval_sizes(df, "v", cuts).collect()} == {0: 25, 1: 25, 2: 25, 3: 25}
    assert distribute.random_splitters(df, "v", 4, 50, 3) == distribute.random_splitters(df, "v", 4, 50, 3)


def test_strings(spark):
    pairs = [("abc", "abd"), ("abc", "abc"), ("", "x"), ("abc", "ab"), (None, "a"), ("é" * 700 + "a", "é" * 700 + "b"), ("", "")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    rows = df.select("i", strings.lcp(F.col("a"), F.col("b")).alias("x"), strings.lcp_scan(F.col("a"), F.col("b")).alias("y"), strings.compare(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()
    assert [r["x"] for r in rows] == [2, 3, 0, 2, None, 700, 0]
    assert [r["y"] for r in rows] == [2, 3, 0, 2, None, 700, 0]
    assert [r["c"] for r in rows][:4] == [-1, 0, -1, 1]


def test_distinguishing_prefixes(spark):
    words = ["abcdefghij", "abcdefghik", "abcdxxxx", "abcd", "zz", "zz", "qrstuvwx", "", None]
    df = spark.createDataFrame(list(enumerate(words)), "i long, s string")
    got = {r["id"]: r["prefix"] for r in strings.distinguishing_prefix(df, "i", "s").collect()}
    want = {}
    for i, w in enumerate(words):
        if w is not None:
            sizes = [n for n in (4, 8, 16) if len(w) >= n and sum((x or "")[:n] == w[:n] and len(x or "") >= n for x in words) == 1]
            want[i] = sizes[0] if sizes else len(w)
    assert got == want


def test_alphabet(spark):
    chars = spark.createDataFrame([(i, c) for i, c in enumerate(b"banana")], "pos long, chr int")
    assert [r["chr"] for r in alphabet.compress(chars).orderBy("pos").collect()] == [2, 1, 3, 1, 3, 1]
    with pytest.raises(ValueError):
        alphabet.codes(spark.range(256).toDF("chr")).collect()
    assert alphabet.codes(spark.range(255).toDF("chr")).count() == 255
    assert [alphabet.packing(b, 39)["packed_chars"] for b in (3, 5, 8)] == [42, 48, 40]
    assert [alphabet.bits_per_code(s) for s in (7, 8, 31, 32)] == [3, 5, 5, 8]


def test_checks(spark):
    up, down = numbers(spark, [1, 1, 2]), numbers(spark, [1, 3, 2])
    ok = lambda df: df.first()["ok"]
    assert ok(check.check_sorted(up, "i", "v")) and not ok(check.check_sorted(down, "i", "v"))
    assert ok(check.check_same(up, up, "i", "v")) and not ok(check.check_same(up, down, "i", "v")) and not ok(check.check_same(up, up.limit(2), "i", "v"))
    assert ok(check.check_same_multiset(up, up)) and not ok(check.check_same_multiset(up, down))
    rows = spark.createDataFrame([(0, "ab", 0), (1, "abc", 2), (2, "b", 0)], "i long, s string, l int")
    assert ok(check.check_lcps(rows, "i", "s", "l"))
    low = rows.withColumn("l", F.lit(0))
    assert not ok(check.check_lcps(low, "i", "s", "l")) and ok(check.check_lcps(low, "i", "s", "l", strict=False))


def test_statistics_and_logs(spark):
    one = stats.imbalance(spark.createDataFrame([(0, 10), (1, 30)], "p int, size long")).first()
    assert (one["max_imbalance"], one["min_imbalance"]) == (0.5, 0.5)
    assert stats.imbalance(spark.createDataFrame([(0, 0)], "p int, size long")).first()["min_imbalance"] == 1.0
    log = ["x n=5 t=1.5", "[n=6]", "root.sort.phase_03:max=1.5 root.sort.phase_03:min=0.5", "k="]
    want = {"n": "6", "t": "1.5", "root.sort.phase_03:max": "1.5", "root.sort.phase_03:min": "0.5", "k": ""}
    assert sinks.parse_log(log) == want
    rows = sinks.parse_log_rows(spark.createDataFrame([(x,) for x in log], "line string"), "line")
    assert sorted(map(tuple, rows.collect())) == sorted([*want.items(), ("n", "5")])
    stats.restart()
    with stats.phase("sort", 1):
        stats.count("text", 1, 9)
    written = sinks.parse_log(stats.current.lines())
    assert written["text_1"] == "9" and float(written["root.sort_1"]) >= 0 and stats.current.peak_kb() > 0
    assert stats.blow_up(10, 1024) == 10.0 and "master" in stats.session_flags(spark)
    times = spark.createDataFrame([("sort", 0, 1.0), ("sort", 1, 2.0), ("total_time", 0, 9.0), ("total_time", 1, 4.0)], "phase string, level int, time double")
    assert {r["phase"]: r["time"] for r in sinks.recursive_times(times).collect()} == {"sort": 3.0, "total_time": 9.0}
    assert stats.peak_memory_kb() > 0


def test_random_symbols(spark):
    a = text.random_symbols(spark, 500, 4, 1).orderBy("pos").collect()
    assert a == text.random_symbols(spark, 500, 4, 1).orderBy("pos").collect() and {r["chr"] for r in a} == {1, 2, 3, 4}


def test_configuration():
    assert parse_config(["--modulus", "7", "--unknown", "1", "--use-loser-tree"]) == Config(modulus=7)
    levels = parse_config(["--buckets-sample-phase", "16,4", "--buckets-merging", "8"])
    assert [levels.buckets_at("samples", k) for k in range(3)] == [16, 4, 1] and levels.buckets_at("merging", 0) == 8
    with pytest.raises(SystemExit):
        parse_config(["--unknown", "1"], extras=False)
