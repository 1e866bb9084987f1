import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from suffixspark.config import Config
from suffixspark.functions.cover import Cover
from pyspark.sql import functions as F

from suffixspark.operators import check, ranks
from suffixspark.operators import suffix_array as sa
from suffixspark.sources import text as texts


def naive(s):
    return sorted(range(len(s)), key=lambda i: s[i:])


def order(df):
    return [p for _, p in sorted((r["idx"], r["pos"]) for r in df.collect())]


def from_bytes(spark, data, x, chunk=37):
    return texts.from_bytes(spark, data, chunk, x)


@given(st.lists(st.integers(1, 3), max_size=80))
@settings(max_examples=200, deadline=None)
def test_small(symbols):
    assert sa.small_suffix_array(np.array(symbols, np.int64)).tolist() == naive(symbols)


def _text(sigma, n, seed):
    r = random.Random(seed)
    return bytes(r.randint(1, sigma) for _ in range(n))


# All go through sampling, recursion and merging: the base case is off.
CASES = [
    (_text(2, 150, 1), 3, 0.7, 10_000), (_text(4, 260, 2), 7, 0.0, 10_000), (_text(250, 300, 3), 3, 0.7, 10_000), (b"ab" * 60 + b"a", 7, 0.7, 5),
    (b"a" * 90, 3, 0.0, 4), (b"abcab" * 30, 13, 0.7, 10), (bytes(range(128, 256)) * 2, 3, 0.7, 10_000), (b"mississippi_is_a_long_river_and_has_certainly_more_characters_than_banana", 7, 0.7, 10_000),
]


@pytest.mark.parametrize("data,x,threshold,tie_group", CASES)
def test_recursive(spark, data, x, threshold, tie_group):
    config = Config(modulus=x, base_case=0, chunk=37, tie_group=tie_group, discarding_threshold=threshold)
    assert order(sa.suffix_array(from_bytes(spark, data, x), config)) == naive(data)


def test_in_buckets_and_by_many_tasks(spark):
    data = _text(3, 400, 5)
    config = Config(modulus=7, base_case=0, chunk=37, buckets_samples=(3,), buckets_merging=(4, 2))
    assert order(sa.suffix_array(from_bytes(spark, data, 7), config)) == naive(data)
    # One key for almost all positions: its rows are dealt over the partitions.
    n = 20_000
    text = from_bytes(spark, b"a" * n, 39, chunk=1024)
    keys = text.chunks.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda i: F.struct((F.col("start") + i).alias("pos"), text.key(i, 38).alias("key")))).alias("s")).select("s.*")
    done = ranks.ranked(keys, ["key"], ["pos"], ["pos"])
    parts = done.rows.select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert done.names == 38 and len(parts) >= 4 and max(r["count"] for r in parts) < 0.6 * n


@pytest.mark.parametrize("extra", range(3))
def test_end_of_text_residues(spark, extra):
    data = _text(2, 60 + extra, 7)
    assert order(sa.suffix_array(from_bytes(spark, data, 3), Config(modulus=3, base_case=0))) == naive(data)


def test_base_case_and_empty(spark):
    assert order(sa.suffix_array(from_bytes(spark, b"banana", 39), Config())) == naive(b"banana")
    assert order(sa.suffix_array(from_bytes(spark, b"", 39), Config())) == []
    assert order(sa.suffix_array(from_bytes(spark, b"x", 39), Config())) == [0]


def test_halo_too_small(spark):
    with pytest.raises(ValueError):
        sa.suffix_array(texts.from_bytes(spark, b"abc", 10, 5), Config())


def test_wide_symbols_and_doubling(spark):
    r = random.Random(5)
    symbols = [r.choice([1, 2, 2**33, 2**39]) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(symbols)), "pos long, chr long")
    assert order(sa.suffix_array_of_symbols(rows, Config(modulus=3, base_case=0, chunk=16))) == naive(symbols)
    assert order(sa.suffix_array_by_doubling(rows)) == naive(symbols)


def test_many_texts(spark):
    rows = [(1, "banana"), (2, "héé aé"), (3, ""), (4, None), (5, "aaaa")]
    df = spark.createDataFrame(rows, "id long, t string")
    for f in (sa.suffix_arrays, sa.suffixes_per_group):
        got = sorted(map(tuple, f(df, "id", "t").collect()))
        assert got == sorted((i, k, p) for i, t in rows if t for k, p in enumerate(naive(t)))


@pytest.mark.parametrize("n,sigma", [(50, 2), (300, 200), (400, 8)])
def test_checker(spark, n, sigma):
    data = _text(sigma, n, n)
    chars = spark.createDataFrame(list(enumerate(data)), "pos long, chr long")
    ok = lambda s: check.check_suffix_array(spark.createDataFrame(list(enumerate(s)), "idx long, pos long"), chars).first()["ok"]
    s = naive(data)
    assert ok(s)
    assert not ok(s[::-1])
    assert not ok([s[1], s[0], *s[2:]])
    assert not ok([s[1], *s[1:]])
    assert not ok(s[:-1])


def test_checker_all_the_same(spark):
    chars = spark.createDataFrame([(i, 97) for i in range(40)], "pos long, chr long")
    assert check.check_suffix_array(spark.createDataFrame([(i, 39 - i) for i in range(40)], "idx long, pos long"), chars).first()["ok"]


def test_chunks_hold_halos(spark):
    data = _text(200, 1000, 9)
    for row in texts.from_bytes(spark, data, 64, 39).chunks.collect():
        assert bytes(row["body"]) == data[row["start"] : row["start"] + 64 + 39] and row["len"] == min(64, 1000 - row["start"])


def test_files_round_trip(spark, tmp_path):
    from suffixspark import cli
    from suffixspark.sources import sinks

    data = b"to be or not to be, that is the question " * 3
    (tmp_path / "in.txt").write_bytes(data)
    out = tmp_path / "sa.bin"
    out.write_bytes(b"x" * 9999)
    got = cli.run(spark, ["--input", str(tmp_path / "in.txt"), "--output", str(out), "--modulus", "7", "--base-case", "0", "--check", "--json-output-path", str(tmp_path / "log"), "--ams-levels", "2"])
    assert got["SA_ok"] and got["n"] == len(data)
    raw = out.read_bytes()
    assert [int.from_bytes(raw[i : i + 5], "little") for i in range(0, len(raw), 5)] == naive(data)
    assert order(sinks.read_uint40(spark, str(out))) == naive(data)
    assert (tmp_path / "log_timer.json").exists() and (tmp_path / "log_counter.json").exists()
    assert cli.run(spark, ["--input", str(tmp_path / "in.txt"), "--textsize", "10"])["n"] == 10
    with pytest.raises(FileNotFoundError):
        cli.run(spark, ["--input", str(tmp_path / "nothing")])


def test_tables_are_released(spark):
    from suffixspark.sources import shared

    shared.release(spark)
    df = shared.materialise(spark.range(3))
    assert df.count() == 3 and shared.release(spark) == 1 and shared.release(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FAILED_READ_FILE"):
        spark.read.schema(df.schema).parquet(*df.inputFiles()).count()


def test_cover_and_reduced_order_match(spark):
    cover, n = Cover.of(7), 100
    data = _text(5, n, 1)
    rows = sa.sample_positions(from_bytes(spark, data, 7), cover).collect()
    assert {r["pos"]: bytes(r["key"]) for r in rows} == {p: data[p : p + 7] for p in range(n + cover.needs_dummy(n)) if cover.contains(p)}
