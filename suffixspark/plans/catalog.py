"""The engine's registered queries, and the same in SQL where SQL can say it.

``T`` is the text of all part names, joined by a control character in the order of their keys; ``B`` that of all benchmark
texts. Their base case is 1000 symbols, so that suffix arrays go through sampling, recursion and merging.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..config import Config
from ..functions import stats, strings
from ..functions.cover import Cover
from ..operators import alphabet, check, distribute, ranks
from ..operators import suffix_array as sa
from ..sources import sinks
from ..sources import text as texts
from ..sources.shared import materialise, register, shared_dir

CONFIG = Config(base_case=1000)
COVER = Cover.of(CONFIG.modulus)
PARTS, BUCKETS, CHUNK = 7, 8, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_text(spark: SparkSession, sf_dir: str) -> texts.Text:
    return texts.from_rows(table(spark, sf_dir, "part"), "p_partkey", "p_name", b"\1", CONFIG.chunk, COVER.modulus)


def benchmark_text(spark: SparkSession, sf_dir: str) -> texts.Text:
    return texts.from_rows(table(spark, sf_dir, "benchmark"), "item_id", "text", b"\1", CONFIG.chunk, COVER.modulus)


def sa_per_document(spark, sf_dir):
    return sa.suffix_arrays(table(spark, sf_dir, "documents"), "doc_id", "text")


def sa_per_part(spark, sf_dir):
    return sa.suffixes_per_group(table(spark, sf_dir, "part"), "p_partkey", "p_name")


def sa_per_benchmark_item(spark, sf_dir):
    return sa.suffix_arrays(table(spark, sf_dir, "benchmark"), "item_id", "text")


def sa_part_names(spark, sf_dir):
    return sa.suffix_array(part_text(spark, sf_dir), CONFIG)


def sa_part_names_dc7(spark, sf_dir):
    cover = Cover.of(7)
    text = texts.from_rows(table(spark, sf_dir, "part"), "p_partkey", "p_name", b"\1", CONFIG.chunk, cover.modulus)
    return sa.suffix_array(text, Config(modulus=7, discarding_threshold=1.0, base_case=CONFIG.base_case))


def sa_benchmark_text(spark, sf_dir):
    return sa.suffix_array(benchmark_text(spark, sf_dir), CONFIG)


def sa_benchmark_dc3(spark, sf_dir):
    """Modulo 3, and recursion on all ranks."""
    text = texts.from_rows(table(spark, sf_dir, "benchmark"), "item_id", "text", b"\1", CONFIG.chunk, 3)
    return sa.suffix_array(text, Config(modulus=3, discarding_threshold=0.0, base_case=CONFIG.base_case))


def sa_cli_file(spark, sf_dir):
    """The command line: a folder of files as input, 5-byte positions as output."""
    folder = register(spark, f"{shared_dir(spark)}/cli-{uuid.uuid4().hex}")
    names = table(spark, sf_dir, "part").select("p_name", "p_partkey").coalesce(1).sortWithinPartitions("p_partkey").select("p_name")
    names.write.option("lineSep", "\1").text(f"{folder}/in")
    cli.run(spark, ["--input", f"{folder}/in", "--output", f"{folder}/out.bin", "--base-case", str(CONFIG.base_case)], keep=True)
    return sinks.read_uint40(spark, f"{folder}/out.bin")


def run_statistics(spark, sf_dir):
    """Sizes at the top level, as a run's statistics have them."""
    run = stats.restart()
    sa.suffix_array(part_text(spark, sf_dir), CONFIG)
    rows = [(name, size) for (name, level), size in run.counts.items() if level == 0 and name in ("text", "samples")]
    return spark.createDataFrame(rows, "name string, size long")


def random_text(spark, sf_dir):
    return texts.random_symbols(spark, table(spark, sf_dir, "customer").count(), 4, CONFIG.seed)


def log_values(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select(F.concat(F.lit("RESULT root.sort.level_"), (F.col("o_orderkey") % 3).cast("string"), F.lit(":max="), F.col("o_custkey").cast("string"), F.lit(" [n="), F.col("o_orderkey").cast("string"), F.lit("] done")).alias("line"))
    return sinks.parse_log_rows(lines, "line")


def level_times(spark, sf_dir):
    records = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("phase"), (F.col("o_orderkey") % 3).cast("int").alias("level"), F.col("o_custkey").cast("double").alias("time"))
    return sinks.recursive_times(records, ("1-URGENT", "5-LOW"))


def file_presence(spark, sf_dir):
    rows = [(name, texts.exists(spark, f"{sf_dir}/{name}.parquet")) for name in ("part", "nothing")]
    return spark.createDataFrame(rows, "name string, found boolean")


def sa_benchmark_by_doubling(spark, sf_dir):
    return sa.suffix_array_by_doubling(texts.characters(benchmark_text(spark, sf_dir)))


def sa_inverse(spark, sf_dir):
    return sa.inverse(sa_benchmark_text(spark, sf_dir))


def _nations(spark, sf_dir):
    rows = ranks.row_index(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), ["c_custkey"], "pos")
    return materialise(rows.select("pos", (F.col("c_nationkey") + 1).cast("long").alias("chr")))


def sa_int_sequence(spark, sf_dir):
    return sa.suffix_array_of_symbols(_nations(spark, sf_dir), CONFIG)


def _letters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.explode(F.split("text", "")).alias("c"))
    return docs.select(F.col("doc_id").alias("pos"), F.ascii("c").alias("chr"))


def alphabet_histogram(spark, sf_dir):
    return alphabet.histogram(_letters(spark, sf_dir))


def alphabet_codes(spark, sf_dir):
    return alphabet.codes(_letters(spark, sf_dir))


def alphabet_compressed(spark, sf_dir):
    return alphabet.compress(texts.characters(part_text(spark, sf_dir)))


def packed_keys(spark, sf_dir):
    key = F.col("p_name").cast("binary")
    return table(spark, sf_dir, "part").select("p_partkey", alphabet.packed(key, 8, 7).alias("packed"))


def dc_samples(spark, sf_dir):
    return sa.sample_positions(part_text(spark, sf_dir), COVER).select("pos", F.col("key").cast("string").alias("sample_key"))


def dc_ranks(spark, sf_dir):
    named, _ = ranks.dense_rank(sa.sample_positions(part_text(spark, sf_dir), COVER), "key")
    return named.select("pos", "rank", "uniq")


def dc_discard_kept(spark, sf_dir):
    text = part_text(spark, sf_dir)
    named, _ = ranks.dense_rank(sa.sample_positions(text, COVER), "key")
    rows = sa.with_kept(materialise(named.select("uniq", sa.reduced_index(COVER, text.n, F.col("pos")).alias("i"))))
    return rows.agg(F.count("*").alias("n_samples"), F.sum(F.col("kept").cast("long")).alias("n_kept"))


def dc_reduced_order(spark, sf_dir):
    text = part_text(spark, sf_dir)
    return sa.sample_positions(text, COVER).select("pos", sa.reduced_index(COVER, text.n, F.col("pos")).alias("reduced"))


def dc_positions_per_residue(spark, sf_dir):
    n = part_text(spark, sf_dir).n
    return spark.createDataFrame(list(enumerate(COVER.positions_per_residue(n))), "residue long, n long")


def dc_slots(spark, sf_dir):
    """Samples numbered by position."""
    return sa.sample_positions(part_text(spark, sf_dir), COVER).select("pos", sa.slot(COVER, F.col("pos")).alias("slot"))


def dc_map_back(spark, sf_dir):
    """The way back from places in the order (residue, position)."""
    n = part_text(spark, sf_dir).n
    total = sum(c for r, c in enumerate(COVER.positions_per_residue(n + COVER.needs_dummy(n))) if COVER.contains(r))
    return spark.range(total).select(F.col("id").alias("reduced"), sa.position_of(COVER, n, F.col("id")).alias("pos"))


def dc_sample_order(spark, sf_dir):
    """Ranks of the sample's suffixes, through the recursion."""
    text = part_text(spark, sf_dir)
    return sa.sample_ranks(text, COVER, CONFIG).where(F.col("pos") < text.n)


def _checked(spark, sf_dir, change) -> DataFrame:
    text = benchmark_text(spark, sf_dir)
    return check.check_suffix_array(change(sa.suffix_array(text, CONFIG), text.n), texts.characters(text))


def sa_check_ok(spark, sf_dir):
    return _checked(spark, sf_dir, lambda s, n: s)


def sa_check_reversed(spark, sf_dir):
    return _checked(spark, sf_dir, lambda s, n: s.select((F.lit(n - 1) - F.col("idx")).alias("idx"), "pos"))


def sa_check_swapped(spark, sf_dir):
    return _checked(spark, sf_dir, lambda s, n: s.select(F.when(F.col("idx") < 2, 1 - F.col("idx")).otherwise(F.col("idx")).alias("idx"), "pos"))


def sa_check_duplicated(spark, sf_dir):
    return _checked(spark, sf_dir, lambda s, n: s.select("idx", F.when(F.col("idx") == 0, F.lit(0).cast("long")).otherwise(F.col("pos")).alias("pos")).unionByName(s.where("idx = 0")))


def check_sorted_prices(spark, sf_dir):
    rows = materialise(ranks.row_index(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], "i"))
    return check.check_sorted(rows, "i", "o_totalprice")


def check_unsorted_prices(spark, sf_dir):
    rows = materialise(ranks.row_index(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), ["o_orderkey"], "i"))
    return check.check_sorted(rows, "i", "o_totalprice")


def check_same_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cases = {"dealt": rows.repartition(PARTS, "o_custkey"), "changed": rows.withColumn("o_custkey", F.when(F.col("o_orderkey") % 1000 == 1, 0).otherwise(F.col("o_custkey")))}
    return _cases({k: check.check_same(rows, v, "o_orderkey", "o_custkey") for k, v in cases.items()})


def check_same_multiset(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority")
    cases = {"sorted": rows.sort("o_orderpriority"), "fewer": table(spark, sf_dir, "orders").where("o_orderkey % 1000 <> 1").select("o_orderpriority")}
    return _cases({k: check.check_same_multiset(rows, v) for k, v in cases.items()})


def _cases(checks: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, ok in checks.items():
        row = ok.select(F.lit(name).alias("case"), "ok")
        out = row if out is None else out.unionByName(row)
    return out


def _urls(spark, sf_dir):
    return materialise(ranks.row_index(table(spark, sf_dir, "pages").select("url", "page_id"), ["url", "page_id"], "i"))


def lcp_adjacent(spark, sf_dir):
    rows = ranks.neighbour(_urls(spark, sf_dir), "i", "url", -1, "before")
    return rows.select("i", F.coalesce(strings.lcp(F.col("before"), F.col("url")), F.lit(0)).cast("long").alias("lcp"))


def check_lcps(spark, sf_dir):
    rows = _urls(spark, sf_dir)
    with_lcp = ranks.neighbour(rows, "i", "url", -1, "before").select("i", "url", F.coalesce(strings.lcp_scan(F.col("before"), F.col("url")), F.lit(0)).alias("lcp"))
    return check.check_lcps(materialise(with_lcp), "i", "url", "lcp")


def compare_with_lcp(spark, sf_dir):
    """Neighbours compared from the first character on that isn't known to be equal; urls share their scheme."""
    rows = ranks.neighbour(_urls(spark, sf_dir), "i", "url", -1, "before").where("before is not null")
    known = F.when(F.substring("url", 1, 4) == F.substring("before", 1, 4), 4).otherwise(0)
    return rows.select("i", strings.compare_from(F.col("before"), F.col("url"), known).alias("c")).select("i", F.col("c.order").alias("order_of"), F.col("c.lcp").cast("long").alias("lcp"))


def distinguishing_prefix(spark, sf_dir):
    out = strings.distinguishing_prefix(table(spark, sf_dir, "pages"), "page_id", "url")
    return out.select(F.col("id").alias("page_id"), F.col("prefix").cast("long").alias("prefix"))


def distinguishing_prefix_documents(spark, sf_dir):
    out = strings.distinguishing_prefix(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select(F.col("id").alias("doc_id"), F.col("prefix").cast("long").alias("prefix"))


def front_coding(spark, sf_dir):
    return strings.front_coding(_urls(spark, sf_dir), "i", "url")


def compare_neighbours(spark, sf_dir):
    rows = ranks.neighbour(materialise(ranks.row_index(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"], "i")), "i", "p_name", 1, "after")
    return rows.where("after is not null").select("p_partkey", strings.compare(F.col("p_name"), F.col("after")).alias("order_of"))


def zip_index(spark, sf_dir):
    return ranks.row_index(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


def running_items(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"))
    return ranks.prefix_sum(per, "l_orderkey", "items", "before")


def shifted(spark, sf_dir):
    rows = materialise(ranks.row_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "i"))
    both = ranks.neighbour(ranks.neighbour(rows, "i", "o_custkey", 1, "next_key"), "i", "o_custkey", -1, "prev_key")
    return both.select("o_orderkey", F.coalesce("next_key", F.lit(-1)).alias("next_key"), F.coalesce("prev_key", F.lit(-1)).alias("prev_key"))


def unique_keys(spark, sf_dir):
    return distribute.with_ties(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey").select("c_custkey", (F.col("m") == 1).alias("uniq"), "m")


def orders_dense_rank(spark, sf_dir):
    out, _ = ranks.dense_rank(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    return out.select("o_orderkey", "rank", "uniq")


def _events(spark, sf_dir):
    return materialise(ranks.row_index(table(spark, sf_dir, "events").select("event_id"), ["event_id"], "i"))


def distribute_even(spark, sf_dir):
    return distribute.even(_events(spark, sf_dir), "i", PARTS).select("event_id", "target")


def distribute_custom(spark, sf_dir):
    rows = _events(spark, sf_dir)
    n = rows.count()
    cuts = [n * k * k // 36 for k in range(7)]
    return distribute.custom(rows, "i", [b - a for a, b in zip(cuts, cuts[1:], strict=False)]).groupBy("target").agg(F.count("*").alias("size"), F.min("event_id").alias("first_id"))


def bucket_major(spark, sf_dir):
    rows = distribute.bucket_major(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", PARTS)
    return rows.select("o_orderkey", "idx", "target")


def bucket_groups(spark, sf_dir):
    rows = distribute.by_buckets(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", PARTS, balanced=False)
    return rows.select("o_orderkey", "target")


def _uneven(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 < 8, 0).otherwise(F.col("o_orderkey") % PARTS).alias("part"))
    return materialise(ranks.row_index(rows, ["o_orderkey"], "i"))


def rebalanced(spark, sf_dir):
    return distribute.rebalance(_uneven(spark, sf_dir), "i", PARTS, CONFIG.min_imbalance)[0].select("o_orderkey", "target")


def rebalanced_small(spark, sf_dir):
    return distribute.rebalance_small(_uneven(spark, sf_dir), "i", PARTS)[0].select("o_orderkey", "target")


def largest_bucket_imbalance(spark, sf_dir):
    return stats.bucket_imbalance(stats.sizes(_uneven(spark, sf_dir), "part"), PARTS)


def partition_imbalance(spark, sf_dir):
    return stats.imbalance(stats.sizes(table(spark, sf_dir, "orders"), "o_orderpriority"))


def bucket_imbalance(spark, sf_dir):
    return stats.bucket_imbalance(stats.sizes(table(spark, sf_dir, "customer"), "c_nationkey"), 25)


def value_summary(spark, sf_dir):
    return stats.summary(table(spark, sf_dir, "lineitem"), "l_linenumber")


def chunk_table(spark, sf_dir):
    return distribute.chunk_rows(table(spark, sf_dir, "lineitem").count(), CHUNK, spark)


def chunk_send_counts(spark, sf_dir):
    chunks = distribute.chunk_rows(table(spark, sf_dir, "lineitem").count(), CHUNK, spark)
    return distribute.send_counts(distribute.chunk_targets(chunks, PARTS, CONFIG.seed))


def interval_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return distribute.interval_sizes(rows, "o_orderkey", distribute.splitters(rows, "o_orderkey", BUCKETS))


def random_bucket_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return distribute.interval_sizes(rows, "o_orderkey", distribute.splitters(rows, "o_orderkey", BUCKETS, True, 1000, CONFIG.seed))


def record_buckets(spark, sf_dir):
    """Sizes of the ranges of records that compare by two columns."""
    rows, order = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"]
    cuts = distribute.record_splitters(rows, order, BUCKETS, 1000, CONFIG.seed)
    return rows.groupBy(distribute.bucket_of_record(order, cuts).alias("bucket")).agg(F.count("*").alias("size"))


def splitter_positions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    cuts = distribute.splitters(rows, "o_orderkey", BUCKETS)
    return rows.select("o_orderkey", strings.first_at_least(cuts, F.col("o_orderkey")).alias("scanned"), strings.bisected(cuts, F.col("o_orderkey")).alias("halved"))


def merge_sorted(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.lit("c").alias("side"), F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.lit("s").alias("side"), F.col("s_suppkey").alias("k"))
    return distribute.merge_sorted([a, b], ["k", "side"])


def sorted_prices(spark, sf_dir):
    rows = ranks.row_index(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"])
    return rows.select("o_orderkey", "idx")


def strings_with_ties(spark, sf_dir):
    """A string sort whose equal strings go by a second key, with each row's tie group."""
    rows = ranks.row_index(table(spark, sf_dir, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"])
    return distribute.with_ties(materialise(rows), "p_name").select("p_partkey", "idx", "m")


_RESIDUES = ", ".join(map(str, COVER.residues))
_X, _D = COVER.modulus, len(COVER.residues)
_T = "t AS (SELECT string_agg(p_name, chr(1) ORDER BY p_partkey) AS t FROM part), p AS (SELECT t, length(t) AS n, unnest(range(length(t))) AS pos FROM t)"
# The benchmark's texts aren't all ASCII; hexadecimal digits order as the bytes do.
_B = "t AS (SELECT hex(encode(string_agg(text, chr(1) ORDER BY item_id))) AS t FROM benchmark), p AS (SELECT t, unnest(range(length(t) // 2)) AS pos FROM t)"
_SA = "SELECT row_number() OVER (ORDER BY substr(t, pos + 1)) - 1 AS idx, pos FROM p"
_SA_BYTES = "SELECT row_number() OVER (ORDER BY substr(t, 2 * pos + 1)) - 1 AS idx, pos FROM p"
_SAMPLES = f"{_T}, s AS (SELECT pos, n, substr(t, pos + 1, {_X}) AS sample_key FROM p WHERE pos % {_X} IN ({_RESIDUES}) UNION ALL SELECT length(t), length(t), '' FROM t WHERE length(t) % {_X} IN ({_RESIDUES}))"
_REDUCED = f"r AS (SELECT *, row_number() OVER (ORDER BY pos % {_X}, pos // {_X}) - 1 AS reduced, dense_rank() OVER (ORDER BY sample_key) AS rank, count(*) OVER (PARTITION BY sample_key) = 1 AS uniq FROM s)"
_URLS = "u AS (SELECT url, row_number() OVER (ORDER BY url, page_id) - 1 AS i FROM pages), v AS (SELECT i, url, coalesce(lag(url) OVER (ORDER BY i), '') AS before FROM u)"
_LCP = "coalesce(list_min(list_filter(range(1, least(length(before), length(url)) + 1), lambda k: substr(before, k, 1) <> substr(url, k, 1))) - 1, least(length(before), length(url)))"


def _check_sql(idx: str = "idx", pos: str = "pos", more: str = "") -> str:
    """Whether the changed suffix array has each place and position once, and suffixes in order."""
    return (
        f"WITH {_B}, sa AS ({_SA_BYTES}), c AS (SELECT {idx} AS idx, {pos} AS pos FROM sa{more}), o AS (SELECT c.idx, c.pos, substr(p.t, 2 * p.pos + 1) AS s FROM c JOIN p ON p.pos = c.pos), "
        "w AS (SELECT idx, pos, s, lag(s) OVER (ORDER BY idx) AS prev FROM o) SELECT count(*) = (SELECT count(*) FROM p) AND count(DISTINCT idx) = count(*) AND count(DISTINCT pos) = count(*) AND bool_and(coalesce(prev < s, true)) AS ok FROM w"
    )


def _digits(value: str) -> str:
    return f"CAST(('0x' || substr(md5('{CONFIG.seed}_' || {value}), 1, 7)) AS BIGINT)"


def _same_sql(case: str, a: str, b: str) -> str:
    return f"SELECT '{case}' AS \"case\", NOT EXISTS ({a} EXCEPT ALL {b}) AND NOT EXISTS ({b} EXCEPT ALL {a}) AS ok"


_UNEVEN = f"u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 8 THEN 0 ELSE o_orderkey % {PARTS} END AS part, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), z AS (SELECT min(s) AS low, avg(s) AS mean FROM (SELECT count(u.part) AS s FROM range({PARTS}) r(p) LEFT JOIN u ON u.part = r.p GROUP BY r.p))"


def _prefix_sql(name: str, key: str, text: str, top: int) -> str:
    """``top`` steps: as many as the longest text of the tables has."""
    steps = [4 * 2**k for k in range(top)]
    whens = " ".join(f"WHEN length(x) >= {n} AND c{n} = 1 THEN {n}" for n in steps)
    counts = ", ".join(f"count(*) FILTER (WHERE length({text}) >= {n}) OVER (PARTITION BY substr({text}, 1, {n})) AS c{n}" for n in steps)
    return f"SELECT {key}, CAST(CASE {whens} ELSE length(x) END AS BIGINT) AS prefix FROM (SELECT {key}, {text} AS x, {counts} FROM {name})"


_ORACLE = {
    "sa_per_part": "SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY substr(p_name, pos + 1)) - 1 AS idx, pos FROM (SELECT p_partkey, p_name, unnest(range(length(p_name))) AS pos FROM part)",
    # Whole suffixes are compared where their first 64 characters tie.
    "sa_per_document": """
        WITH p AS (SELECT doc_id, text, unnest(range(length(text))) AS pos FROM documents),
        k AS (SELECT doc_id, text, pos, substr(text, pos + 1, 64) AS near FROM p),
        t AS (SELECT *, count(*) OVER (PARTITION BY doc_id, near) > 1 AS tied FROM k)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY near, CASE WHEN tied THEN substr(text, pos + 1) END) - 1 AS idx, pos FROM t""",
    "sa_per_benchmark_item": "SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY substr(text, pos + 1)) - 1 AS idx, pos FROM (SELECT item_id, text, unnest(range(length(text))) AS pos FROM benchmark)",
    "sa_part_names": f"WITH {_T} {_SA}",
    "sa_part_names_dc7": f"WITH {_T} {_SA}",
    "sa_benchmark_text": f"WITH {_B} {_SA_BYTES}",
    "sa_benchmark_by_doubling": f"WITH {_B} {_SA_BYTES}",
    "sa_inverse": f"WITH {_B}, sa AS ({_SA_BYTES}) SELECT pos, idx + 1 AS rank FROM sa",
    "sa_int_sequence": "WITH s AS (SELECT list(c_nationkey + 1 ORDER BY c_custkey) AS l FROM customer), p AS (SELECT l, unnest(range(len(l))) AS pos FROM s) SELECT row_number() OVER (ORDER BY l[pos + 1:]) - 1 AS idx, pos FROM p",
    "alphabet_histogram": "SELECT unicode(c) AS chr, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0) GROUP BY ALL",
    "alphabet_codes": "SELECT chr, CAST(row_number() OVER (ORDER BY chr) AS INTEGER) AS code FROM (SELECT DISTINCT unicode(c) AS chr FROM (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0))",
    "alphabet_compressed": f"WITH {_T}, c AS (SELECT pos, substr(t, pos + 1, 1) AS ch FROM p) SELECT pos, dense_rank() OVER (ORDER BY ch) AS chr FROM c",
    "packed_keys": "SELECT p_partkey, " + " + ".join(f"CAST(CASE WHEN length(p_name) >= {i + 1} THEN unicode(substr(p_name, {i + 1}, 1)) ELSE 0 END AS BIGINT) * {256 ** (6 - i)}" for i in range(7)) + " AS packed FROM part",
    "dc_samples": f"WITH {_SAMPLES} SELECT pos, sample_key FROM s",
    "dc_ranks": f"WITH {_SAMPLES}, {_REDUCED} SELECT pos, rank, uniq FROM r",
    "dc_discard_kept": f"WITH {_SAMPLES}, {_REDUCED}, k AS (SELECT uniq, coalesce(lag(uniq) OVER (ORDER BY reduced), false) AS prev FROM r) SELECT count(*) AS n_samples, count(*) FILTER (WHERE NOT (uniq AND prev)) AS n_kept FROM k",
    "dc_reduced_order": f"WITH {_SAMPLES}, {_REDUCED} SELECT pos, reduced FROM r",
    "dc_positions_per_residue": f"WITH {_T} SELECT pos % {_X} AS residue, count(*) AS n FROM p GROUP BY ALL",
    "dc_sample_order": f"WITH {_T}, s AS (SELECT pos, t, n FROM p WHERE pos % {_X} IN ({_RESIDUES})) SELECT pos, row_number() OVER (ORDER BY substr(t, pos + 1)) + CASE WHEN n % {_X} IN ({_RESIDUES}) THEN 1 ELSE 0 END AS rank FROM s",
    "sa_check_ok": _check_sql(),
    "sa_check_reversed": _check_sql("(SELECT count(*) FROM sa) - 1 - idx"),
    "sa_check_swapped": _check_sql("CASE WHEN idx < 2 THEN 1 - idx ELSE idx END"),
    "sa_check_duplicated": _check_sql("idx", "CASE WHEN idx = 0 THEN 0 ELSE pos END", " UNION ALL SELECT idx, pos FROM sa WHERE idx = 0"),
    "check_sorted_prices": "WITH w AS (SELECT o_totalprice AS a, lead(o_totalprice) OVER (ORDER BY o_totalprice, o_orderkey) AS b FROM orders) SELECT bool_and(coalesce(a <= b, true)) AS ok FROM w",
    "check_unsorted_prices": "WITH w AS (SELECT o_totalprice AS a, lead(o_totalprice) OVER (ORDER BY o_orderkey) AS b FROM orders) SELECT bool_and(coalesce(a <= b, true)) AS ok FROM w",
    "check_same_orders": _same_sql("dealt", "(SELECT o_orderkey, o_custkey FROM orders)", "(SELECT o_orderkey, o_custkey FROM orders)") + " UNION ALL " + _same_sql("changed", "(SELECT o_orderkey, o_custkey FROM orders)", "(SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 1 THEN 0 ELSE o_custkey END FROM orders)"),
    "check_same_multiset": _same_sql("sorted", "(SELECT o_orderpriority FROM orders)", "(SELECT o_orderpriority FROM orders)") + " UNION ALL " + _same_sql("fewer", "(SELECT o_orderpriority FROM orders)", "(SELECT o_orderpriority FROM orders WHERE o_orderkey % 1000 <> 1)"),
    "lcp_adjacent": f"WITH {_URLS} SELECT i, CAST({_LCP} AS BIGINT) AS lcp FROM v",
    "check_lcps": f"WITH {_URLS}, l AS (SELECT before, url, {_LCP} AS l FROM v) SELECT bool_and(substr(before, 1, l) = substr(url, 1, l) AND (l = least(length(before), length(url)) OR substr(before, l + 1, 1) <> substr(url, l + 1, 1))) AS ok FROM l",
    "distinguishing_prefix": _prefix_sql("pages", "page_id", "url", 8),
    "distinguishing_prefix_documents": _prefix_sql("documents", "doc_id", "text", 18),
    "front_coding": f"WITH {_URLS} SELECT count(*) AS strings, CAST(sum(length(url)) AS BIGINT) AS total_len, CAST(sum({_LCP}) AS BIGINT) AS total_lcp, CAST(sum(length(url)) - sum({_LCP}) + count(*) AS BIGINT) AS sent FROM v",
    "compare_neighbours": "SELECT p_partkey, CASE WHEN p_name < b THEN -1 WHEN p_name > b THEN 1 ELSE 0 END AS order_of FROM (SELECT p_partkey, p_name, lead(p_name) OVER (ORDER BY p_partkey) AS b FROM part) WHERE b IS NOT NULL",
    "zip_index": "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS idx FROM lineitem",
    "running_items": "SELECT l_orderkey, items, CAST(coalesce(sum(items) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY l_orderkey)",
    "shifted": "SELECT o_orderkey, lead(o_custkey, 1, -1) OVER (ORDER BY o_orderkey) AS next_key, lag(o_custkey, 1, -1) OVER (ORDER BY o_orderkey) AS prev_key FROM orders",
    "unique_keys": "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) = 1 AS uniq, count(*) OVER (PARTITION BY c_nationkey) AS m FROM customer",
    "orders_dense_rank": "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) AS rank, count(*) OVER (PARTITION BY o_custkey) = 1 AS uniq FROM orders",
    "distribute_even": f"SELECT event_id, CAST(least({PARTS - 1}, i // greatest(1, n // {PARTS})) AS INTEGER) AS target FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events)",
    "distribute_custom": "SELECT CAST(target AS INTEGER) AS target, count(*) AS size, min(event_id) AS first_id FROM (SELECT event_id, list_count(list_filter(range(1, 6), lambda k: i >= n * k * k // 36)) AS target FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events)) GROUP BY ALL",
    "bucket_major": f"SELECT o_orderkey, idx, CAST(CASE WHEN idx < (n % {PARTS}) * (n // {PARTS} + 1) THEN idx // (n // {PARTS} + 1) ELSE n % {PARTS} + (idx - (n % {PARTS}) * (n // {PARTS} + 1)) // (n // {PARTS}) END AS INTEGER) AS target FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders)",
    "partition_imbalance": "SELECT min(s) AS min_size, max(s) AS max_size, avg(s) AS avg_size, max(s) / avg(s) - 1 AS max_imbalance, min(s) / avg(s) AS min_imbalance FROM (SELECT count(*) AS s FROM orders GROUP BY o_orderpriority)",
    "bucket_imbalance": "SELECT max(s) / (sum(s) / 25.0) - 1 AS bucket_imbalance FROM (SELECT CAST(count(*) AS DOUBLE) AS s FROM customer GROUP BY c_nationkey)",
    "value_summary": "SELECT min(l_linenumber) AS min_value, max(l_linenumber) AS max_value, avg(l_linenumber) AS avg_value, CAST(sum(l_linenumber) AS BIGINT) AS sum_value FROM lineitem",
    "chunk_table": f"SELECT k AS chunk_id, k * {CHUNK} AS start, CAST(least({CHUNK}, n - k * {CHUNK}) AS INTEGER) AS size FROM (SELECT n, unnest(range((n + {CHUNK - 1}) // {CHUNK})) AS k FROM (SELECT count(*) AS n FROM lineitem))",
    "interval_sizes": f"WITH o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), s AS (SELECT k FROM o WHERE i IN (SELECT unnest(list_transform(range(1, {BUCKETS}), lambda b: n * b // {BUCKETS})) FROM (SELECT count(*) AS n FROM orders))) SELECT CAST(b AS INTEGER) AS bucket, count(*) AS size FROM (SELECT (SELECT count(*) FROM s WHERE s.k <= o.k) AS b FROM o) GROUP BY ALL",
    "merge_sorted": "SELECT side, k, row_number() OVER (ORDER BY k, side) - 1 AS idx FROM (SELECT 'c' AS side, c_custkey AS k FROM customer UNION ALL SELECT 's', s_suppkey FROM supplier)",
    "sorted_prices": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS idx FROM orders",
    "sa_benchmark_dc3": f"WITH {_B} {_SA_BYTES}",
    "sa_cli_file": "WITH t AS (SELECT string_agg(p_name || chr(1), '' ORDER BY p_partkey) AS t FROM part), p AS (SELECT t, unnest(range(length(t))) AS pos FROM t) " + _SA,
    "run_statistics": f"WITH {_SAMPLES} SELECT 'text' AS name, n AS size FROM (SELECT length(t) AS n FROM t) UNION ALL SELECT 'samples', count(*) FROM s",
    "random_text": f"SELECT pos, {_digits('pos')} % 4 + 1 AS chr FROM (SELECT unnest(range(count(*))) AS pos FROM customer)",
    "log_values": "SELECT 'root.sort.level_' || (o_orderkey % 3) || ':max' AS name, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT 'n', CAST(o_orderkey AS VARCHAR) FROM orders",
    "level_times": "SELECT o_orderpriority AS phase, CAST(CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN sum(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END) ELSE sum(o_custkey) END AS DOUBLE) AS time FROM orders GROUP BY o_orderpriority",
    "file_presence": "SELECT name, name IN (SELECT table_name FROM information_schema.tables UNION SELECT view_name FROM duckdb_views()) AS found FROM (VALUES ('part'), ('nothing')) v(name)",
    "dc_slots": f"WITH {_SAMPLES} SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS slot FROM s",
    "dc_map_back": f"WITH {_SAMPLES}, {_REDUCED} SELECT reduced, pos FROM r",
    "compare_with_lcp": f"WITH {_URLS} SELECT i, CASE WHEN before < url THEN -1 WHEN before > url THEN 1 ELSE 0 END AS order_of, CAST({_LCP} AS BIGINT) AS lcp FROM v WHERE i > 0",
    "bucket_groups": f"WITH c AS (SELECT o_orderpriority AS b, count(*) AS s FROM orders GROUP BY ALL), k AS (SELECT count(*) AS k FROM c), r AS (SELECT b, s, {PARTS} // k + CASE WHEN row_number() OVER (ORDER BY s DESC, b) <= {PARTS} % k THEN 1 ELSE 0 END AS parts FROM c, k), f AS (SELECT *, sum(parts) OVER (ORDER BY b) - parts AS first FROM r), o AS (SELECT o_orderkey, o_orderpriority AS b, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey, CAST(first + least(parts - 1, i // greatest(1, s // parts)) AS INTEGER) AS target FROM o JOIN f USING (b)",
    "rebalanced": f"WITH {_UNEVEN} SELECT o_orderkey, CAST(CASE WHEN low <= {CONFIG.min_imbalance} * mean THEN least({PARTS - 1}, i // greatest(1, n // {PARTS})) ELSE part END AS INTEGER) AS target FROM u, z",
    "rebalanced_small": f"WITH {_UNEVEN} SELECT o_orderkey, CAST(CASE WHEN low <= {PARTS} THEN least({PARTS - 1}, i // greatest(1, n // {PARTS})) ELSE part END AS INTEGER) AS target FROM u, z",
    "largest_bucket_imbalance": f"WITH {_UNEVEN} SELECT max(s) / (sum(s) / {PARTS}.0) - 1 AS bucket_imbalance FROM (SELECT CAST(count(*) AS DOUBLE) AS s FROM u GROUP BY part)",
    "chunk_send_counts": f"SELECT CAST(target AS INTEGER) AS target, CAST(sum(size) AS BIGINT) AS n FROM (SELECT {_digits('k')} % {PARTS} AS target, least({CHUNK}, n - k * {CHUNK}) AS size FROM (SELECT n, unnest(range((n + {CHUNK - 1}) // {CHUNK})) AS k FROM (SELECT count(*) AS n FROM lineitem))) GROUP BY target",
    "random_bucket_sizes": f"WITH d AS (SELECT o_orderkey AS k FROM orders ORDER BY {_digits('o_orderkey')}, o_orderkey LIMIT 1000), l AS (SELECT list(k ORDER BY k) AS l FROM d), s AS (SELECT unnest(list_transform(range(1, {BUCKETS}), lambda b: l[len(l) * b // {BUCKETS} + 1])) AS c FROM l) SELECT CAST(b AS INTEGER) AS bucket, count(*) AS size FROM (SELECT (SELECT count(*) FROM s WHERE c <= o_orderkey) AS b FROM orders) GROUP BY ALL",
    "record_buckets": f"WITH d AS (SELECT o_custkey AS a, o_orderkey AS k FROM orders ORDER BY {_digits("o_custkey || '_' || o_orderkey")}, o_custkey, o_orderkey LIMIT 1000), l AS (SELECT list(a * 1000000000000 + k ORDER BY a, k) AS l FROM d), s AS (SELECT unnest(list_transform(range(1, {BUCKETS}), lambda b: l[len(l) * b // {BUCKETS} + 1])) AS c FROM l) SELECT CAST(b AS INTEGER) AS bucket, count(*) AS size FROM (SELECT (SELECT count(*) FROM s WHERE c <= o_custkey * 1000000000000 + o_orderkey) AS b FROM orders) GROUP BY ALL",
    "splitter_positions": f"WITH o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), s AS (SELECT k FROM o WHERE i IN (SELECT unnest(list_transform(range(1, {BUCKETS}), lambda b: n * b // {BUCKETS})) FROM (SELECT count(*) AS n FROM orders))) SELECT k AS o_orderkey, CAST(c AS INTEGER) AS scanned, CAST(c AS INTEGER) AS halved FROM (SELECT k, (SELECT count(*) FROM s WHERE s.k < o.k) AS c FROM o)",
    "strings_with_ties": "SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS idx, count(*) OVER (PARTITION BY p_name) AS m FROM part",
}

_QUERIES = (
    sa_benchmark_dc3, sa_cli_file, run_statistics, random_text, log_values, level_times, file_presence, dc_slots, dc_map_back, compare_with_lcp,
    bucket_groups, rebalanced, rebalanced_small, largest_bucket_imbalance, record_buckets, splitter_positions,
    sa_per_document, sa_per_part, sa_per_benchmark_item, sa_part_names, sa_part_names_dc7, sa_benchmark_text, sa_benchmark_by_doubling, sa_inverse, sa_int_sequence,
    alphabet_histogram, alphabet_codes, alphabet_compressed, packed_keys,
    dc_samples, dc_ranks, dc_discard_kept, dc_reduced_order, dc_positions_per_residue, dc_sample_order,
    sa_check_ok, sa_check_reversed, sa_check_swapped, sa_check_duplicated, check_sorted_prices, check_unsorted_prices, check_same_orders, check_same_multiset,
    lcp_adjacent, check_lcps, distinguishing_prefix, distinguishing_prefix_documents, front_coding, compare_neighbours,
    zip_index, running_items, shifted, unique_keys, orders_dense_rank, sorted_prices, strings_with_ties, merge_sorted,
    distribute_even, distribute_custom, bucket_major, partition_imbalance, bucket_imbalance, value_summary, chunk_table, chunk_send_counts, interval_sizes, random_bucket_sizes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
