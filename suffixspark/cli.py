"""python -m suffixspark.cli --input FILE: suffix array of a file, optionally verified and written."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import add_options, parse_config
from .functions import stats
from .functions.cover import Cover
from .operators import check, suffix_array
from .sources import shared, sinks, text


def arguments(args: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="suffixspark", description=__doc__)
    parser.add_argument("--input", required=True, help="file or folder of files whose bytes are the text")
    parser.add_argument("--output", default="", help="write the suffix array here as 5-byte little-endian numbers, or as parquet if it ends so")
    parser.add_argument("--json-output-path", default="", help="prefix of the timer and counter files")
    parser.add_argument("--iteration", type=int, default=0)
    return add_options(parser).parse_args(args)


def run(spark: SparkSession, args: list[str], keep: bool = False) -> dict:
    """Read, sort, check and write; returns and prints what was measured. Tables in between are deleted unless ``keep``."""
    options, config = arguments(args), parse_config(args)
    if not text.exists(spark, options.input):
        raise FileNotFoundError(options.input)
    measured = stats.restart()
    for name, value in stats.session_flags(spark).items():
        print(f"{name}={value}")
    with stats.phase("total_time", 0):
        with stats.phase("read", 0):
            source = text.read_bytes(spark, options.input, config.chunk, Cover.of(config.modulus).modulus, config.textsize)
        with stats.phase("suffix_array", 0):
            sa = suffix_array.suffix_array(source, config)
    record = {"n": source.n, "iteration": options.iteration, "modulus": config.modulus}
    if config.check:
        with stats.phase("check", 0):
            record["SA_ok"] = bool(check.check_suffix_array(sa, text.characters(source)).first()["ok"])
    if options.output:
        with stats.phase("write", 0):
            (sinks.write_parquet if options.output.endswith(".parquet") else sinks.write_uint40)(sa, options.output)
    if not keep:
        shared.release(spark)
    record |= {"max_rss_kb": measured.peak_kb(), "blowup": stats.blow_up(measured.peak_kb(), source.n * source.width)}
    for line in [*(f"{k}={v}" for k, v in record.items()), *measured.lines()]:
        print(line)
    if options.json_output_path:
        sinks.write_json([{"phase": p, "level": level, "time": t} for p, level, t in measured.records()], f"{options.json_output_path}_timer.json")
        sinks.write_json([{**record, **{f"{c}_{level}": v for (c, level), v in measured.counts.items()}}], f"{options.json_output_path}_counter.json")
    return {**record, **{p: t for p, level, t in measured.records() if level == 0}}


def main() -> int:
    spark = SparkSession.builder.appName("suffixspark").getOrCreate()
    try:
        return 0 if run(spark, sys.argv[1:]).get("SA_ok", True) else 1
    except FileNotFoundError as missing:
        print(f"no such input: {missing}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
