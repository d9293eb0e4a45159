"""Command line: generate and validate."""

from __future__ import annotations

import argparse
import logging
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import Filter, check_paired
from .plans.generate import check_arguments, generate, split_pairs
from .plans.report import render
from .plans.validate import validate
from .sources.text import read_paired_seeds, read_sequences

USAGE = "usage: oligoframe {generate,validate} [options]\n       oligoframe --version | --help\n"


def session(cpus: int | None) -> SparkSession:
    """The session of spark-submit, or a local one."""
    builder = SparkSession.builder.appName("oligoframe").config("spark.sql.session.timeZone", "UTC")
    if SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{cpus or '*'}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(2 * (cpus or 8)))
    return builder.getOrCreate()


def log_to(folder: Path, name: str) -> logging.Logger:
    folder.mkdir(parents=True, exist_ok=True)
    log = logging.getLogger(f"oligoframe.{name}")
    log.setLevel(logging.INFO)
    log.handlers = [logging.FileHandler(folder / f"{name}_{datetime.now():%Y%m%d_%H%M%S}.log"), logging.StreamHandler(sys.stdout)]
    return log


def shared_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--gc-min", type=float, default=0.4)
    p.add_argument("--gc-max", type=float, default=0.6)
    p.add_argument("--homopolymer-max", type=int, default=2)
    p.add_argument("--min-distance", type=int, default=3)
    p.add_argument("--cpus", type=int)
    p.add_argument("--output-dir", default="test")


def write_lines(rows: DataFrame, path: Path) -> None:
    """A plain file, streamed partition by partition."""
    with path.open("w") as f:
        for r in rows.toLocalIterator():
            f.write(r[0] + "\n")


def generate_main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="oligoframe generate")
    p.add_argument("--count", type=int, required=True)
    p.add_argument("--length", type=int, required=True)
    shared_options(p)
    p.add_argument("--output-prefix", default="barcodes")
    p.add_argument("--seeds", nargs="+")
    p.add_argument("--paired", action="store_true")
    p.add_argument("--paired-seed1")
    p.add_argument("--paired-seed2")
    p.add_argument("--random-seed", default="0")
    a = p.parse_args(argv)
    f = Filter(a.gc_min, a.gc_max, a.homopolymer_max, a.min_distance)
    check_paired(a.paired, a.seeds, a.paired_seed1, a.paired_seed2)
    spark, out = session(a.cpus), Path(a.output_dir)
    log = log_to(out, "generate_barcodes")
    seeds = None
    if a.seeds:
        seeds = read_sequences(spark, a.seeds).sequences
    elif a.paired_seed1:
        seeds = read_paired_seeds(spark, a.paired_seed1, a.paired_seed2)
    n, span = 0, None
    if seeds is not None:
        n, *low_high = seeds.agg(F.count(F.lit(1)), F.min("len"), F.max("len")).first()
        span = tuple(low_high)
    for line in check_arguments(a.count, a.length, f, n, span, a.paired):
        log.warning(line)
    library = generate(spark, a.count, a.length, f, a.random_seed, seeds, a.paired)
    rows = library.sequences
    if a.paired:
        fresh = split_pairs(rows.filter("role = 'new'"), a.random_seed)
        old = rows.filter("role = 'seed'").select("id", "seq")
        for side in (1, 2):
            own = old.filter(F.col("id") < n // 2 if side == 1 else F.col("id") >= n // 2).select(F.lit(0).alias("part"), "id", "seq")
            both = own.union(fresh.filter(F.col("side") == side).select(F.lit(1), "pair_id", "seq"))
            write_lines(both.orderBy("part", "id").select("seq"), out / f"{a.output_prefix}_paired{side}.txt")
    else:
        write_lines(rows.orderBy("id").select("seq"), out / f"{a.output_prefix}.txt")
    made = rows.filter("role = 'new'").count()
    for k, (looked, got) in enumerate(library.rounds, 1):
        log.info(f"Chunk {k}: {got} of {looked} rows of the stream accepted")
    log.info(f"Successfully generated {made} barcodes" if library.complete else f"Stopped at {made} barcodes: no room was found for more")
    return 0 if library.complete else 1


def validate_main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="oligoframe validate")
    p.add_argument("--input", nargs="+", required=True)
    shared_options(p)
    p.add_argument("--skip-distance", action="store_true")
    p.add_argument("--always-exit-0", action="store_true")
    a = p.parse_args(argv)
    f = Filter(a.gc_min, a.gc_max, a.homopolymer_max, a.min_distance)
    spark, out = session(a.cpus), Path(a.output_dir)
    log = log_to(out, "validate_barcodes")
    found = read_sequences(spark, a.input)
    for r in found.rejects.orderBy("file", "line").toLocalIterator():
        log.warning(f"Skipped {r['file']} line {r['line']}: {r['value']}")
    for r in found.length_histogram().collect():
        log.info(f"Length {r['len']}: {r['n']} sequences")
    longest = found.sequences.agg(F.max("len")).first()[0]
    if f.homopolymer_max >= longest or f.min_distance >= longest:
        raise ValueError(f"homopolymer_max and min_distance must be less than the longest length {longest}")
    result = validate(found.sequences, f, a.skip_distance)
    text = render(result, f, a.input)
    (out / f"validation_report_{datetime.now():%Y%m%d_%H%M%S}.txt").write_text(text)
    log.info(text.splitlines()[-1])
    return 0 if result.overall_valid or a.always_exit_0 else 1


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv and argv[0] in ("-v", "--version"):
        print(__version__)
        return 0
    if not argv or argv[0] in ("-h", "--help"):
        print(USAGE, file=sys.stderr)
        return 0
    commands = {"generate": generate_main, "validate": validate_main}
    if argv[0] not in commands:
        print(f"Unknown subcommand: {argv[0]}\n\n{USAGE}", file=sys.stderr)
        return 2
    return commands[argv[0]](argv[1:])


if __name__ == "__main__":
    sys.exit(main())
