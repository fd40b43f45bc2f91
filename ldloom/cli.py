"""Command line: run | preprocess | simulate | merge, with the options of the flow's two packagings; import | export of stage files of raw doubles."""

from __future__ import annotations

import argparse
import logging
import sys

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .config import MergeConfig, PreprocessConfig, SimulateConfig, StandardConfig
from .plans import chunked, standard
from .sources import stage_files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ldloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        sub = commands.add_parser(name)
        for flag, extra in options:
            sub.add_argument(flag, **extra)

    number, real, on = {"type": int}, {"type": float, "default": 0.01}, {"action": "store_true"}
    shared = [("-vcf", {"required": True}), ("-samples", {"default": ""}), ("-maf", real), ("-ntraits", number | {"default": 10}), ("-seed", number)]
    command("run", *shared, ("-out", {"default": "synthetic.vcf"}), ("-workers", number | {"default": 0}), ("-compress", on))
    command("preprocess", *shared, ("-out", {"required": True}), ("-chunk-size", number | {"default": 10_000}), ("-traits-per-tile", number | {"default": 0}))
    command("simulate", ("-prep", {"required": True}), ("-out", {"required": True}), ("-workers", number | {"default": 0}), ("-compress", on), ("-start-chunk", number | {"default": -1}), ("-end-chunk", number | {"default": -1}))
    command("merge", ("-in", {"required": True, "dest": "chunks"}), ("-out", {"required": True}), ("-no-compress", on), ("-order", {"choices": ["numeric", "lexicographic"], "default": "numeric"}))
    for name in ("import", "export"):
        command(name, ("-in", {"required": True, "dest": "folder"}), ("-out", {"required": True}))
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    logging.basicConfig(level=logging.INFO, stream=sys.stdout)
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("ldloom").getOrCreate()
    try:
        if a.command == "run":
            standard.run_standard(spark, StandardConfig(a.vcf, a.out, a.samples, a.maf, a.ntraits, a.workers, a.compress, a.seed))
        elif a.command == "preprocess":
            chunked.preprocess(spark, PreprocessConfig(a.vcf, a.out, a.samples, a.maf, a.ntraits, a.chunk_size, a.traits_per_tile, a.seed))
        elif a.command == "simulate":
            chunked.simulate(spark, SimulateConfig(a.prep, a.out, a.workers, a.compress, a.start_chunk, a.end_chunk))
        elif a.command == "import":
            stage_files.import_stages(spark, a.folder, a.out)
        elif a.command == "export":
            stage_files.export_stages(spark, a.folder, a.out)
        else:
            chunked.merge(spark, MergeConfig(a.chunks, a.out, not a.no_compress, a.order))
    except (ValueError, OSError, PySparkException, Py4JError) as e:  # settings, files, and what Spark or its file systems raise
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
