"""Command line: flash-info, elf, symbols, corpus ingest, list, rm and gc. Paths may be folders or globs of many images."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from firmlake.config import corpus_path, memo_path
from firmlake.errors import FirmlakeError, UsageError
from firmlake.operators import canon, match
from firmlake.operators.corpus import Corpus, listing
from firmlake.plans import report
from firmlake.plans import symbols as plan
from firmlake.shipping import ship
from firmlake.sources import export, flash, harvest
from firmlake.sources.decode import builtin, listed, read_listing


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="firmlake", description=__doc__)
    top.add_argument("--data", help="folder of the corpus")
    top.add_argument("--out", help="write JSON there instead of printing tables")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("flash-info", "elf", "symbols"):
        c = commands.add_parser(name)
        c.add_argument("images")
        c.add_argument("--slot")
        if name == "elf":
            c.add_argument("target", help="Parquet table of ELF files")
        if name == "symbols":
            c.add_argument("--chip", help="only images of this chip; by default each is matched against its own chip's builds")
            c.add_argument("--listing", help="text of another disassembler, read in place of decoding; of one image")
    corpus = commands.add_parser("corpus").add_subparsers(dest="action", required=True)
    ingest = corpus.add_parser("ingest")
    ingest.add_argument("folder")
    ingest.add_argument("--version", help="by default what the folder's marker says")
    for name, default in (("--config", "default"), ("--chip", "esp32"), ("--toolchain", "unknown")):
        ingest.add_argument(name, default=default, help="where the folder has no marker" if name == "--toolchain" else None)
    corpus.add_parser("list").add_argument("--version")
    rm = corpus.add_parser("rm")
    rm.add_argument("--version", required=True)
    rm.add_argument("--config-hash", default="")
    rm.add_argument("--chip")
    rm.add_argument("--yes", action="store_true")
    corpus.add_parser("gc").add_argument("--dry-run", action="store_true")
    return top


def show(df, args) -> None:
    if args.out:
        export.envelope(df, args.command).write.mode("overwrite").text(args.out)
    else:
        print("  ".join(df.columns))
        for row in df.toLocalIterator():  # a partition at a time, however long
            print("  ".join("-" if v is None else str(v) for v in row))


def corpus_command(spark: SparkSession, args) -> None:
    corpus = Corpus(spark, corpus_path(args.data))
    if args.action == "list":
        show(listing(corpus.builds(), corpus.functions(), canon.VERSION, args.version).drop("config_text"), args)
    elif args.action == "rm":
        build = corpus.select_one(args.version, args.config_hash, args.chip)
        n = corpus.remove(build, dry=not args.yes)
        print(f"{n} functions of build {build}" + (" removed" if args.yes else "; repeat with --yes to remove them"))
    elif args.action == "gc":
        builds, n = corpus.collect_stale(canon.VERSION, args.dry_run)
        print(f"{builds} stale builds with {n} functions" + ("" if args.dry_run else " removed"))
    else:
        files = harvest.artifacts(spark, args.folder)
        found = harvest.signatures(harvest.harvested(files), names=harvest.function_names(files)).withColumn("build_key", F.lit("b")).cache()
        told, doubts = harvest.about(spark, args.folder)
        version = args.version or told["version"]
        if not version:
            raise UsageError("the folder doesn't say which version was built: give --version")
        text = told["config_text"] + "".join(f"\nlibrary {x}" for x in told["libraries"])
        row = ("b", version, args.config, text, args.chip, told["toolchain"] or args.toolchain, canon.VERSION, told["toolchain"])
        corpus.add(spark.createDataFrame([row], "build_key string, idf_version string, config_name string, config_text string, chip string, toolchain string, canon_version int, objdump_version string"), found)
        show(match.top_with_other(found.groupBy(F.coalesce("component", F.lit("-")).alias("component")).agg(F.count("*").alias("n")), "component", 25, "component"), args)
        print(match.duplicate_digests(found).count(), "digests have more than one name")
        for doubt in doubts:
            print(f"warning: {doubt}")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("firmlake").getOrCreate()
    ship(spark)
    try:
        if args.command == "corpus":
            corpus_command(spark, args)
            return 0
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(args.images).select("path", "content")
        if args.command == "flash-info":
            show(flash.parse(files, args.slot), args)
        elif args.command == "elf":
            parsed = flash.parse(files, args.slot)
            export.elf_files(flash.segment_bytes(parsed, files)).write.mode("overwrite").parquet(args.target)
        else:
            decoder = listed(read_listing(spark.read.text(args.listing))) if args.listing else builtin
            memo = None if args.listing else memo_path(args.data)
            out = plan.symbols(plan.analysed(files, args.slot, decoder, memo), Corpus(spark, corpus_path(args.data)), args.chip)
            if args.out:
                for name in ("identified", "unidentified", "regions", "summary", "by_component", "warnings"):
                    show(out[name], argparse.Namespace(out=f"{args.out}/{name}", command="symbols"))
            else:
                for row in report.lines(out).toLocalIterator():
                    print(f"{row.image}  {row.line}")
    except FirmlakeError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code
    return 0


if __name__ == "__main__":
    sys.exit(main())
