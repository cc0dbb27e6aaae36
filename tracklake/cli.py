"""Command line: create-dataset, call-peaks, combine-metadata."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracklake")
    top.add_argument("--version", action="version", version=VERSION)
    sub = top.add_subparsers(dest="command", required=True)
    create = sub.add_parser("create-dataset", help="build a study from alignment, methylation and variant files")
    create.add_argument("--output", required=True)
    for kind, what in (("bam", "alignments"), ("methylation", "methylation files, told apart by their names"), ("vcf", "variants")):
        create.add_argument(f"--{kind}", help=f"{what}, comma-separated")
        create.add_argument(f"--{kind}-names", help="sample names, comma-separated")
    create.add_argument("--metadata", help="file of sample metadata")
    create.add_argument("--filter-chromosomes", action=argparse.BooleanOptionalAction, default=True)
    create.add_argument("--compression", choices=("default", "fast", "none"), default="default")
    create.add_argument("--chromsizes", help="file of contig sizes; else the header of the first file")
    create.add_argument("--stranded", help="library type, or a JSON list or mapping")
    create.add_argument("--overwrite", action="store_true")
    create.add_argument("--resume", action="store_true")
    call = sub.add_parser("call-peaks", help="quantile peaks of bigWig files")
    call.add_argument("--bigwig-dir", required=True)
    call.add_argument("--output-dir", required=True)
    call.add_argument("--chromsizes", required=True)
    call.add_argument("--blacklist")
    call.add_argument("--tilesize", type=int, default=128)
    call.add_argument("--quantile", type=float, default=0.98)
    call.add_argument("--merge", action=argparse.BooleanOptionalAction, default=True)
    combine = sub.add_parser("combine-metadata", help="join metadata files")
    combine.add_argument("files", nargs="+")
    combine.add_argument("--output", required=True)
    return top


def _write_lines(rows, path: str) -> None:
    """Tab-separated rows as one file, written as they come from Spark."""
    with open(path, "w", encoding="utf-8") as f:
        for row in rows.toLocalIterator():
            f.write("\t".join(map(str, row)) + "\n")


def run(args: argparse.Namespace) -> None:
    from pyspark.sql import functions as F

    from .build import create_dataset
    from .operators import peaks
    from .session import session
    from .sources import bigwig, text

    spark = session()
    if args.command == "create-dataset":
        listed = lambda value: value.split(",") if value else []
        kinds = text.classify_methylation(listed(args.methylation))
        stranded = json.loads(args.stranded) if args.stranded and args.stranded[0] in "[{" else args.stranded
        given = listed(args.methylation_names) or None
        present = [k for k in ("bedgraph", "cx", "mc") if kinds[k] or k == "mc" and kinds["hmc"]]
        if given and len(present) > 1:
            raise ValueError("names can be given for methylation files of one kind only")
        create_dataset(
            spark, args.output, args.chromsizes, args.metadata, stranded, args.filter_chromosomes, args.overwrite, args.resume, args.compression,
            bam_files=listed(args.bam), bam_names=listed(args.bam_names) or None, vcf_files=listed(args.vcf), vcf_names=listed(args.vcf_names) or None,
            bedgraph_files=kinds["bedgraph"], cx_files=kinds["cx"], mc_files=kinds["mc"], hmc_files=kinds["hmc"],
            **({{"bedgraph": "bedgraph_names", "cx": "cx_names", "mc": "split_names"}[present[0]]: given} if given and present else {}),
        )
    elif args.command == "call-peaks":
        listed = sorted(f for f in os.listdir(args.bigwig_dir) if f.endswith((".bw", ".bigWig")))
        if not listed:
            raise ValueError(f"no bigWig file in {args.bigwig_dir}")
        found = None
        for name in listed:
            rows = bigwig.read_bigwig(spark, os.path.join(args.bigwig_dir, name)).withColumn("sample", F.lit(name.rsplit(".", 1)[0]))
            found = rows if found is None else found.unionByName(rows)
        black = text.read_bed(spark, args.blacklist) if args.blacklist else None
        called, logged = peaks.call_peaks(found, text.read_chromsizes(spark, args.chromsizes), args.tilesize, args.quantile, black, args.merge)
        logged.write.mode("overwrite").parquet(os.path.join(args.output_dir, f"logged_rpkm_{args.tilesize}bp.parquet"))
        for name in (n.rsplit(".", 1)[0] for n in listed):
            own = called.where(F.col("sample") == name).select("contig", "start", "end").orderBy("contig", "start")
            _write_lines(own, os.path.join(args.output_dir, f"{name}.bed"))
    else:
        text.combine_metadata(spark, args.files).toPandas().to_csv(args.output, index=False)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        run(args)
    except Exception:
        logging.exception("%s failed", args.command)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
