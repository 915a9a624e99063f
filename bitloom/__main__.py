"""Command line: compress, extract or compare files with Spark.

    python -m bitloom compress INPUT... OUT [--level N]
    python -m bitloom extract OUT FOLDER_TABLE
    python -m bitloom compare OUT INPUT...

Archives are rows (path, n_bytes, archive) of a Parquet table, so any number of files is one job.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.codec import compress, extract
from .operators.verify import verify
from .sources.archives import read_files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="bitloom")
    verbs = parser.add_subparsers(dest="verb", required=True)
    pack = verbs.add_parser("compress")
    pack.add_argument("inputs", nargs="+")
    pack.add_argument("out")
    pack.add_argument("--level", type=int, default=1, choices=range(1, 13))
    unpack = verbs.add_parser("extract")
    unpack.add_argument("archives")
    unpack.add_argument("out")
    check = verbs.add_parser("compare")
    check.add_argument("archives")
    check.add_argument("inputs", nargs="+")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.verb == "compress":
        files = read_files(spark, args.inputs)
        compress(files, key="path", level=args.level).write.parquet(args.out)
        return 0
    found = extract(spark.read.parquet(args.archives), key="path")
    if args.verb == "extract":
        found.write.parquet(args.out)
        return 0
    verdicts = verify(found, read_files(spark, args.inputs), key="path")
    wrong = verdicts.where(F.col("verdict") != "identical")
    for row in wrong.limit(1000).toLocalIterator():
        print(f"{row.path}: {row.verdict}")
    return int(not wrong.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
