"""python -m siftline PATH...: findings as lines of JSON; faults on stderr; exit code 1 if there is a finding."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from siftline.plans.scan import ordered, scan_files
from siftline.sources.files import path_table


def main(paths: list[str]) -> int:
    if not paths:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("siftline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    found, errors = scan_files(spark, paths)
    seen = 0
    for row in ordered(found, path_table(spark, paths)).toJSON().toLocalIterator():
        print(row)
        seen = 1
    for e in errors.toLocalIterator():
        print(f"{e.stage}: {e.file}: {e.message}", file=sys.stderr)
    return seen


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
