"""python -m plumbline ROOT [--output FILE] [--exclude DIR ...] [--expand-stars] [--all-languages]: scans the Python files below ROOT into JSON."""

from __future__ import annotations

import argparse
import sys

from .functions.frontends import FRONT_ENDS
from .plans.scan import scan_codebase
from .sources.files import EmptyScan, guarded, source_files
from .sources.sinks import write_json


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    parser.add_argument("root")
    parser.add_argument("--output")
    parser.add_argument("--exclude", nargs="*", default=[])
    parser.add_argument("--expand-stars", action="store_true", help="count the names that star imports bring as imported")
    parser.add_argument("--all-languages", action="store_true", help="scan the files of every front end, not Python alone")
    args = parser.parse_args(argv)
    front_ends = FRONT_ENDS if args.all_languages else None
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    try:
        guarded(source_files(spark, args.root, set(args.exclude), suffixes=tuple(front_ends or (".py",))))
    except EmptyScan as e:
        print(e, file=sys.stderr)
        return 1
    text = write_json(scan_codebase(spark, args.root, set(args.exclude), expand_stars=args.expand_stars, front_ends=front_ends), args.output)
    if not args.output:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
