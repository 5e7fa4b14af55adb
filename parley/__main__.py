"""python -m parley descriptor.yaml: runs a descriptor and prints what it did."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import SparkSession

from .plans.descriptor import with_hashes
from .plans.engine import Engine


def main(args: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="parley")
    a.add_argument("descriptor")
    a.add_argument("--verify", action="store_true", help="check the descriptor and stop")
    a.add_argument("--write-hashes", action="store_true", help="put the hashes that were found into the descriptor")
    a.add_argument("--verbose", action="store_true")
    o = a.parse_args(args)
    logging.basicConfig(level=logging.DEBUG if o.verbose else logging.INFO)
    with open(o.descriptor, encoding="utf-8") as f:
        source = f.read()
    spark = SparkSession.builder.appName("parley").getOrCreate()
    engine = Engine(spark, source, os.path.dirname(os.path.abspath(o.descriptor)))
    if wrong := engine.verify():
        print("\n".join(wrong), file=sys.stderr)
        return 1
    if not o.verify:
        r = engine.run()
        if o.write_hashes:
            with open(o.descriptor, "w", encoding="utf-8") as f:
                f.write(with_hashes(source, r.hashes))
        print(json.dumps({"progress": r.progress.to_dict(), "hashes": r.hashes, "warnings": r.warnings}, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
