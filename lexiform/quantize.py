"""Quantize a model's container: python -m lexiform.quantize IN OUT FORMAT. A failure's exit code isn't 0."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lexiform.sources import container


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexiform.quantize", description="Store a model's matrices in blocks.")
    parser.add_argument("source", help="a container on any file system of the session")
    parser.add_argument("target", help="where to write; what is there is replaced")
    parser.add_argument("format", type=str.upper, choices=sorted(container.BLOCKS))
    asked = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    try:
        out, report = container.quantize(container.load(spark, asked.source), asked.format)
        container.save(spark, asked.target, out)
    except Exception as e:
        print(f"{asked.source}: {e}", file=sys.stderr)
        return 1
    for name, before, after, bins in report:
        print(f"{name}: {before} -> {after} bytes, codes {' '.join(f'{share:.3f}' for share in bins)}")
    print(f"total: {sum(r[1] for r in report)} -> {sum(r[2] for r in report)} bytes")
    return 0


if __name__ == "__main__":
    sys.exit(main())
