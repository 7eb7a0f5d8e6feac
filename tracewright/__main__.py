"""Compile chunks from the command line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .engine import Engine, Project


def main() -> int:
    p = argparse.ArgumentParser(prog="tracewright")
    p.add_argument("--source-dir", default=".")
    p.add_argument("--name", default="project")
    p.add_argument("--workspace", default="workspace")
    p.add_argument("--driver", default="linux")
    p.add_argument("--chunks")
    a = p.parse_args()
    engine = Engine(SparkSession.builder.appName("tracewright").getOrCreate())
    result = engine.compile(Project(a.name, a.source_dir, a.workspace), a.driver, a.chunks)
    print(json.dumps(result.as_dict(), indent=2))
    return int(not result.success)


if __name__ == "__main__":
    raise SystemExit(main())
