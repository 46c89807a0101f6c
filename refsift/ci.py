"""A build step: check the files that a pattern names, and report totals to the build.

Settings come from the environment, as build systems pass them: INPUT_FILES
(shell-like patterns), INPUT_FIRST, INPUT_SECOND, INPUT_WORKS (snapshots),
INPUT_FAIL_UNDER, INPUT_STRICT. Totals go to the file that GITHUB_OUTPUT names.
"""
from __future__ import annotations

import json
import os
import sys
import tempfile

from pyspark.sql import SparkSession

from . import cli
from .sinks import report
from .sources import documents

OPTIONS = {"INPUT_FIRST": "--first", "INPUT_SECOND": "--second", "INPUT_ARXIV": "--arxiv", "INPUT_WORKS": "--works", "INPUT_FAIL_UNDER": "--fail-under"}


def arguments(files: list[str], env: dict[str, str]) -> list[str]:
    given = [x for name, option in OPTIONS.items() if env.get(name) for x in (option, env[name])]
    return [*files, *given, *(["--strict"] if env.get("INPUT_STRICT", "").lower() == "true" else [])]


def main(env: dict[str, str] | None = None) -> int:
    env = dict(os.environ) if env is None else env
    spark = SparkSession.builder.appName("refsift").getOrCreate()
    try:
        files = documents.expand(spark, env.get("INPUT_FILES", ""))
    except ValueError as e:
        print(f"refsift: {e}", file=sys.stderr)
        return 2
    if not files:
        print("refsift: no files are named", file=sys.stderr)
        return 2
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "report.json")
        code = cli.main([*arguments(files, env), "--format", "json", "--output", path, "--quiet"])
        if code != 2 and env.get("GITHUB_OUTPUT"):
            with open(path, encoding="utf-8") as f:
                found = report.outputs(json.load(f)["findings"])
            with open(env["GITHUB_OUTPUT"], "a", encoding="utf-8") as f:
                f.writelines(f"{name}={value}\n" for name, value in found.items())
    return code


if __name__ == "__main__":
    sys.exit(main())
