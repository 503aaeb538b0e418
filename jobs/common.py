"""What the jobs share: config files, a log, and the command line that makes and stops a session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("quillstone.jobs")


def defaults(job: str) -> dict:
    """The settings that come with a job."""
    return json.loads(Path(__file__).with_name(f"{job}.json").read_text())


def settings(spark: SparkSession, job: str, path: str | None) -> dict:
    """The settings of ``path`` over those that come with the job; a key that the job doesn't know is an error."""
    known = defaults(job)
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    unknown = set(given) - set(known)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return known | given


def main(job: str, about: str, run: Callable, paths: dict[str, str]) -> None:
    """Command line: a required option for each of ``paths`` (name: help), and --config."""
    parser = argparse.ArgumentParser(description=about)
    for name, told in paths.items():
        parser.add_argument(f"--{name}", required=True, help=told)
    parser.add_argument("--config", help="JSON file with settings that differ from those that come with the job")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        run(spark, *(args[name] for name in paths), settings(spark, job, args["config"]))
    finally:
        spark.stop()
