"""python -m tallyframe prepare | check | models | identify | show | score"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from . import jobs
from .sources.runlog import find_key


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyframe", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *, photos: bool = True) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=about)
        if photos:
            one.add_argument("--photos", required=True, help="directory of photos and their manifest.json")
        return one

    def asking(one: argparse.ArgumentParser) -> None:
        one.add_argument("--endpoint", default=jobs.ENDPOINT)
        one.add_argument("--key-name", default="API_KEY", help="what the key is called in the environment and in settings files")
        one.add_argument("--settings", action="append", default=[], help="a file of NAME=value lines; the first that has the key counts")

    command("prepare", "build or refresh the manifest")
    command("check", "validate the manifest").add_argument("--smoke", action="store_true", help="answers and baselines may be missing")
    asking(command("models", "list the models that can generate content", photos=False))
    one = command("identify", "ask a model about the photos")
    asking(one)
    one.add_argument("--results", required=True)
    one.add_argument("--model", required=True)
    one.add_argument("--no-grounding", action="store_true")
    one.add_argument("--only", metavar="ID")
    one.add_argument("--smoke", action="store_true")
    one.add_argument("--tag", default="unknown", help="what the run is bound to, for its provenance")
    one.add_argument("--stamp", help="go on with the run of this stamp, if it was broken off")
    one.add_argument("--prompt", type=Path, help="a file with another prompt")
    command("show", "what a judge sees of results without a verdict").add_argument("run")
    one = command("score", "force verdicts, take new ones, report")
    one.add_argument("run")
    one.add_argument("--judged", help="a JSON object of people's verdicts by id")
    one.add_argument("--report", action="store_true", help="only report")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, **others: object) -> int:
    """Run a command; others go to the job (a transport, a way to crop, where text goes)."""
    a = parser().parse_args(argv)
    key = None
    if a.command in ("models", "identify") and not (key := find_key(a.key_name, a.settings)):
        others.get("out", print)(f"no key: set {a.key_name}, or name a settings file that has it")
        return 1
    spark = spark or SparkSession.builder.appName("tallyframe").getOrCreate()
    if a.command == "prepare":
        return jobs.prepare(spark, a.photos, **others)
    if a.command == "check":
        return jobs.check(spark, a.photos, a.smoke, **others)
    if a.command == "models":
        return jobs.models(spark, key, a.endpoint, **others)
    if a.command == "identify":
        prompt = a.prompt.read_text() if a.prompt else jobs.PROMPT
        return jobs.identify(spark, a.photos, a.results, a.model, key, a.stamp or time.strftime("%Y%m%d-%H%M%S"), not a.no_grounding, a.only, a.smoke, a.tag, prompt, a.endpoint, **others)
    if a.command == "show":
        return jobs.show(spark, a.run, a.photos, **others)
    return jobs.score(spark, a.run, a.photos, a.judged, a.report, **others)


if __name__ == "__main__":
    sys.exit(main())
