"""Command line: python -m vocalith MODE --snapshot FILES [--delta FILE] [--out FOLDER]."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vocalith.plans import services
from vocalith.sources import sinks

MODES = ("classify", "rf2-to-owl", "rf2-stated-to-complete-owl", "rf2-stated-to-complete-owl-reconcile", "rf2-owl-to-stated", "rf2-extract")


def files(text: str) -> list[str]:
    if text.startswith(",") or text.endswith(","):
        raise argparse.ArgumentTypeError("a list of files has no comma at either end")
    for path in (found := text.split(",")):
        if "://" not in path and not os.path.exists(path):
            raise argparse.ArgumentTypeError(f"{path} isn't there")
    return found


def parsed(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="vocalith")
    p.add_argument("mode", choices=MODES, nargs="?", default="rf2-to-owl")
    p.add_argument("--snapshot", type=files, required=True, help="folders or zip files, with commas between")
    p.add_argument("--delta", type=files, help="one folder or zip file")
    p.add_argument("--uri", help="address of the ontology; by default its header row's")
    p.add_argument("--version", default=f"{date.today():%Y%m%d}")
    p.add_argument("--without-annotations", action="store_true")
    p.add_argument("--reasoner", default="el", choices=sorted(services.REASONERS))
    p.add_argument("--concepts", help="a file of concept ids, one on each line, to extract")
    p.add_argument("--zip", action="store_true", help="one zip file of a classification's results or of an extract, not folders")
    p.add_argument("--out", default="results")
    a = p.parse_args(args)
    if a.delta and len(a.delta) != 1:
        p.error("there can be one delta")
    if a.mode.endswith("reconcile") and len(a.snapshot) != 2:
        p.error("reconcile needs two snapshots, of the authoring cycle and the published one")
    if a.mode == "rf2-extract" and not a.concepts:
        p.error("an extract needs a file of concepts")
    return a


def main(args: list[str]) -> None:
    a = parsed(args)
    delta = a.delta[0] if a.delta else None
    spark = SparkSession.builder.appName("vocalith").getOrCreate()
    if a.mode == "classify":
        result = services.classify(spark, a.snapshot, delta, a.reasoner)
        sinks.write_archive(result, a.out) if a.zip else sinks.write_results(result, a.out)
    elif a.mode == "rf2-to-owl":
        sinks.write_document(services.to_owl(spark, a.snapshot, delta, a.uri, a.version, not a.without_annotations), a.out)
    elif a.mode == "rf2-stated-to-complete-owl" and len(a.snapshot) == 1:
        retired, made = services.stated_to_owl(spark, a.snapshot[0], delta)
        sinks.write_lines(retired, f"{a.out}/stated", sinks.DELTA, ["id"])
        sinks.write_lines(made, f"{a.out}/axioms", sinks.AXIOM, ["part", "component", "row"])
    elif a.mode == "rf2-stated-to-complete-owl":
        made, retired, left = services.stated_to_owl_extension(spark, *a.snapshot[:2], delta)
        sinks.write_lines(made, f"{a.out}/axioms", sinks.AXIOM, ["component", "row"])
        sinks.write_lines(retired, f"{a.out}/stated", sinks.DELTA, ["sourceId", "id"])
        sinks.write_lines(left, f"{a.out}/not_converted", sinks.DELTA, ["sourceId", "id"])
    elif a.mode.endswith("reconcile"):
        sinks.write_lines(services.reconcile(spark, a.snapshot[0], delta, a.snapshot[1]), f"{a.out}/axioms", sinks.AXIOM, ["component", "row"])
    elif a.mode == "rf2-extract":
        ids = spark.read.text(a.concepts).select(F.trim("value").try_cast("long").alias("id")).filter("id is not null")
        parts = services.extract(spark, a.snapshot, ids)
        sinks.write_extract_archive(parts, a.out) if a.zip else sinks.write_extract(parts, a.out)
    else:
        sinks.write_lines(services.axioms_to_stated(spark, a.snapshot, delta), a.out, sinks.DELTA, ["sourceId", "grp", "place"])


def run() -> None:
    main(sys.argv[1:])


if __name__ == "__main__":
    run()
