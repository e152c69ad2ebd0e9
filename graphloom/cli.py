"""Command line: python -m graphloom.cli -m mapping.ttl -o out"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .api import execute_plan, make_plan
from .mapping.model import MappingError
from .plans.planner import Plan
from .rdf.turtle import TurtleError
from .sinks import print_lines, write_lines


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom", description="RDF from tables and JSON by a declarative mapping")
    p.add_argument("-m", "--mapping", help="mapping in Turtle: a file or the text itself")
    p.add_argument("-o", "--output", help="folder for N-Triples or N-Quads; without it they are printed")
    p.add_argument("-b", "--base", help="base IRI")
    p.add_argument("-v", "--verbose", action="store_true", help="tell the number of rules and the time taken")
    p.add_argument("-gp", "--generate-plan", action="store_true", help="print the plan as JSON instead of running it")
    p.add_argument("-p", "--plan", help="a plan's JSON, or a file that holds it")
    p.add_argument("--continue-on-error", action="store_true", help="leave out rows that give an invalid IRI")
    p.add_argument("--single-file", action="store_true", help="write one part")
    for name in ("--no-threading", "--no-const-folding", "--no-ordering"):
        p.add_argument(name, action="store_true", help="accepted; without effect")
    a = p.parse_args(argv)
    if not a.mapping and not a.plan:
        p.error("a mapping or a plan is needed")
    try:
        if a.plan:
            text = a.plan
            if not text.lstrip().startswith("{"):
                with open(text, encoding="utf-8") as f:
                    text = f.read()
            plan = Plan.from_json(text)
        else:
            plan = make_plan(a.mapping, a.base)
        if a.generate_plan:
            print(plan.to_json())
            return 0
        spark = SparkSession.builder.appName("graphloom").getOrCreate()
        began = time.time()
        quads = execute_plan(spark, plan, on_error="skip" if a.continue_on_error else "fail")
        if a.output:
            write_lines(quads, a.output, single_file=a.single_file)
        else:
            print_lines(quads)
        if a.verbose:
            print(f"{len(plan.rules())} rules in {len(plan.groups)} groups, {time.time() - began:.1f} s", file=sys.stderr)
    except (MappingError, TurtleError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
