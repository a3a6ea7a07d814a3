"""python -m deltarule.run PROGRAM FACTS OUT [SEP]: runs a rule file over a folder of facts.

Each input relation is read from FACTS/<relation>.csv (missing: empty); each output is
written to OUT/<relation>. Prints the times of loading and running, and all sizes.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from deltarule.parser import parse_dl
from deltarule.program import Program
from deltarule.sources.files import read_delimited, sizes, write_csv


def main(program: str, facts: str, out: str, sep: str = ",") -> None:
    spark = SparkSession.builder.getOrCreate()
    text = Path(program).read_text()
    made = Program(parse_dl(text)) if program.endswith(".dl") else Program.parse(text)
    found = made.resolve()
    began = time.perf_counter()
    inputs = {n: read_delimited(spark, f"{facts}/{n}.csv", [c.name for c in found.relations[n].columns], sep) for n in found.inputs if found.relations[n].columns}
    print(f"Data loaded in {time.perf_counter() - began:.3f} s")
    began = time.perf_counter()
    results = made.run(spark, inputs)
    for name, rows in results.items():
        write_csv(rows, f"{out}/{name}", sep)
    print(f"Rules executed in {time.perf_counter() - began:.3f} s")
    print(*sizes(results), sep="\n")
    if made.tree.profile:
        print(*results.metrics, sep="\n")


if __name__ == "__main__":
    main(*sys.argv[1:])
