"""Shape of the plans: ``python -m tests.plans [--sf 0.001]`` lists every query whose plan holds an unwanted operator."""

from __future__ import annotations

import sys
import time

from tests.compare import ROOT, session
from wayframe.checks.registry import QUERIES

UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def unwanted(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [u for u in UNWANTED if u in plan]


def main(args: list[str]) -> int:
    import wayframe.checks.all  # noqa: F401
    sf = args[args.index("--sf") + 1] if "--sf" in args else "0.001"
    spark = session()
    bad = 0
    for name, fn in QUERIES.items():
        at = time.time()
        found = unwanted(fn(spark, f"{ROOT}/sf{sf}"))
        if found:
            bad += 1
            print(f"{name}: {found}", flush=True)
        if time.time() - at > 15:
            print(f"{name} took {time.time() - at:.0f}s to build", flush=True)
    print(f"{len(QUERIES)} plans, {bad} unwanted")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
