"""Command line: list the queries, show a plan, or write results of some of them.

    python -m caudal.cli list
    python -m caudal.cli explain cri_supplier --data DIR
    python -m caudal.cli run p4_found cri_supplier --data DIR --out DIR [--resume] [--markdown]
"""

from __future__ import annotations

import argparse
import importlib
import time

from caudal.session import local_session
from caudal.sources import sinks

PLANS = ["data_problems", "evaluation", "facts", "files", "identity", "models", "network", "reports", "warehouse"]


def load(optional: list[str] = ()) -> dict:
    """All registered queries; ``optional`` names modules with a QUERIES table that may be missing."""
    for p in PLANS:
        importlib.import_module(f"caudal.plans.{p}")
    from caudal.plans import registry

    found = dict(registry.QUERIES)
    for name in optional:
        try:
            found |= importlib.import_module(name).QUERIES
        except ImportError:
            pass
    return found


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="caudal")
    p.add_argument("what", choices=["list", "explain", "run"])
    p.add_argument("names", nargs="*")
    p.add_argument("--data")
    p.add_argument("--out")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--markdown", action="store_true")
    p.add_argument("--more", action="append", default=[], help="module with further QUERIES")
    a = p.parse_args(argv)
    queries = load(a.more)
    if a.what == "list":
        print("\n".join(sorted(queries)))
        return 0
    unknown = [n for n in a.names if n not in queries]
    if unknown or not a.names or not a.data or (a.what == "run" and not a.out):
        p.error(f"unknown: {', '.join(unknown)}" if unknown else "names, --data and, to run, --out are needed")
    spark = local_session()
    for n in a.names:
        t = time.time()
        df = queries[n](spark, a.data)
        if a.what == "explain":
            df.explain("formatted")
        elif sinks.write_parquet(df, f"{a.out}/{n}", resume=a.resume):
            print(f"{n}: {time.time() - t:.1f} s")
            if a.markdown:
                print(sinks.to_markdown(spark.read.parquet(f"{a.out}/{n}")))
        else:
            print(f"{n}: kept")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
