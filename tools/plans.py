"""Print the formatted physical plan of registered queries.

    python tools/plans.py [--sf DIR] name [name ...]

Plans are printed as Spark would run them (AQE may still re-plan joins at
runtime). Queries that materialise intermediate results (checkpoints, median
passes) run those steps while being planned.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="+")
    a = ap.parse_args()
    from retailcast.catalog import QUERIES
    from retailcast.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    for n in a.names:
        print(f"===== {n}")
        QUERIES[n](spark, a.sf).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
