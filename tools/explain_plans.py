"""Print the formatted physical plan of registered queries.

    python tools/explain_plans.py [sf_dir] name [name ...]

Use it to check that filters reach the scan (PushedFilters /
PartitionFilters), that only used columns are read (ReadSchema), and which
join strategies and exchanges Spark picked. Note: the ordered operators
(LED-1, sessions, lockouts) run their range-partition checkpoint while the
plan is built, so explaining them executes that step.
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if a != sf_dir]
    from shelfspark.plans.catalog import REGISTRY
    from shelfspark.session import build_session

    spark = build_session("local[8]", shuffle_partitions=16)
    for name in names or sorted(REGISTRY):
        print(f"===== {name} =====")
        REGISTRY[name].run(spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main()
