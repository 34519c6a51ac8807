"""Local twin of the driver's correctness gate.

usage: python scripts/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import sys

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from otgraph.plans.verify import check
    from otgraph.session import local_session
    spark = local_session(8, 8)
    bad = check(spark, sf, sys.argv[2:])
    print("bad:", len(bad), bad)
    spark.stop()


if __name__ == "__main__":
    main()
