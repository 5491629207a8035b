"""Command line: compare every registered query with its oracle.

    python tests/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanveil.session import build_session  # noqa: E402
from tests.oracle_harness import compare, duck  # noqa: E402


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    import __spark_entry__ as entry
    qs, ors = entry.queries(), entry.oracle_sql()
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for name in (names or sorted(qs)):
        t = time.time()
        if name not in ors:
            n = qs[name](spark, sf_dir).count()
            print(json.dumps({"query": name, "rows_spark": n, "oracle": None, "sec": round(time.time() - t, 2)}))
            continue
        try:
            r = compare(spark, name, qs[name], ors[name], sf_dir, con)
        except Exception as exc:  # report and go on
            r = {"query": name, "error": repr(exc)[:600]}
        r["sec"] = round(time.time() - t, 2)
        ok = r.get("hash_match") and r.get("rows_spark") == r.get("rows_oracle")
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + json.dumps(r, default=str, ensure_ascii=False)[:1500], flush=True)
    print(f"mismatches: {bad}")


if __name__ == "__main__":
    main()
