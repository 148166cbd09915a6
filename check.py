"""Compare every registered query with its SQL: python check.py [sf] [name-part ...]"""

from __future__ import annotations

import sys
import time

from benefica.checking import compare, oracle_connection
from benefica.plans import load
from benefica.session import local_session

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    folder = f"/root/testdata/sf{sf}"
    con = oracle_connection(folder)
    bad = 0
    for name, q in load().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            verdict = compare(q, spark, con, folder)
        except Exception as e:  # report and go on with the next query
            verdict = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += not verdict.startswith("ok")
        print(f"{name:45s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("failed:", bad)
