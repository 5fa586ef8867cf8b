"""python tests/check.py [sf] [prefix ...]: compare registered queries with DuckDB and time them."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import connect, difference  # noqa: E402
from tidemark.plans import load  # noqa: E402
from tidemark.session import local_session  # noqa: E402

if __name__ == "__main__":
    scale, prefixes = sys.argv[1], sys.argv[2:]
    folder = f"/root/testdata/sf{scale}"
    spark, db = local_session(), connect(folder)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, item in load().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            problem = difference(name, item, spark, folder, db)
        except Exception as error:
            problem = f"{name}: {type(error).__name__} {str(error)[:700]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {name}", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print("failures:", bad)
