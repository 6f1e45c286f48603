"""Run registered queries against their check SQL: python tests/run_checks.py [sf_dir] [name-part …]."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from rankloom.session import clear_folders, local_session  # noqa: E402
from tests.compare import connect, difference  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = local_session("8")
    con = connect(sf_dir)
    checks, failed = oracle_sql(), []
    for name, fn in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in checks:
                problem = difference(df, con, checks[name])
                note = f"{df.count()} rows" if parts else ""
            else:
                problem, note = None, f"{df.count()} rows, no check"
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem, note = f"{type(exc).__name__}: {str(exc)[:900]}", ""
            if parts:
                traceback.print_exc()
        clear_folders(spark)
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {note} {problem or ''}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
