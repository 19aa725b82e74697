"""Check registered queries against their SQL: python tests/check.py [sf] [name-prefix ...]."""

import sys
import time
import traceback

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

from compare import difference, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tideglass.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                diff = difference(df, con, oracles[name])
            else:
                diff = None
                rows = df.count()
            mark = "ok  " if diff is None else "DIFF"
            note = "" if name in oracles else f" (rows only: {rows})"
        except Exception as error:  # noqa: BLE001
            mark, diff, note = "FAIL", str(error)[:1500], ""
            if "-v" in prefixes:
                traceback.print_exc()
        bad += mark != "ok  "
        print(f"{mark} {name} {time.time() - start:.1f}s{note}" + (f"\n     {diff}" if diff else ""), flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
