"""Run registered queries against their oracles: ``python tests/check_oracles.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from studylake import get_session  # noqa: E402
from tests.compare import connect, differences  # noqa: E402


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, bad = E.oracle_sql(), 0
    for name, fn in E.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                diff = differences(df, oracles[name], con)
                state = "ok" if not diff else "DIFF " + " | ".join(diff)
            else:
                state = f"rows only: {df.count()}"
        except Exception as exc:  # noqa: BLE001
            state = "ERROR " + "".join(traceback.format_exception_only(exc))[:900]
        bad += state.startswith(("DIFF", "ERROR"))
        print(f"{name:34s} {time.time() - start:6.1f}s {state[:1500]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
