"""Compare queries with their SQL: python tests/check_all.py SF_DIR [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from logtrail.session import build_session  # noqa: E402


def main(sf_dir, names):
    spark = build_session(
        master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = duck(sf_dir), entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            if name in oracles:
                got, expected, diff = compare(fn(spark, sf_dir), con, oracles[name])
                verdict = "ok" if not diff else f"DIFF {diff}"
            else:
                got, expected, verdict = fn(spark, sf_dir).count(), "-", "rows only"
        except Exception as exc:  # noqa: BLE001
            got, expected, verdict = "-", "-", f"ERROR {str(exc)[:1500]}"
        if verdict[:2] not in ("ok", "ro"):
            bad.append(name)
        print(f"{name:28s} {time.time() - began:6.2f}s {got} {expected} {verdict}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], set(sys.argv[2:]))
