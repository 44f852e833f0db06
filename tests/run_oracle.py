"""Command line check: python tests/run_oracle.py [sf dir] [name part ...]"""

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, duck  # noqa: E402

from stratalens.session import get_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
parts = sys.argv[2:]
spark = get_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                    spark__driver__memory="12g")
spark.sparkContext.setLogLevel("ERROR")
con = duck(sf)
sqls = entry.oracle_sql()
bad = 0
for name, fn in entry.queries().items():
    if parts and not any(p in name for p in parts):
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        if name in sqls:
            msg = compare(df, con, sqls[name])
        else:
            msg = "" if df.count() > 0 else "no rows"
    except Exception as e:
        msg = f"{type(e).__name__}: {str(e)[:600]}"
        if "-v" in parts or len(parts) == 1:
            traceback.print_exc()
    bad += bool(msg)
    print(f"{'FAIL' if msg else 'ok  '} {name:45s} {time.time() - t:6.2f}s {'' if name in sqls else '(rows only)'} {msg}", flush=True)
print("failed:", bad)
