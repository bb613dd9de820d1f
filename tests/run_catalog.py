"""Ad hoc: python tests/run_catalog.py FOLDER [name-prefix ...] compares queries and prints times."""

import sys
import time
import traceback

sys.path.insert(0, ".")
sys.path.insert(0, "tests")

import __spark_entry__ as e
from assayloom.runtime import local_session
from compare import differences, oracle_connection

folder, wanted = sys.argv[1], sys.argv[2:]
spark = local_session(8)
con = oracle_connection(folder)
sqls = e.oracle_sql()
bad = 0
for name, fn in e.queries().items():
    if wanted and not any(name.startswith(w) for w in wanted):
        continue
    t0 = time.time()
    try:
        df = fn(spark, folder)
        found = differences(df, con, sqls[name]) if name in sqls else [] if df.count() else ["no rows"]
    except Exception as err:
        found = [traceback.format_exc()[-1500:] if "-v" in wanted else f"{type(err).__name__}: {str(err)[:900]}"]
    bad += bool(found)
    print(f"{'BAD' if found else 'ok '} {time.time() - t0:6.2f}s {name}{'' if name in sqls else ' (rows only)'}", *found, sep="\n      " if found else "", flush=True)
print("bad:", bad)
