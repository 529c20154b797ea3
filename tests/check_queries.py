"""Check queries against their SQL from the command line: ``python tests/check_queries.py [folder] [name ...]``."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pairloom.plans.registry import Tables, load_all  # noqa: E402
from pairloom.session import local_session  # noqa: E402
from tests.compare import connect, differences  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = local_session("8")
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
bad = 0
for name, q in load_all().items():
    if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) or q.run.__module__.endswith("." + n) for n in names):
        continue
    start = time.time()
    try:
        df = q.run(Tables(spark, folder))
        if q.sql:
            problem = differences(df, con, q.sql)
            note = ""
        else:
            rows = df.collect()
            problem, note = (None if rows else "no rows"), f"{len(rows)} rows, e.g. {str(rows[0])[:150]}" if rows else ""
    except Exception as e:  # noqa: BLE001
        problem = "".join(traceback.format_exception_only(e))[:1500] + traceback.format_exc()[-700:] * (type(e).__name__ not in ("AnalysisException",))
        note = ""
    bad += problem is not None
    print(f"{'ok ' if problem is None else 'BAD'} {name:26s} {time.time() - start:6.2f}s {problem or note}", flush=True)
print(f"{bad} bad")
