"""Runs registered queries next to their SQL in DuckDB and compares rows, columns and values.

usage: check_queries.py [-s SF] [name ...]
"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowlens.plans import ORACLES, QUERIES  # noqa: E402
from flowlens.session import session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(repr(r[i]) for i in order) for r in rows]), sorted(columns)


def main(args):
    sf = "0.01"
    if args[:1] == ["-s"]:
        sf, args = args[1], args[2:]
    folder = f"/root/testdata/sf{sf}"
    names = [n for n in QUERIES if not args or any(n.startswith(a) for a in args)]
    spark = session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                    spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    bad = []
    for name in names:
        start = time.time()
        try:
            frame = QUERIES[name](spark, folder)
            got = [tuple(r) for r in frame.collect()]
            columns = frame.columns
        except Exception as error:  # noqa: BLE001
            print(f"FAIL {name}: {str(error)[:1500]}")
            bad.append(name)
            continue
        took = time.time() - start
        if name not in ORACLES:
            print(f"rows {name}: {len(got)} ({took:.1f}s)")
            continue
        try:
            cursor = db.execute(ORACLES[name])
            want = cursor.fetchall()
            names_w = [d[0] for d in cursor.description]
        except Exception as error:  # noqa: BLE001
            print(f"SQL  {name}: {str(error)[:1500]}")
            bad.append(name)
            continue
        a, ca = canonical(got, columns)
        b, cb = canonical(want, names_w)
        if ca != cb or a != b:
            bad.append(name)
            print(f"DIFF {name}: columns {ca if ca != cb else 'equal'} {cb if ca != cb else ''} rows {len(a)} / {len(b)}")
            sa, sb = set(a), set(b)
            print("  only spark", sorted(sa - sb)[:3], len(sa - sb))
            print("  only sql  ", sorted(sb - sa)[:3], len(sb - sa))
        else:
            print(f"ok   {name}: {len(a)} rows ({took:.1f}s)")
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
