"""Compare every query with its SQL on one scale factor: python tests/oracle_check.py [dir] [names…]"""

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from sqlcorpus.session import build_session  # noqa: E402


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def database(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def differs(spark, con, sf_dir, name):
    """None if both engines agree, else what they disagree on."""
    df = contract.queries()[name](spark, sf_dir)
    names, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in contract.oracle_sql():
        return f"no SQL ({len(got)} rows)"
    cursor = con.cursor().execute(contract.oracle_sql()[name])
    wanted_names, wanted = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if names != wanted_names:
        return f"columns {names} / {wanted_names}"
    if len(got) != len(wanted):
        return f"rows {len(got)} / {len(wanted)}"
    for a, b in zip(got, wanted):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{str(a)[:300]} / {str(b)[:300]}"
    return None


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(contract.queries())
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = database(sf_dir), 0
    for name in chosen:
        start = time.time()
        try:
            problem = differs(spark, con, sf_dir, name)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s  {problem or 'same'}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} the same; without SQL: "
          f"{sorted(set(contract.queries()) - set(contract.oracle_sql()))}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
