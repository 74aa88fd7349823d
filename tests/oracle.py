"""Compare registered queries with their SQL: ``python tests/oracle.py [sf] [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in records), key=lambda r: tuple(map(repr, r)))


def compare(spark, folder, name, query, sql):
    start = time.time()
    got = query(spark, folder)
    left = rows(got.columns, [tuple(r) for r in got.collect()])
    spent = time.time() - start
    if sql is None:
        return f"rows-only {len(left[1])}", spent
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(sql)
    right = rows(want.columns, want.fetchall())
    if left == right:
        return f"ok {len(left[1])}", spent
    if left[0] != right[0]:
        return f"COLUMNS {left[0]} {right[0]}", spent
    extra = [r for r in left[1] if r not in set(right[1])][:2] if len(left[1]) < 20000 else []
    lost = [r for r in right[1] if r not in set(left[1])][:2] if len(left[1]) < 20000 else []
    return f"DIFF {len(left[1])} {len(right[1])}\n   spark {str(extra)[:900]}\n   sql   {str(lost)[:900]}", spent


if __name__ == "__main__":
    from inkweave.catalog import entries
    from inkweave.session import build_session

    scale, names = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    session = build_session("oracle", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": "/tmp/inkweave-warehouse",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    session.sparkContext.setLogLevel("OFF")
    for key, (query, sql) in entries().items():
        if names and not any(key == n or key.startswith(n + "*") or (n.endswith("*") and key.startswith(n[:-1])) for n in names):
            continue
        try:
            verdict, spent = compare(session, f"/root/testdata/sf{scale}", key, query, sql)
        except Exception as error:
            verdict, spent = "ERROR " + str(error)[:900], 0
        print(f"{key:28s} {spent:6.1f}s {verdict}", flush=True)
